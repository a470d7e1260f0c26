"""Near-duplicates by SimHash, held against the Jaccard similarity of word shingles.

A shingle set has a SimHash of BITS bits. Sets are candidates where these lie near: first those whose leading 64 bits differ in
three or fewer, found through the pigeonhole blocks of ``simhash``. Sets at similarity 0.8 lie up to APART of BITS bits apart,
which no blocks can file, so sets are also filed under bands of minima of hashes, and compared by SimHash where they are filed
alike. What candidates connect is compared shingle by shingle, so every link is exact. A pair at similarity s shares no band with
probability ``(1 - s ** ROWS) ** BANDS``: 3 in 100,000 at 0.8. Equal sets are one class before filing. A bucket or group sends on a
spanning forest, not its pairs; a bucket over ``max_bucket`` classes, or a group over ``max_words`` shingles, is dealt to pairs of
chunks.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hand_back, id_kind, release_shuffles, slices, text_bytes
from .components import connected_components
from .simhash import keep_first, link_edges

BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
#: Bits of a SimHash, in words of 64. A bit differs with probability 0.19 at most between sets of similarity 0.8 (four shingles and five;
#: 0.15 where there are many), so more than APART bits do so twice in 100,000 times at most.
WORDS = 8
BITS, APART = 64 * WORDS, 132

_rng = np.random.default_rng(11)
_XOR = _rng.integers(0, 1 << 64, HASHES, np.uint64)
_ODD = _rng.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the whole text. Fewer words than ``shingle``: the one shingle they make."""
    words = text.lower().split()  # bytes.lower() touches A-Z alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])] or [h(joined, 42)], np.uint64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES hashes over all shingles (at least one)."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        x = (shingles[at : at + 2048, None] ^ _XOR) * _ODD
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return least


_SEED = np.append(np.uint64(0), _rng.integers(0, 1 << 64, WORDS - 1, np.uint64))


def simhash(shingles: np.ndarray) -> bytes:
    """BITS bits, each set if over half the shingles have it. The first word of a shingle is its hash, so the leading 64 bits are the
    fingerprint that ``simhash.fingerprint`` gives of a text that repeats no shingle; the other words are mixed from it."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 255):  # as many as a byte counts
        x = shingles[at : at + 255, None] ^ _SEED
        y = x[:, 1:]
        for odd in (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)):
            y = (y ^ (y >> np.uint64(31))) * odd
        x[:, 1:] = y ^ (y >> np.uint64(31))
        counts += np.unpackbits(x.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(shingles)).tobytes()


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, text_hash, class (of the shingle set), n (its size), keys (one a band), sketch (its SimHash) and fp (the leading 64 bits
    as a long) of every row; a text without words has no keys and an empty sketch."""

    def run(batches):
        for b in slices(batches):
            classes, sizes, keys, bytes_ = [], [], [], []
            for t in text_bytes(b.column(1)):
                s = shingle_set(t, shingle)
                m = minima(s).reshape(BANDS, ROWS) if len(s) else None
                classes.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                sizes.append(len(s))
                keys.append([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(m)] if len(s) else [])
                bytes_.append(simhash(s) if len(s) else b"")
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            offsets = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), long([x for k in keys for x in k]))
            fps = long([int.from_bytes(x[:8], "big") for x in bytes_])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), long(classes), pa.array(sizes, pa.int64()), lists, pa.array(bytes_, pa.binary()), fps], ["doc_id", "text_hash", "class", "n", "keys", "sketch", "fp"])

    kind = id_kind(docs, "doc_id")[0]
    slim = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return slim.mapInArrow(run, f"doc_id {kind}, text_hash long, class long, n long, keys array<long>, sketch binary, fp long")


def forest(n: int, near) -> list[tuple[int, int]]:
    """Spanning forest of the links among 0 to n - 1; ``near(i, left)`` tells which of the numbers ``left`` link with i."""
    left, out = np.arange(n), []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            ok = near(i, left)
            out += [(i, int(j)) for j in left[ok]]
            todo += left[ok].tolist()
            left = left[~ok]
    return out


def _frame(edges: list) -> pd.DataFrame:
    return pd.DataFrame(edges, columns=["u", "v"]).astype("int64")


def _look(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, b in pdf.groupby(["key", "i", "j"], sort=False):
        ids, x = b["class"].to_numpy(), np.frombuffer(b"".join(b["sketch"]), np.uint64).reshape(len(b), WORDS)
        out += [(ids[i], ids[j]) for i, j in forest(len(b), lambda i, left: np.bitwise_count(x[left] ^ x[i]).sum(axis=1) <= APART)]
    hand_back()
    return _frame(out)


def fingerprint_links(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """u, v: edges that connect the classes (columns class and fp) whose fingerprints lie three bits or fewer apart. Classes of one
    fingerprint hang on the least of them."""
    least = scratch.keep(sets.groupBy("fp").agg(F.min("class").alias("to")))
    same = sets.join(least, "fp").where(F.col("class") != F.col("to")).select(F.col("class").alias("u"), F.col("to").alias("v"))
    near = link_edges(least.select("fp"), scratch).join(least.select(F.col("fp").alias("u"), F.col("to").alias("_u")), "u")
    near = near.join(least.select(F.col("fp").alias("v"), F.col("to").alias("_v")), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    return near.union(same).distinct()


def _exact(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the links of at least ``similarity`` among sets."""
    sizes = np.array([len(s) for s in sets])
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    held = [number[e - s : e] for e, s in zip(ends, sizes)]
    mark = np.zeros(len(values), np.int64)

    def near(i, left):
        alike = np.minimum(sizes[left], sizes[i]) >= similarity * np.maximum(sizes[left], sizes[i]) - 1e-6
        ok = np.zeros(len(left), bool)
        if alike.any():
            some = left[alike]
            mark[held[i]] = 1
            both = np.add.reduceat(mark[np.concatenate([held[j] for j in some])], np.append(0, np.cumsum(sizes[some])[:-1]))
            mark[held[i]] = 0
            ok[alike] = both / (sizes[some] + sizes[i] - both) >= similarity
        return ok

    return forest(len(sets), near)


def _dealt(df: DataFrame, chunks) -> DataFrame:
    """Rows with i, j: one pair of equal numbers where ``chunks`` is 1, else all pairs of unlike chunks that hold the row."""
    df = df.withColumn("chunks", chunks.cast("long")).withColumn("side", F.pmod(F.xxhash64("class", F.lit("chunk")), F.col("chunks")))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).where("chunks = 1 or other <> side")
    return df.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))


def near_groups(docs: DataFrame, scratch: Scratch, shingle: int = 5, similarity: float = 0.8, group_rows: int = 8192, max_bucket: int = 4096, max_words: int = 2_000_000) -> DataFrame:
    """doc_id, text_hash, g of every row of ``docs`` (columns doc_id and text are read): rows have equal g where links of at
    least ``similarity`` connect them. Texts without words link with each other. Repeated rows stay."""
    rows = scratch.keep(sketches(docs, shingle))
    filed = rows.select("class", F.explode("keys").alias("key")).distinct()
    shared = scratch.keep(filed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    several = _dealt(scratch.keep(filed.join(shared, "key")), F.when(F.col("m") > max_bucket, F.ceil(F.col("m") / F.lit(max_bucket // 2))).otherwise(1))
    one = rows.groupBy("class").agg(F.first("sketch").alias("sketch"))
    groups = max(1, -(-several.count() // group_rows))
    several = several.join(one, "class").withColumn("bin", F.when(F.col("chunks") > 1, F.xxhash64("key", "i", "j")).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups))))
    look = several.select("bin", "key", "i", "j", "class", "sketch").groupBy("bin").applyInPandas(_look, "u long, v long")
    near = fingerprint_links(rows.where("n > 0").select("class", "fp").distinct(), scratch)
    roots = scratch.keep(connected_components(look.union(near), scratch))
    release_shuffles(docs.sparkSession)

    # Every candidate's text travels once: of equal sets, the text with the least doc_id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    both = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
    members = rows.join(both, F.col("class") == F.col("node"), "left_semi").groupBy("class").agg(first, F.first("n").alias("n"))
    members = scratch.keep(members.join(both, F.col("class") == F.col("node")).select("class", "root", "n", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")))
    sums = members.groupBy("root").agg(F.sum("n").alias("words"))
    total = members.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-total // max_words))
    text = docs.select(F.col("doc_id").cast(id_kind(docs, "doc_id")[0]).alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    told = text.join(members.join(sums, "root"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    told = _dealt(told, F.when(F.col("words") > max_words, F.ceil(F.col("words") / F.lit(max(1, max_words // 2)))).otherwise(1))
    told = told.withColumn("bin", F.when(F.col("chunks") > 1, F.xxhash64("root", "i", "j")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, b in pdf.groupby(["root", "i", "j"], sort=False):
            b = b.drop_duplicates("class")
            ids = b["class"].to_numpy()
            if len(ids) > 1:
                out += [(ids[i], ids[j]) for i, j in _exact([shingle_set(t.encode(), shingle) for t in b["text"]], similarity)]
        hand_back()
        return _frame(out)

    links = told.select("bin", "root", "i", "j", "class", "text").groupBy("bin").applyInPandas(compare, "u long, v long")
    linked = scratch.keep(connected_components(scratch.keep(links), scratch))
    release_shuffles(docs.sparkSession)
    return rows.join(linked, F.col("class") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "class").alias("g"))


def keep_one_near(docs: DataFrame, **params) -> DataFrame:
    """Rows of ``docs`` that stay when one row of each group of near-duplicates does: the one with the smallest doc_id (null last),
    then the smallest text hash. Null and empty texts are one group; a row repeated in full stays once; columns pass, whatever
    their names; an empty table stays empty."""
    scratch = Scratch(docs.sparkSession)
    return keep_first(docs, scratch.keep(near_groups(docs, scratch, **params)), scratch)
