"""SimHash near-duplicates through pigeonhole blocks.

Fingerprints that differ in at most ``k`` bits agree on at least ``n - k`` of
``n`` blocks, so each fingerprint is filed once under every choice of
``n - k`` blocks, and only fingerprints filed alike are compared. Exact copies
of a fingerprint are one row before filing. A bucket sends on a spanning forest
of its links, not its pairs; a bucket over ``max_bucket`` fingerprints is dealt
to pairs of chunks, so no task holds it whole and no link is lost.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_kind, slices, table, text_bytes
from .components import connected_components

BITS = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the whole text. No word: 0. Fewer words than ``shingle``: the one shingle they make."""
    words = text.lower().split()  # bytes.lower() touches A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    h = xxhash.xxh64_intdigest
    hashes = [h(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])] or [h(joined, 42)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for b in slices(batches):
            fps = [_signed(fingerprint(t, shingle)) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    kind = id_kind(docs, "doc_id")[0]
    slim = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return slim.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def block_masks(blocks: int, k: int) -> list[int]:
    """Bit masks of every choice of ``blocks - k`` blocks, as unsigned integers."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    one = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(one[i] for i in c) for c in combinations(range(blocks), blocks - k)]


def blocks_for(n: int, k: int, bucket: int = 64) -> int:
    """Blocks to cut ``n`` fingerprints into: the fewest whose keys, all but ``k`` of the blocks, are long enough that a key has
    ``bucket`` fingerprints or fewer by chance. Each block more lengthens the keys and adds to their number."""
    blocks = k + 2
    while n > bucket << round(BITS * (blocks - k) / blocks) and blocks < BITS // 4:
        blocks += 1
    return blocks


def _forest(fps: np.ndarray, side: np.ndarray | None, k: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``fps``; with ``side`` only links between its two values."""
    label, out = np.arange(len(fps)), []
    for i in range(1, len(fps)):
        near = np.bitwise_count(fps[:i] ^ fps[i]) <= k
        if side is not None:
            near &= side[:i] != side[i]
        at = np.flatnonzero(near)
        if len(at):
            labels, first = np.unique(label[at], return_index=True)
            out += [(i, int(at[f])) for f in first]
            to = labels[0]
            label[i] = to
            if len(labels) > 1:
                label[: i + 1][np.isin(label[: i + 1], labels)] = to
    return out


def _edges(pdf: pd.DataFrame, keys: list[str], k: int) -> pd.DataFrame:
    pdf = pdf.sort_values([*keys, "fp"], kind="stable")
    fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    key = [pdf[c].to_numpy() for c in keys]
    new = np.ones(len(fp), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in key]) if len(fp) else new[1:]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    us, vs = [], []
    # Runs of up to eight: all offsets at once; longer ones: a forest each.
    run_size = np.repeat(sizes, sizes)
    run_id = np.repeat(np.arange(len(sizes)), sizes)
    for d in range(1, 8):
        if len(fp) <= d:
            break
        a = np.flatnonzero((run_id[d:] == run_id[:-d]) & (run_size[d:] <= 8))
        a = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= k]
        us.append(fp[a]), vs.append(fp[a + d])
    for s, n in zip(starts[sizes > 8], sizes[sizes > 8]):
        side = pdf["side"].to_numpy()[s : s + n] if "side" in pdf else None
        side = side if side is not None and len(np.unique(side)) > 1 else None
        got = _forest(fp[s : s + n], side, k)
        us.append(fp[[s + i for i, _ in got]]), vs.append(fp[[s + j for _, j in got]])
    return pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)}) if us else pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})


def link_edges(fps: DataFrame, scratch: Scratch, k: int = 3, blocks: int | None = None, group_rows: int = 8192, max_bucket: int = 4096) -> DataFrame:
    """Edges u, v that connect what links of at most ``k`` bits connect among the distinct ``fps`` (one column, ``fp``). Unless
    ``blocks`` is given, their number follows that of the fingerprints."""
    count = fps.count()
    masks = [_signed(m) for m in block_masks(blocks or blocks_for(count, k), k)]
    filed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    n = count * len(masks)
    hot, path = scratch.write(filed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_bucket))
    any_hot = bool(hot.take(1))
    plain = filed.join(hot, ["t", "key"], "left_anti") if any_hot else filed
    groups = max(1, -(-n // group_rows))
    edges = (
        plain.withColumn("g", F.pmod(F.xxhash64("t", "key"), F.lit(groups)))
        .groupBy("g")
        .applyInPandas(lambda pdf: _edges(pdf, ["t", "key"], k), "u long, v long")
    )
    if any_hot:
        chunks = F.ceil(F.col("n") / F.lit(max_bucket // 2)).cast("long")
        dealt = (
            filed.join(hot, ["t", "key"])
            .withColumn("side", F.pmod(F.xxhash64("fp"), chunks))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
            .withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
        )
        edges = edges.union(dealt.groupBy("t", "key", "i", "j").applyInPandas(lambda pdf: _edges(pdf, ["t", "key"], k), "u long, v long"))
    return edges


def simhash_components(docs: DataFrame, shingle: int = 3, k: int = 3, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id and text are read): doc_id, text_hash, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable through fingerprints at most ``k`` bits apart).

    Null text: no words, fingerprint zero, which links like any other. Null doc_id: the row gets its component, and
    counts for no smallest id (null if the component has no id). Text ids stay text, others are longs. Repeated rows stay; other
    columns, whatever their names, are not read. Empty table: empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(fingerprints(docs, shingle))
    reps = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(link_edges(reps.select("fp"), scratch, k, blocks), scratch)
    rooted = scratch.keep(
        reps.join(roots, reps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    )
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = scratch.keep(named)
    by_fp = scratch.keep(rooted.join(named, "root").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of ``docs`` that stay when one row of each group ``g`` of ``found`` (doc_id, text_hash, g) does: the one with
    the smallest doc_id (null last), then the smallest text hash; a row repeated in full stays once."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    stay = scratch.keep(
        found.groupBy("g").agg(first, F.count("*").alias("n"))
        .select(F.col("first.doc_id").alias("_keep_id"), F.col("first.text_hash").alias("_keep_hash"))
    )
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["_keep_id"]) & (F.xxhash64(docs["text"]) == stay["_keep_hash"]), "left_semi")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1").take(1)
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """Rows of ``docs`` that stay when one row of each component does; nulls and repeats as in ``keep_first``."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(simhash_components(docs, **params))
    # A component without any id is told by its fingerprint.
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    return keep_first(docs, found.withColumn("g", group), scratch)
