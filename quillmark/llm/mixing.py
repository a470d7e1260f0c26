"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Documents are hashed into shards of about ``shard_rows`` rows; a source that is
small for so many goes to a few of them, so that it has blocks enough wherever
it is. Inside a shard each source's words, in seeded order, form a stream of
blocks of ``block_tokens`` words, the same number for every source. Sources win
blocks by highest quotients v / (2a + 1), where v is the source's wanted blocks
and a those it has won, which gives integer quotas. A quota is met by whole
passes over the stream and a seeded choice of its blocks for the rest; words
that no whole block fits into carry over as the start of one more block. Shards
are independent and bounded, so a hot source is spread over all of them and
nothing but one row a source is gathered.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, hand_back, table

#: Weights of sources in code-point order, null last, repeating.
WEIGHTS = (3, 1, 2)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source of ``sized`` (source, size): source, source_size, rows, target.

    Targets share ``share`` times all sizes by weight; a target stops at ``cap`` times its source's size and the excess
    goes to the others by weight until none is above. That is the level at which sum(min(cap * size, level * weight))
    meets the share, found with running sums over the sources in the order in which they fill up.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    top = F.col("source_size") * F.lit(float(cap))
    s = by.withColumn("w", w).withColumn("top", top).withColumn("fills_at", F.col("top") / F.col("w"))
    fill = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0.0))).withColumn(
        "w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    # The first source that stays below its top sets the level for all later ones.
    level = F.first(F.when(F.col("left") / F.col("w_left") < F.col("fills_at"), F.col("left") / F.col("w_left")), True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    s = s.withColumn("level", level)
    return s.select("source", "source_size", "rows", F.when(F.col("level").isNull(), F.col("top")).otherwise(F.least(F.col("top"), F.col("level") * F.col("w"))).alias("target"))


def apportion(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: ``seats`` seats by highest quotients votes / (2a + 1); nobody gets more than ``most``."""
    won = np.zeros(len(votes), np.int64)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0 and most[i] > 0]
    heapq.heapify(heap)
    # Far from the end the order of seats does not matter: hand out what every divisor near the last one gives.
    if seats > 4 * len(votes):
        divisor = votes.sum() / seats
        won = np.minimum(np.maximum(np.floor(votes / divisor).astype(np.int64) - 1, 0), most)
        heap = [(-votes[i] / (2 * won[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and won[i] < most[i]]
        heapq.heapify(heap)
    for _ in range(seats - int(won.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        won[i] += 1
        if won[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def _seeded(*what) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, what)), 0)


def _order(n: int, seed: int) -> np.ndarray:
    """A seeded order of 0 to n - 1: by a mix of seed and number."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return np.argsort(x ^ (x >> np.uint64(31)), kind="stable")


def quota_words(quota: int, wanted: float, size: int, block: int, cap: int, least_blocks: int) -> int:
    """Words of a quota: ``block`` for each of its blocks. A source with fewer than ``least_blocks`` blocks in the shard, for
    which half a block is much, has its last one cut at the words it wants."""
    return quota * block if size >= least_blocks * block else min(round(wanted), cap * size)


def mix_shard(pdf: pd.DataFrame, seed: int, block_tokens: int, least_blocks: int, cap: int) -> list[list[tuple[int, int]]]:
    """For every row of one shard (columns key, source, size, share: wanted words per word) the word spans taken."""
    taken: list[list[tuple[int, int]]] = [[] for _ in range(len(pdf))]
    size, share, key = pdf["size"].to_numpy(np.int64), pdf["share"].to_numpy(float), pdf["key"].to_numpy()
    shard = int(pdf["shard"].iloc[0])
    names = pdf["source"].map(lambda s: "n" if s is None or s != s else f"s{s}").to_numpy()
    groups = []
    for name in sorted(set(names)):
        rows = np.flatnonzero((names == name) & (size > 0))
        if len(rows):
            rows = rows[np.argsort([_seeded(seed, "order", key[r], i) for i, r in enumerate(rows)], kind="stable")]
            groups.append((name, rows, np.cumsum(size[rows]), share[rows[0]]))
    totals = np.array([int(ends[-1]) for _, _, ends, _ in groups], np.int64)
    votes = totals * np.array([g[3] for g in groups]) / block_tokens
    quotas = apportion(votes, int(round(votes.sum())), cap * totals // block_tokens)
    for (name, rows, ends, _), total, vote, quota in zip(groups, totals.tolist(), votes, quotas):
        passes, rest = divmod(quota_words(int(quota), vote * block_tokens, total, block_tokens, cap, least_blocks), total)
        full, (whole, carry) = total // block_tokens, divmod(rest, block_tokens)
        order = _order(full, _seeded(seed, shard, name))
        extra = np.zeros(full + 2, np.int8)
        extra[order[:whole] + 1] = 1
        edges = np.diff(extra)
        spans = [(0, total)] * passes + list(zip((block_tokens * np.flatnonzero(edges == 1)).tolist(), (block_tokens * np.flatnonzero(edges == -1)).tolist()))
        if carry:
            at = block_tokens * (int(order[whole]) if whole < full else full)
            spans.append((at, at + carry))
        starts = ends - size[rows]
        for a, b in spans:
            for i in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))):
                lo, hi = max(a, int(starts[i])), min(b, int(ends[i]))
                if lo < hi:
                    taken[rows[i]].append((lo - int(starts[i]), hi - int(starts[i])))
    return taken


def _sharded(docs: DataFrame, columns: list[str], p: dict) -> DataFrame:
    """row (a struct of ``columns``) of every row, with size, key, shard, source, source_size, target and share."""
    sized = docs.select(docs["source"].alias("source"), n_words(docs["text"]).alias("size"))
    targets = Scratch(docs.sparkSession).keep(source_targets(sized, p["weights"], p["share"], p["cap"]))
    shards = max(1, -(-(targets.agg(F.sum("rows")).first()[0] or 0) // p["shard_rows"]))
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs["source"].alias("source"), n_words(docs["text"]).alias("size"), F.xxhash64(docs["doc_id"], docs["text"]).alias("key"))
    # A source goes to as many shards as leave it least_blocks blocks in each, or as its rows need.
    own = F.least(F.lit(shards), F.greatest(F.lit(1), F.floor(F.col("source_size") / (p["least_blocks"] * p["block_tokens"])), F.ceil(F.col("rows") / p["shard_rows"])))
    targets = targets.select(
        F.col("source").alias("_of"), "source_size", "target", (F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).alias("share"),
        own.cast("long").alias("own"), F.pmod(F.xxhash64(F.lit("first"), "source"), F.lit(shards)).alias("first"),
    )
    shard = F.pmod(F.col("first") + F.pmod(F.xxhash64("key"), F.col("own")), F.lit(shards))
    return rows.join(targets, F.col("source").eqNullSafe(F.col("_of"))).withColumn("shard", shard).drop("_of", "own", "first")


def _spans(t: pa.Table, p: dict) -> tuple[pa.Table, list]:
    t = t.take(pc.sort_indices(t, [("key", "ascending")]))
    cols = pd.DataFrame({c: t.column(c).to_pylist() for c in ("key", "source", "size", "share", "shard")})
    return t, mix_shard(cols, p["seed"], p["block_tokens"], p["least_blocks"], p["cap"])


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: int = 2, seed: int = 17, block_tokens: int = 64, least_blocks: int = 32, shard_rows: int = 1024) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text and source are read; other columns,
    whatever their names, are not).

    Null text: size 0, nothing taken. Null source: a source of its own, last in order. Repeated rows are mixed as rows of
    their own. No row is taken more than ``cap`` times. Seeded: equal inputs give equal mixes. Empty table: empty result.
    """
    p = {"weights": weights, "share": share, "cap": cap, "seed": seed, "block_tokens": block_tokens, "least_blocks": least_blocks, "shard_rows": shard_rows}

    def run(t: pa.Table) -> pa.Table:
        t, spans = _spans(t, p)
        taken = pa.array([sum(b - a for a, b in s) for s in spans], pa.int64())
        return pa.table({"doc_id": pc.struct_field(t["row"], [0]), "size": t["size"], "source_size": t["source_size"], "target": t["target"], "taken": taken})

    return _sharded(docs, ["doc_id"], p).groupBy("shard").applyInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, size long, source_size long, target double, taken long")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The word spans of ``text`` in order, one below the other; a span of all words is the whole text as it is."""
    words = [m.span() for m in _WORD.finditer(text)]
    return "\n".join(text if b - a == len(words) else text[words[a][0] : words[b - 1][1]] for a, b in spans)


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: int = 2, seed: int = 17, block_tokens: int = 64, least_blocks: int = 32, shard_rows: int = 1024) -> DataFrame:
    """The mix itself, with the columns of ``docs``, whatever their names: one row per row of which words are taken, its text the
    words taken (those taken twice stand twice), ``n_chars``, where there is such a column, the length of that text. Nulls,
    repeats and empty tables as in ``mix``; a row without words goes."""
    p = {"weights": weights, "share": share, "cap": cap, "seed": seed, "block_tokens": block_tokens, "least_blocks": least_blocks, "shard_rows": shard_rows}
    schema = docs.schema

    def run(t: pa.Table) -> pa.Table:
        hand_back()  # what the group before took
        t, spans = _spans(t, p)
        at = [i for i, s in enumerate(spans) if s]
        rows = t.column("row").take(pa.array(at, pa.int64()))
        cols = {n: pc.struct_field(rows, [i]) for i, n in enumerate(schema.names)}
        texts = [cut_words(x, spans[i]) for i, x in zip(at, cols["text"].to_pylist())]
        cols["text"] = pa.array(texts, pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array(list(map(len, texts)), pa.int64()).cast(cols["n_chars"].type)
        return pa.table(cols)

    return _sharded(docs, schema.names, p).groupBy("shard").applyInArrow(run, schema)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
