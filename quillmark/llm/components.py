"""Connected components by alternating large-star and small-star steps.

Each step is an aggregate (partial minimum before the shuffle) and an equi-join
of two written tables, so that adaptive execution can split the join at hub
nodes. Nothing is gathered on the driver but a row count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges`` has long columns ``u`` and ``v``; returns ``node``, ``root`` (smallest node of its component)
    for every node but the roots. Self-loops and repeated or reversed edges are allowed; an empty table gives an empty one."""
    e, path = scratch.write(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(
            e.select(F.col("v").alias("a"), F.col("u").alias("b"))
        )
        least, p1 = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large, p2 = scratch.write(
            both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        )
        least2, p3 = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least2, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("e")
        )
        new, p4 = scratch.write(small.select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).where("u <> v").distinct())
        new_mark = _mark(new)
        for p in (path, p1, p2, p3):
            scratch.drop(p)
        done, e, path, mark = new_mark == mark, new, p4, new_mark
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
