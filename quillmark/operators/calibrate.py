"""Threshold sweeps and decoding at thresholds.

A sweep counts each pair once in the grid step it falls into and sums from the top, so its cost does not grow with the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .set_metrics import prf, r6

#: 0.05 to 0.95 by 0.01.
GRID = tuple(round(0.05 + i * 0.01, 4) for i in range(91))


def _steps(score: Column, grid) -> Column:
    """How many grid points are at most the score: 0 below the first."""
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= score))


def _labelled(gold: DataFrame, ranking: DataFrame) -> DataFrame:
    y = gold.select("note_id", "code", F.lit(1).alias("y"))
    return ranking.select("note_id", "code", "score").join(y, ["note_id", "code"], "left").na.fill(0, ["y"])


def _sums(pairs: DataFrame, keys: list[str], grid) -> DataFrame:
    """keys, thr, tp, n (codes kept) at every grid point. Few rows a key: one per grid point."""
    by = pairs.withColumn("step", _steps(F.col("score"), grid)).where("step > 0").groupBy(*keys, "step").agg(F.sum("y").alias("tp"), F.count("*").alias("n"))
    held = by.groupBy(*keys).agg(F.collect_list(F.struct("step", "tp", "n")).alias("h")) if keys else by.agg(F.collect_list(F.struct("step", "tp", "n")).alias("h"))
    over = lambda i, f: F.aggregate(F.filter("h", lambda x: x["step"] >= i), F.lit(0).cast("long"), lambda a, x: a + x[f])
    point = F.posexplode(F.array(*map(F.lit, grid)))
    return held.select(*keys, "h", point.alias("i", "thr")).select(*keys, "thr", over(F.col("i") + 1, "tp").alias("tp"), over(F.col("i") + 1, "n").alias("n"))


def threshold_sweep(gold: DataFrame, ranking: DataFrame, grid=GRID, universe: str = "gold") -> DataFrame:
    """thr, tp, fp, fn, precision, recall, f1. universe "ranking" leaves out gold of notes without a ranking."""
    g = gold if universe == "gold" else gold.join(ranking.select("note_id").distinct(), "note_id", "left_semi")
    total = g.agg(F.count("*").alias("total"))
    s = _sums(_labelled(gold, ranking), [], grid).crossJoin(total)  # one row
    tp, fp, fn = F.col("tp"), F.col("n") - F.col("tp"), F.col("total") - F.col("tp")
    return s.select("thr", "tp", fp.alias("fp"), fn.alias("fn"), *[r6(v).alias(k) for k, v in prf(tp, fp, fn).items()])


def best_threshold(sweep: DataFrame, digits: int = 6) -> DataFrame:
    """The first of the best: the lowest threshold of the highest F1."""
    s = sweep.withColumn("_f", F.round("f1", digits))
    return s.agg(F.max_by("thr", F.struct("_f", (-F.col("thr")).alias("t"))).alias("thr"), F.max("_f").alias("f1"))


def per_code_thresholds(gold: DataFrame, ranking: DataFrame, default: float = 0.5, grid=GRID, min_pos: int = 5, margin: float = 1e-3) -> DataFrame:
    """code, thr, f1, default_f1 of codes with at least min_pos gold whose best F1 beats that at ``default`` by the margin."""
    pos = gold.groupBy("code").agg(F.count("*").alias("pos")).where(F.col("pos") >= min_pos)
    s = _sums(_labelled(gold, ranking), ["code"], tuple(sorted({*grid, default}))).join(pos, "code")
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("n") + F.col("pos")))
    s = s.withColumn("f1", f1).groupBy("code").agg(
        F.max_by("thr", F.struct(F.when(F.col("thr").isin(*map(float, grid)), F.round("f1", 12)), (-F.col("thr")).alias("t"))).alias("thr"),
        F.max(F.when(F.col("thr").isin(*map(float, grid)), F.col("f1"))).alias("f1"), F.max(F.when(F.col("thr") == default, F.col("f1"))).alias("default_f1"),
    )
    return s.where(F.col("f1") > F.col("default_f1") + margin).select("code", "thr", r6(F.col("f1")).alias("f1"), r6(F.col("default_f1")).alias("default_f1"))


def threshold_decode(ranking: DataFrame, thresholds: DataFrame | None = None, default: float = 0.5, min_predictions: int = 0, top_k: int | None = None) -> DataFrame:
    """note_id, code, score kept: at or above the code's threshold (else the default), the first top_k at most, and the first
    min_predictions at least."""
    r = ranking
    if thresholds is not None:
        r = r.join(thresholds.select(F.col("code").alias("_c"), "thr"), F.col("code") == F.col("_c"), "left").drop("_c")
    else:
        r = r.withColumn("thr", F.lit(None).cast("double"))
    order = Window.partitionBy("note_id").orderBy(F.col("score").desc(), "pos")
    r = r.withColumn("r", F.row_number().over(order))
    keep = F.col("score") >= F.coalesce("thr", F.lit(default))
    if top_k is not None:
        keep &= F.col("r") <= top_k
    r = r.withColumn("_keep", keep)
    kept = F.sum(F.col("_keep").cast("int")).over(Window.partitionBy("note_id"))
    return r.withColumn("_n", kept).where(F.col("_keep") | ((F.col("_n") < min_predictions) & (F.col("r") <= min_predictions))).select("note_id", "code", "score")


def unique_score_thresholds(gold: DataFrame, ranking: DataFrame, min_positives: int = 10, most: int = 100) -> DataFrame:
    """code, thr, f1, average_precision, n_pos by the best of the code's own scores (``most`` evenly spaced ones) and 0.5.

    The distinct scores of a code are counted before anything is gathered; what one code gathers is its grid. Codes with too
    few positives or no negatives keep 0.5 and F1 0."""
    pairs = _labelled(gold, ranking)
    by = pairs.groupBy("code", "score").agg(F.sum("y").alias("k"), F.count("*").alias("n"))
    w = Window.partitionBy("code").orderBy(F.col("score").desc())
    by = by.withColumn("tp", F.sum("k").over(w)).withColumn("shown", F.sum("n").over(w)).withColumn("i", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(Window.partitionBy("code")))
    pos = gold.groupBy("code").agg(F.count("*").alias("n_pos"))
    by = by.join(pos, "code").withColumn("all", F.sum("n").over(Window.partitionBy("code")))
    ap = F.sum(F.col("tp") / F.col("shown") * F.col("k")).over(Window.partitionBy("code")) / F.col("n_pos")
    step = F.col("i") * (most - 1) / F.greatest(F.col("m") - 1, F.lit(1))
    sampled = (F.col("m") <= most) | (F.floor(step) != F.floor((F.col("i") - 1) * (most - 1) / F.greatest(F.col("m") - 1, F.lit(1)))) | (F.col("i") == 0)
    half = (F.col("score") >= 0.5) & F.coalesce(F.lead("score").over(w) < 0.5, F.lit(True))
    f1 = 2 * F.col("tp") / (F.col("shown") + F.col("n_pos"))
    x = by.withColumn("f1", f1).withColumn("ap", ap).withColumn("half", half).where(sampled | F.col("half"))
    point = F.explode(F.array_compact(F.array(F.when(sampled, F.col("score")), F.when(F.col("half"), F.lit(0.5)))))
    x = x.select("code", "n_pos", "all", "ap", "f1", point.alias("thr"))
    best = x.groupBy("code", "n_pos", "all", "ap").agg(F.max_by("thr", F.struct(F.round("f1", 12), (-F.col("thr")).alias("t"))).alias("thr"), F.max("f1").alias("f1"))
    fit = (F.col("n_pos") >= min_positives) & (F.col("all") > F.col("n_pos"))
    return best.select("code", F.when(fit, F.col("thr")).otherwise(0.5).alias("thr"), r6(F.when(fit, F.col("f1")).otherwise(0.0)).alias("f1"), r6(F.col("ap")).alias("average_precision"), "n_pos")
