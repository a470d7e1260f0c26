"""Diagnostics of candidate pools and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rank_metrics import hits, positions
from .rules import addons, primaries_met
from .set_metrics import BINS, flags, per_note, r6, ratio, with_bin


def candidate_recall(gold: DataFrame, ranking: DataFrame, ks=(20, 50, 100, 200, 500)) -> DataFrame:
    """k, recall of gold within the first k of the pool; depths beyond the longest pool count as that length."""
    deep = ranking.groupBy("note_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("deep"))
    p = ranking.select("note_id", "code", "pos")
    g = gold.join(p, ["note_id", "code"], "left").crossJoin(deep)  # one row
    e = g.select("pos", F.explode(F.array_distinct(F.array(*[F.least(F.lit(k), F.col("deep").cast("int")) for k in ks]))).alias("k"))
    return e.groupBy("k").agg(r6(F.avg(F.coalesce((F.col("pos") <= F.col("k")).cast("int"), F.lit(0)))).alias("recall"), F.count("*").alias("n_gold"))


def top_gold(gold: DataFrame, ranking: DataFrame) -> DataFrame:
    """One row: recall when each note keeps as many codes as it has gold."""
    n = gold.groupBy("note_id").agg(F.count("*").alias("n_gold"))
    h = hits(gold, ranking).join(n, "note_id")
    return h.agg(F.count("*").alias("n_gold"), F.sum(F.coalesce((F.col("r") <= F.col("n_gold")).cast("int"), F.lit(0))).alias("hits"), r6(F.avg(F.coalesce((F.col("r") <= F.col("n_gold")).cast("int"), F.lit(0)))).alias("recall"))


def set_sizes(note_ids: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    s = per_note(note_ids, gold, pred).select((F.col("tp") + F.col("fn")).alias("g"), (F.col("tp") + F.col("fp")).alias("p"))
    return s.agg(r6(F.avg("g")).alias("mean_gold"), r6(F.avg("p")).alias("mean_pred"), r6(F.avg(F.abs(F.col("g") - F.col("p")))).alias("mae"), r6(ratio(F.sum("p"), F.sum("g"))).alias("pred_gold_ratio"))


def strata(gold: DataFrame, ranking: DataFrame, pred: DataFrame, bins: DataFrame) -> DataFrame:
    """Every bin: gold, and its shares in the pool, under the top-gold oracle, and predicted."""
    n = gold.groupBy("note_id").agg(F.count("*").alias("n_gold"))
    h = hits(gold, ranking).join(n, "note_id").join(pred.select("note_id", "code", F.lit(1).alias("p")).distinct(), ["note_id", "code"], "left")
    s = with_bin(h, bins).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(F.col("r").isNotNull().cast("int")).alias("pool"), F.avg(F.coalesce((F.col("r") <= F.col("n_gold")).cast("int"), F.lit(0))).alias("oracle"), F.avg(F.coalesce("p", F.lit(0))).alias("realised")
    )
    names = gold.sparkSession.createDataFrame([(b,) for b in BINS], "bin string")
    return names.join(s, "bin", "left").na.fill(0).select("bin", F.col("n").alias("n_gold"), *[r6(F.col(c)).alias(f"{c}_recall") for c in ("pool", "oracle", "realised")])


def union_recall(gold: DataFrame, sources: DataFrame, combos: dict[str, tuple[str, ...]]) -> DataFrame:
    """combo, recall, mean_pool. sources(note_id, code, source); a pair is reduced to a bit set of its sources once, from
    which every combination is read."""
    names = sorted({s for c in combos.values() for s in c})
    bit = lambda s: F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i))]), s)
    m = sources.where(F.col("source").isin(*names)).groupBy("note_id", "code").agg(F.bit_or(bit(F.col("source"))).alias("bits"))
    g = gold.select("note_id", "code", F.lit(1).alias("y"))
    pairs = m.join(g, ["note_id", "code"], "full_outer").na.fill(0, ["bits", "y"])
    counts = pairs.groupBy("bits", "y").agg(F.count("*").alias("k"))
    notes = gold.select("note_id").distinct().agg(F.count("*").alias("notes"))
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("combo"), F.lit(sum(1 << names.index(s) for s in use)).alias("mask")) for name, use in combos.items()]))
    e = counts.crossJoin(notes).withColumn("x", rows)  # one row
    inside = F.when(F.col("bits").bitwiseAND(F.col("x.mask")) != 0, F.col("k")).otherwise(0)
    s = e.groupBy(F.col("x.combo").alias("combo")).agg(F.sum(inside * F.col("y")).alias("h"), F.sum(F.col("k") * F.col("y")).alias("g"), F.sum(inside).alias("pool"), F.first("notes").alias("notes"))
    return s.select("combo", r6(ratio(F.col("h"), F.col("g"))).alias("recall"), r6(F.col("pool") / F.col("notes")).alias("mean_pool"))


def recovery(gold: DataFrame, sources: DataFrame, base: str, others: tuple[str, ...]) -> DataFrame:
    """One row: gold that ``base`` misses, and how much of it each other source, and all together, bring back."""
    m = sources.groupBy("note_id", "code").agg(F.max((F.col("source") == base).cast("int")).alias("b"), *[F.max((F.col("source") == o).cast("int")).alias(o) for o in others])
    miss = gold.join(m, ["note_id", "code"], "left").na.fill(0).where("b = 0")
    return miss.agg(F.count("*").alias("missing"), *[F.coalesce(F.sum(o), F.lit(0)).cast("long").alias(f"by_{o}") for o in others], F.coalesce(F.sum(F.greatest(*map(F.col, others))), F.lit(0)).cast("long").alias("by_any"))


def recall_by_strata(gold: DataFrame, sources: DataFrame, bins: DataFrame) -> DataFrame:
    """source and, a column a bin, the recall of gold of that bin."""
    g = with_bin(gold, bins)
    n = g.groupBy("bin").agg(F.count("*").alias("n"))
    s = sources.join(g, ["note_id", "code"]).groupBy("source", "bin").agg(F.count_distinct("note_id", "code").alias("h")).join(n, "bin")
    return s.groupBy("source").pivot("bin", list(BINS)).agg(r6(F.first(F.col("h") / F.col("n")))).na.fill(0.0)


def depth_sweep(gold: DataFrame, neighbours: DataFrame, base: DataFrame, ks=(5, 10, 25, 50)) -> DataFrame:
    """k, recall of neighbour codes (note_id, code, rank) up to rank k, of their union with ``base``, and the union's mean size."""
    first = neighbours.groupBy("note_id", "code").agg(F.min("rank").alias("rank"))
    m = first.join(base.select("note_id", "code", F.lit(1).alias("b")).distinct(), ["note_id", "code"], "full_outer").join(gold.select("note_id", "code", F.lit(1).alias("y")), ["note_id", "code"], "full_outer").na.fill(0, ["b", "y"])
    n = gold.agg(F.count("*").alias("g"), F.count_distinct("note_id").alias("notes"))
    e = m.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    near = F.coalesce((F.col("rank") < F.col("k")).cast("int"), F.lit(0))
    s = e.groupBy("k").agg(F.sum(near * F.col("y")).alias("h"), F.sum(F.greatest(near, "b") * F.col("y")).alias("u"), F.sum(F.greatest(near, "b")).alias("size")).crossJoin(n)  # one row
    return s.select("k", r6(F.col("h") / F.col("g")).alias("neighbour_recall"), r6(F.col("u") / F.col("g")).alias("union_recall"), r6(F.col("size") / F.col("notes")).alias("mean_pool"))


def audit(audited: DataFrame, bins: DataFrame, ks=(10, 50, 100)) -> DataFrame:
    """bin (and all): n, share in the knowledge base, ceiling, recall at k. audited: note_id, code, in_kb, rank from 0 or null."""
    rows = with_bin(audited, bins).rollup("bin").agg(
        F.count("*").alias("n"), r6(F.avg(F.col("in_kb").cast("int"))).alias("share_in_kb"), r6(F.count("rank") / F.count("*")).alias("ceiling"),
        *[r6(F.avg(F.coalesce((F.col("rank") < k).cast("int"), F.lit(0)))).alias(f"recall_at_{k}") for k in ks],
    )
    return rows.withColumn("bin", F.coalesce("bin", F.lit("all")))


def sibling_flags(gold: DataFrame, pred: DataFrame, families: DataFrame) -> DataFrame:
    """note_id, code, family, fp, fn, sibling (a wrong code of a family that gold has), substitution (of a family with a code
    missed), near_miss (a missed code of a family predicted). Notes in both tables alone."""
    both = gold.select("note_id").distinct().join(pred.select("note_id").distinct(), "note_id")
    f = flags(gold.join(both, "note_id", "left_semi"), pred.join(both, "note_id", "left_semi")).join(families, "code", "left")
    w = Window.partitionBy("note_id", "family")
    has = f.withColumn("any_gold", F.max(F.col("tp") + F.col("fn")).over(w)).withColumn("any_missed", F.max("fn").over(w)).withColumn("any_pred", F.max(F.col("tp") + F.col("fp")).over(w))
    known = F.col("family").isNotNull().cast("int")
    return has.select("note_id", "code", "family", "tp", "fp", "fn", (F.col("fp") * F.col("any_gold") * known).alias("sibling"), (F.col("fp") * F.col("any_missed") * known).alias("substitution"), (F.col("fn") * F.col("any_pred") * known).alias("near_miss"))


def sibling_analysis(flagged: DataFrame) -> DataFrame:
    """One row of counts and rates, with the gate's verdict."""
    rate = r6(ratio(F.sum("sibling"), F.sum("fp")))
    return flagged.agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], rate.alias("sibling_fp_rate"), r6(ratio(F.sum("substitution"), F.sum("fp"))).alias("substitution_fp_rate"), r6(ratio(F.sum("near_miss"), F.sum("fn"))).alias("nearmiss_fn_rate"),
    ).withColumn("verdict", F.when(F.col("sibling_fp_rate") >= 0.25, "targeted").when(F.col("sibling_fp_rate") < 0.15, "misdirected").otherwise("borderline"))


def confused_families(flagged: DataFrame, top: int = 25) -> DataFrame:
    """The families with most sibling errors: the report's top list."""
    return flagged.where("sibling = 1").groupBy("family").agg(F.count("*").alias("n"), F.min("note_id").alias("example")).orderBy(F.col("n").desc(), "family").limit(top)


def addon_axis(gold: DataFrame, pred: DataFrame, aoc1: DataFrame) -> DataFrame:
    """One row: wrong codes, those that are add-ons, and of those the ones without a primary among the predicted."""
    fp = flags(gold, pred).where("fp = 1").select("note_id", F.col("code").alias("addon"))
    adds = fp.join(addons(aoc1), "addon", "left_semi")
    held = primaries_met(adds, pred.select("note_id", "code").distinct(), aoc1).select("note_id", "addon").distinct()
    marked = fp.join(adds.withColumn("a", F.lit(1)), ["note_id", "addon"], "left").join(held.withColumn("h", F.lit(1)), ["note_id", "addon"], "left").na.fill(0)
    return marked.agg(F.count("*").alias("n_fp"), F.sum("a").alias("n_addon_fp"), F.sum(F.col("a") * (1 - F.col("h"))).alias("n_orphan"), r6(F.avg("a")).alias("addon_share"), r6(ratio(F.sum(F.col("a") * (1 - F.col("h"))), F.sum("a"))).alias("orphan_share"))


def header_patterns(headers: DataFrame, min_count: int = 2, top: int = 50) -> DataFrame:
    """section, header, n: a header of several sections stays with the one that has it most (ties: first by name)."""
    n = headers.groupBy("section", "header").agg(F.count("*").alias("n"))
    own = n.withColumn("i", F.row_number().over(Window.partitionBy("header").orderBy(F.col("n").desc(), F.col("section").asc_nulls_last()))).where("i = 1").where(F.col("n") >= min_count)
    w = Window.partitionBy("section").orderBy(F.col("n").desc(), F.length("header").desc(), F.col("header").asc_nulls_last())
    return own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("section", "header", "n", "place")


def agreement(pairs: DataFrame, a: str = "judge", b: str = "human") -> DataFrame:
    """One row: n, exact agreement, Cohen's kappa (1 where chance agreement is whole)."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("k"))
    w = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.sum("k").over(w)
    x = cells.withColumn("n", n).withColumn("row", F.sum("k").over(Window.partitionBy(a))).withColumn("col", F.sum("k").over(Window.partitionBy(b)))
    rows = x.select(F.col(a).alias("v"), "row", "n").distinct().join(x.select(F.col(b).alias("v"), "col").distinct(), "v")
    pe = rows.agg(F.coalesce(F.sum(F.col("row") * F.col("col") / (F.col("n") * F.col("n"))), F.lit(0.0)).alias("pe"))
    po = x.agg(F.max("n").alias("n"), (F.sum(F.when(F.col(a) == F.col(b), F.col("k")).otherwise(0)) / F.max("n")).alias("po"))
    return po.crossJoin(pe).select("n", r6(F.col("po")).alias("agreement"), r6(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))).alias("kappa"))


def encounter_rollup(billing: DataFrame, keep: Column | None = None) -> DataFrame:
    """hadm_id, subject_id, proc_codes (sorted, distinct, pipe-joined), n_codes of encounters with a code that ``keep`` accepts."""
    b = billing.select("hadm_id", "subject_id", F.upper(F.trim("hcpcs_cd")).alias("code")).where("code <> ''")
    out = b.groupBy("hadm_id").agg(F.min("subject_id").alias("subject_id"), F.sort_array(F.collect_set("code")).alias("codes"), F.max(keep.cast("int") if keep is not None else F.lit(1)).alias("any"))
    return out.where("any = 1").select("hadm_id", "subject_id", F.array_join("codes", "|").alias("proc_codes"), F.size("codes").alias("n_codes"))


def one_note_per_encounter(notes: DataFrame, how: str = "first", length: Column | None = None) -> DataFrame:
    """The note with the smallest id, or the longest one (ties: smallest id). ``length`` stands for that of the column text."""
    order = [F.col("note_id")] if how == "first" else [(F.length("text") if length is None else length).desc(), F.col("note_id")]
    return notes.withColumn("_i", F.row_number().over(Window.partitionBy("hadm_id").orderBy(*order))).where("_i = 1").drop("_i")


def normalisation_counts(normalised: DataFrame) -> DataFrame:
    """One row over the result of normalize_codes: rows, rows without an accepted code, and totals of each kind."""
    return normalised.agg(F.count("*").alias("rows_in"), F.sum((F.size("accepted") == 0).cast("int")).alias("rows_no_codes"), *[F.sum(F.size(c)).alias(f"n_{c}") for c in ("accepted", "unresolved", "dropped")])


def recall_buckets(gold: DataFrame, rankings: dict[str, DataFrame], kb: DataFrame, ks=(10, 50, 100, 200, 500)) -> DataFrame:
    """A row per ranker (note_id, code, rank from 0) and depth: recall of gold; also the share of gold in the knowledge base."""
    k = kb.select("code", F.lit(1).alias("known")).distinct()
    out = None
    for name, r in rankings.items():
        best = r.groupBy("note_id", "code").agg(F.min("rank").alias("rank"))
        x = gold.join(best, ["note_id", "code"], "left").join(k, "code", "left")
        one = x.select("rank", "known", F.explode(F.array(*map(F.lit, ks))).alias("k")).groupBy("k").agg(
            r6(F.avg(F.coalesce((F.col("rank") < F.col("k")).cast("int"), F.lit(0)))).alias("recall"), r6(F.count("known") / F.count("*")).alias("share_in_kb")
        ).withColumn("ranker", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("ranker", "k", "recall", "share_in_kb")


def score_quantiles(gold: DataFrame, ranking: DataFrame, qs=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """is_gold, n, quantiles of scores of gold and other cells."""
    x = ranking.join(gold.select("note_id", "code", F.lit(True).alias("is_gold")), ["note_id", "code"], "left").na.fill(False, ["is_gold"])
    return x.groupBy("is_gold").agg(F.count("*").alias("n"), F.percentile("score", F.array(*map(F.lit, qs))).alias("quantiles"))


def dropped_histogram(codes: DataFrame, keep: Column, section: Column, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """The codes that a filter drops, most common first (a report's top list), and counts by section before and after."""
    x = codes.withColumn("_keep", keep).withColumn("section", section)
    hist = x.where(~F.col("_keep")).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "code").limit(top)
    return hist, x.groupBy("section").agg(F.count("*").alias("before"), F.sum(F.col("_keep").cast("int")).alias("after"))


def worst_codes(gold: DataFrame, ranking: DataFrame, top: int = 10) -> DataFrame:
    """The codes whose gold the ranking finds least, the more frequent first: the report's list."""
    found = ranking.select("note_id", "code", F.lit(1).alias("f")).distinct()
    x = gold.join(found, ["note_id", "code"], "left").groupBy("code").agg(F.count("*").alias("n"), r6(F.avg(F.coalesce("f", F.lit(0)))).alias("recall"))
    return x.orderBy("recall", F.col("n").desc(), "code").limit(top)
