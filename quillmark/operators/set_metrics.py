"""Set metrics of predicted against gold codes.

Canonical inputs: note_ids(note_id), gold(note_id, code), pred(note_id, code). The note universe is a table of its own,
because notes without gold and without predictions count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = ("head", "torso", "tail", "unseen")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1; zero where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def r6(c: Column) -> Column:
    return F.round(c, 6)


def flags(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """note_id, code, tp, fp, fn of every code that is gold or predicted. Notes without gold have no row in gold; only
    notes of the universe should be given. Both sides are tagged and summed, which takes one shuffle."""
    both = gold.select("note_id", "code", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select("note_id", "code", F.lit(0).alias("g"), F.lit(1).alias("p")))
    s = both.groupBy("note_id", "code").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return s.select("note_id", "code", (F.col("g") * F.col("p")).alias("tp"), ((1 - F.col("g")) * F.col("p")).alias("fp"), (F.col("g") * (1 - F.col("p"))).alias("fn"))


def per_code(gold: DataFrame, pred: DataFrame) -> DataFrame:
    f = flags(gold, pred).groupBy("code").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return f.select("code", "tp", "fp", "fn", *[r6(v).alias(k) for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()], (F.col("tp") + F.col("fn")).alias("support"))


def per_note(note_ids: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """note_id, tp, fp, fn, exact, jaccard, example_f1 of every note of the universe; two empty sets agree."""
    s = flags(gold, pred).groupBy("note_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    z = note_ids.select("note_id").distinct().join(s, "note_id", "left").na.fill(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return z.select(
        "note_id", "tp", "fp", "fn", ((fp + fn) == 0).cast("int").alias("exact"),
        F.when(tp + fp + fn == 0, 1.0).otherwise(tp / (tp + fp + fn)).alias("jaccard"),
        F.when(2 * tp + fp + fn == 0, 1.0).otherwise(2 * tp / (2 * tp + fp + fn)).alias("example_f1"),
    )


def set_metrics(note_ids: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: notes, micro and macro P/R/F1, exact match, mean Jaccard, mean example F1. Macro means run over codes with gold."""
    codes = flags(gold, pred).groupBy("code").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    supported = tp + fn > 0
    each = prf(tp, fp, fn)
    micro = codes.agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"), F.coalesce(F.sum("fn"), F.lit(0)).alias("fn"),
        *[F.coalesce(F.avg(F.when(supported, v)), F.lit(0.0)).alias(f"macro_{k}") for k, v in each.items()],
    )
    notes = per_note(note_ids, gold, pred).agg(F.count("*").alias("n_notes"), F.avg("exact").alias("exact_match"), F.avg("jaccard").alias("mean_jaccard"), F.avg("example_f1").alias("mean_example_f1"))
    return micro.crossJoin(notes).select(  # one row each
        "n_notes", "tp", "fp", "fn", *[r6(v).alias(f"micro_{k}") for k, v in prf(tp, fp, fn).items()],
        *[r6(F.col(c)).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "exact_match", "mean_jaccard", "mean_example_f1")],
    )


def per_category(note_ids: DataFrame, gold: DataFrame, pred: DataFrame, category: Column) -> DataFrame:
    """Set metrics within each category that gold has; notes without a code of it still count, as agreeing. Notes that do
    not show in a category are counted, not made, so nothing is multiplied by the categories."""
    f = flags(gold, pred).withColumn("category", category).where("category <> 'UNKNOWN'")
    by_code = f.groupBy("category", "code").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    sums = by_code.groupBy("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg(F.when(tp + fn > 0, prf(tp, fp, fn)["f1"])).alias("macro_f1")).where("tp + fn > 0")
    by_note = f.groupBy("category", "note_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    shown = by_note.groupBy("category").agg(F.count("*").alias("k"), F.sum(((fp + fn) == 0).cast("int")).alias("exact"), F.sum(tp / (tp + fp + fn)).alias("jac"), F.sum(2 * tp / (2 * tp + fp + fn)).alias("ex"))
    n = note_ids.select("note_id").distinct().agg(F.count("*").alias("n"))
    absent = F.col("n") - F.col("k")
    return sums.join(shown, "category").crossJoin(n).select(  # one row
        "category", "tp", "fp", "fn", *[r6(v).alias(f"micro_{k}") for k, v in prf(tp, fp, fn).items()], r6(F.col("macro_f1")).alias("macro_f1"),
        r6((F.col("exact") + absent) / F.col("n")).alias("exact_match"), r6((F.col("jac") + absent) / F.col("n")).alias("mean_jaccard"), r6((F.col("ex") + absent) / F.col("n")).alias("mean_example_f1"),
    )


def frequency_bins(gold: DataFrame, head: float = 0.80, torso: float = 0.95) -> DataFrame:
    """code, frequency, cumulative_freq, rank, bin: codes by falling frequency (ties by code), cut by inclusive cumulative share.

    The running sum is over distinct frequencies first, a table of few rows; codes get their place among equals by a
    window over that frequency, so no window holds all codes unless all are equally frequent."""
    freq = gold.groupBy("code").agg(F.count("*").alias("frequency"))
    steps = freq.groupBy("frequency").agg(F.count("*").alias("codes"))
    before = Window.orderBy(F.col("frequency").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = steps.select(
        "frequency", F.coalesce(F.sum("codes").over(before), F.lit(0)).alias("codes_before"),
        F.coalesce(F.sum(F.col("codes") * F.col("frequency")).over(before), F.lit(0)).alias("cum_before"), F.sum(F.col("codes") * F.col("frequency")).over(whole).alias("total"),
    )
    at = F.row_number().over(Window.partitionBy("frequency").orderBy("code"))
    placed = freq.withColumn("at", at).join(steps, "frequency")
    cum = (F.col("cum_before") + F.col("at") * F.col("frequency")) / F.col("total")
    return placed.select("code", "frequency", cum.alias("cumulative_freq"), (F.col("codes_before") + F.col("at")).cast("long").alias("rank"), F.when(cum <= head, "head").when(cum <= torso, "torso").otherwise("tail").alias("bin"))


def with_bin(df: DataFrame, bins: DataFrame, code: str = "code") -> DataFrame:
    """``df`` with the code's bin, unseen where there is none."""
    b = bins.select(F.col("code").alias("_bin_code"), F.when(F.col("bin").isin(*BINS), F.col("bin")).otherwise("unseen").alias("bin"))
    return df.join(b, df[code] == b["_bin_code"], "left").drop("_bin_code").withColumn("bin", F.coalesce("bin", F.lit("unseen")))


def per_bin(gold: DataFrame, pred: DataFrame, bins: DataFrame) -> DataFrame:
    codes = flags(gold, pred).groupBy("code").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    each = prf(tp, fp, fn)
    s = with_bin(codes, bins).groupBy("bin").agg(F.count("*").alias("n_codes"), *[F.coalesce(F.avg(F.when(tp + fn > 0, v)), F.lit(0.0)).alias(f"macro_{k}") for k, v in each.items()], *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return s.select("bin", "n_codes", "tp", "fp", "fn", *[r6(v).alias(f"micro_{k}") for k, v in prf(tp, fp, fn).items()], *[r6(F.col(f"macro_{k}")).alias(f"macro_{k}") for k in each])


def drift(gold: DataFrame, train_gold: DataFrame, kb_codes: DataFrame) -> DataFrame:
    """note_id, code, seen_in_train, in_knowledge_base, train_frequency, train_bin of every gold code."""
    b = frequency_bins(train_gold).select(F.col("code").alias("_c"), "frequency", "bin")
    k = kb_codes.select(F.col("code").alias("_k")).distinct()
    return gold.join(b, gold["code"] == F.col("_c"), "left").join(k, gold["code"] == F.col("_k"), "left").select(
        "note_id", gold["code"], F.col("_c").isNotNull().alias("seen_in_train"), F.col("_k").isNotNull().alias("in_knowledge_base"),
        F.coalesce("frequency", F.lit(0)).alias("train_frequency"), F.coalesce("bin", F.lit("unseen")).alias("train_bin"),
    )


def note_tiers(note_ids: DataFrame, gold: DataFrame, bins: DataFrame) -> DataFrame:
    """note_id, n_gold, tier (the rarest bin of its gold; none: head), size_bucket."""
    from ..functions.codes import size_bucket

    rarity = F.when(F.col("bin") == "head", 0).when(F.col("bin") == "torso", 1).when(F.col("bin") == "tail", 2).otherwise(3)
    s = with_bin(gold, bins).groupBy("note_id").agg(F.count("*").alias("n_gold"), F.max(rarity).alias("rarity"))
    z = note_ids.select("note_id").join(s, "note_id", "left")
    return z.select("note_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.element_at(F.array(*map(F.lit, BINS)), F.coalesce("rarity", F.lit(0)) + 1).alias("tier"), size_bucket(F.coalesce("n_gold", F.lit(0))).alias("size_bucket"))


def prediction_stats(note_ids: DataFrame, pred: DataFrame, budget: int = 10) -> DataFrame:
    """One row: notes, codes, mean, upper median, empty notes, share of the budget used, share of notes at budget. The
    median is read off the counts of set sizes, not off sorted notes."""
    sizes = note_ids.select("note_id").join(pred.groupBy("note_id").agg(F.count("*").alias("n")), "note_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    hist = sizes.groupBy("n").agg(F.count("*").alias("k"))
    cum = F.sum("k").over(Window.orderBy("n"))
    hist = hist.withColumn("cum", cum).withColumn("notes", F.sum("k").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return hist.agg(
        F.sum("k").alias("n_notes"), F.sum(F.col("n") * F.col("k")).alias("n_codes"), r6(F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("mean_codes"),
        F.min(F.when(F.col("cum") >= F.expr("notes div 2") + 1, F.col("n"))).alias("median_codes"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("k"))), F.lit(0)).alias("n_empty"),
        r6(F.sum(F.least("n", F.lit(budget)) * F.col("k")) / (F.sum("k") * budget)).alias("budget_fill_rate"), r6(F.coalesce(F.sum(F.when(F.col("n") >= budget, F.col("k"))), F.lit(0)) / F.sum("k")).alias("share_at_budget"),
    )


def split_summary(notes: DataFrame, gold: DataFrame, split: Column) -> DataFrame:
    """Per split: notes, patients, instances, distinct codes, mean, largest and 95th percentile of codes a note."""
    n = notes.withColumn("split", split).where("split is not null")
    sizes = n.join(gold.groupBy("note_id").agg(F.count("*").alias("n")), "note_id", "left").na.fill(0, ["n"])
    a = sizes.groupBy("split").agg(F.count("*").alias("n_notes"), F.count_distinct("patient_id").alias("n_patients"), F.sum("n").alias("n_instances"), r6(F.avg("n")).alias("mean_codes"), F.max("n").alias("max_codes"), F.percentile("n", F.lit(0.95)).cast("long").alias("p95_codes"))
    c = n.join(gold, "note_id").groupBy("split").agg(F.count_distinct("code").alias("n_codes"))
    return a.join(c, "split", "left").na.fill(0, ["n_codes"])


def binned_frequency_export(bins: DataFrame) -> DataFrame:
    """Per bin: codes, occurrences, share, and lower nearest-rank quartiles of frequency."""
    w = Window.partitionBy("bin")
    at = F.row_number().over(w.orderBy("frequency", "code")) - 1
    b = bins.withColumn("at", at).withColumn("n", F.count("*").over(w)).withColumn("all", F.sum("frequency").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    q = lambda x: F.max(F.when(F.col("at") == F.floor(F.lit(x) * (F.col("n") - 1)), F.col("frequency")))
    return b.groupBy("bin").agg(F.count("*").alias("n_codes"), F.sum("frequency").alias("occurrences"), r6(F.sum("frequency") / F.first("all")).alias("share"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"))


def draw_key():
    return F.conv(F.substring(F.md5(F.col("note_id")), 1, 7), 16, 10).cast("long")


def resamples(notes: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``notes`` once for every resample b in which they are drawn, with their weight w.

    A resample of n notes with replacement draws each about Poisson(1) times; here the number comes from mixing seed, resample and
    the MD5 of the note in whole numbers, so that notes are drawn wherever they lie, a resample is a weighted sum, and any engine draws
    alike."""
    prime = F.lit(2147483647).cast("long")
    keyed = notes.withColumn("_k", draw_key())
    drawn = keyed.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    # A column a step, as each step reads the one before twice.
    drawn = drawn.withColumn("_x", (F.col("_k") + F.col("b").cast("long") * 1000003 + seed) % prime * 48271 % prime)
    drawn = drawn.withColumn("_y", F.col("_x").bitwiseXOR(F.shiftright("_x", 15)) * 69621 % prime)
    drawn = drawn.withColumn("_u", (F.col("_y").bitwiseXOR(F.shiftright("_y", 13)) * 16807 % prime + 0.5) / 2147483647.0)
    weight, edge, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        edge += p
        weight = weight + (F.col("_u") >= edge).cast("int")
        p /= k
    return drawn.where(F.col("_u") >= 0.36787944117144233).withColumn("w", weight).drop("_k", "_x", "_y", "_u")


def draws(keys, n_boot: int, seed: int):
    """The weights of ``resamples`` as an array, a row a key and a column a resample."""
    import numpy as np

    prime = 2147483647
    x = (keys.astype(np.int64)[:, None] + np.arange(n_boot, dtype=np.int64) * 1000003 + seed) % prime * 48271 % prime
    x = (x ^ (x >> 15)) * 69621 % prime
    u = ((x ^ (x >> 13)) * 16807 % prime + 0.5) / 2147483647.0
    weight, edge, p = np.zeros(u.shape, np.int8), 0.0, 0.36787944117144233
    for k in range(1, 9):
        weight += u >= edge + p
        edge += p
        p /= k
    return weight


#: Keys whose draws are held at once.
_AT_ONCE = 512


def drawn_sums(notes: DataFrame, names: list[str], n_boot: int, seed: int) -> DataFrame:
    """b, n and the weighted sums of columns over every resample that draws a note. Draws are made and summed inside a partition, which
    sends on one row a resample."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = np.zeros((len(names) + 1, n_boot))
        for batch in batches:
            x = np.stack([np.ones(batch.num_rows), *[batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))]])
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(keys), _AT_ONCE):
                total += x[:, at:at + _AT_ONCE] @ draws(keys[at:at + _AT_ONCE], n_boot, seed).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(range(n_boot), pa.int32()), *map(pa.array, total)], ["b", "n", *names])

    parts = notes.select(draw_key().alias("_k"), *names).mapInArrow(run, ", ".join(["b int", "n double", *[f"{c} double" for c in names]]))
    return parts.groupBy("b").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).where("n > 0")


def drawn_macro_f1(flagged: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """b, macro_f1 of flags over the codes with gold in the resample. A code's rows follow one another in a partition, which holds the
    sums of one code and sends on one row a resample."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        f1, known = np.zeros(n_boot), np.zeros(n_boot)
        code, sums = None, np.zeros((3, n_boot))

        def close():
            gold = sums[0] + sums[2]
            f1[gold > 0] += (2 * sums[0] / np.maximum(2 * sums[0] + sums[1] + sums[2], 1))[gold > 0]
            known[gold > 0] += 1
            sums[:] = 0

        for batch in batches:
            codes, kinds, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            for at in range(0, len(codes), _AT_ONCE):
                end = min(at + _AT_ONCE, len(codes))
                starts = [i for i in range(at, end) if i == at or codes[i] != codes[i - 1] or kinds[i] != kinds[i - 1]]
                for i, s in zip(starts, np.add.reduceat(draws(keys[at:end], n_boot, seed), np.array(starts) - at, axis=0, dtype=np.int64)):
                    if codes[i] != code:
                        close()
                        code = codes[i]
                    sums[kinds[i]] += s
        close()
        yield pa.RecordBatch.from_arrays([pa.array(range(n_boot), pa.int32()), pa.array(f1), pa.array(known)], ["b", "f1", "known"])

    kind = F.when(F.col("tp") == 1, 0).when(F.col("fp") == 1, 1).otherwise(2)
    rows = flagged.select("code", kind.alias("kind"), draw_key().alias("_k")).repartition("code").sortWithinPartitions("code", "kind")
    parts = rows.mapInArrow(run, "b int, f1 double, known double").groupBy("b").agg(F.sum("f1").alias("f1"), F.sum("known").alias("known"))
    return parts.where("known > 0").select("b", (F.col("f1") / F.col("known")).alias("macro_f1"))


def interval(samples: DataFrame, names: list[str], level: float = 0.95) -> DataFrame:
    """metric, mean, std, ci_lo, ci_hi of columns over the rows of ``samples``, one a resample."""
    each = samples.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("x")) for n in names])).alias("s")).select("s.*")
    lo = (1 - level) / 2
    return each.groupBy("metric").agg(
        r6(F.avg("x")).alias("mean"), r6(F.stddev_samp("x")).alias("std"), r6(F.percentile("x", F.lit(lo))).alias("ci_lo"), r6(F.percentile("x", F.lit(1 - lo))).alias("ci_hi"), F.count("*").alias("n_boot"))


def bootstrap_ci(note_ids: DataFrame, gold: DataFrame, pred: DataFrame, n_boot: int = 1000, seed: int = 12345, level: float = 0.95, macro: bool = True) -> DataFrame:
    """Percentile intervals of the headline set metrics over resampled notes: micro_precision, micro_recall, micro_f1, example_f1,
    exact_match, jaccard_mean and macro_f1, whose codes are those with gold in the resample."""
    s = per_note(note_ids, gold, pred)
    by = drawn_sums(s, ["tp", "fp", "fn", "exact", "jaccard", "example_f1"], n_boot, seed)
    m = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    out = by.select("b", m["precision"].alias("micro_precision"), m["recall"].alias("micro_recall"), m["f1"].alias("micro_f1"), (F.col("example_f1") / F.col("n")).alias("example_f1"), (F.col("exact") / F.col("n")).alias("exact_match"), (F.col("jaccard") / F.col("n")).alias("jaccard_mean"))
    names = ["micro_precision", "micro_recall", "micro_f1", "example_f1", "exact_match", "jaccard_mean"]
    if macro:
        f1 = drawn_macro_f1(flags(gold, pred).join(note_ids, "note_id", "left_semi"), n_boot, seed)
        out, names = out.join(f1, "b"), [*names, "macro_f1"]
    return interval(out, names, level)
