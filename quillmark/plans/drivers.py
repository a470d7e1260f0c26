"""Composite evaluations: each returns its tables by name, for a report or a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as K
from ..functions.codes import category
from ..functions.text import n_words
from ..operators import calibrate as C
from ..operators import diagnose as D
from ..operators import rank_metrics as R
from ..operators import rules as N
from ..operators import sampling as P
from ..operators import set_metrics as M
from ..sources.scratch import kept


def harness(note_ids, gold, pred, ranking=None, bins=None, families=None, rules=None, n_boot: int = 0) -> dict[str, DataFrame]:
    """Set, per-code and per-category metrics; with bins, rankings, families or rules also theirs. rules: (ptp, aoc1, aoc3).
    Predictions of notes outside the universe are left out and counted."""
    inside = pred.join(note_ids, "note_id", "left_semi")
    out = {
        "set": M.set_metrics(note_ids, gold, inside), "per_code": M.per_code(gold, inside), "per_category": M.per_category(note_ids, gold, inside, category(F.col("code"))),
        "prediction_stats": M.prediction_stats(note_ids, inside), "outside": pred.join(note_ids, "note_id", "left_anti").agg(F.count_distinct("note_id").alias("n_notes_outside")),
    }
    if n_boot:
        out["bootstrap"] = M.bootstrap_ci(note_ids, gold, inside, n_boot)
    if bins is not None:
        out["per_bin"] = M.per_bin(gold, inside, bins)
    if rules is not None:
        out["constraints"] = N.constraint_metrics(N.check(note_ids, inside, *rules))
    if ranking is not None:
        out |= {"recall_at": R.recall_at(note_ids, gold, ranking), "map_ndcg": R.map_ndcg(gold, ranking), "burden": R.burden_at(R.burden_curve(note_ids, gold, ranking)), "auc_pr": R.average_precision(gold, ranking)}
        if bins is not None:
            out["per_bin_recall"] = R.per_bin_recall(gold, ranking, bins)
        if families is not None:
            out["family"] = R.family_mrr(gold, ranking, families)
    return out


def oracle(note_ids, gold, ranking, pred, bins, val_gold=None, val_ranking=None) -> dict[str, DataFrame]:
    """Where recall is lost: pool, order, threshold, set size; and the gap of a threshold carried over from validation."""
    sweep = C.threshold_sweep(gold, ranking)
    out = {"candidate_recall": D.candidate_recall(gold, ranking), "top_gold": D.top_gold(gold, ranking), "sweep": sweep, "best": C.best_threshold(sweep), "set_sizes": D.set_sizes(note_ids, gold, pred), "strata": D.strata(gold, ranking, pred, bins)}
    if val_gold is not None:
        carried = C.best_threshold(C.threshold_sweep(val_gold, val_ranking))
        out["carried_over"] = sweep.join(carried.select("thr", F.col("f1").alias("val_f1")), "thr").withColumn("gap", F.col("val_f1") - F.col("f1"))
    return out


def siblings(gold, pred, families, bins, tiers) -> dict[str, DataFrame]:
    flagged = D.sibling_flags(gold, pred, families)
    keyed = M.with_bin(flagged, bins).join(tiers.select("note_id", "tier"), "note_id", "left")
    rates = lambda by: keyed.groupBy(by).agg(F.sum("fp").alias("fp"), M.r6(M.ratio(F.sum("sibling"), F.sum("fp"))).alias("sibling_fp_rate"), M.r6(M.ratio(F.sum("substitution"), F.sum("fp"))).alias("substitution_fp_rate"))
    return {"headline": D.sibling_analysis(flagged), "by_bin": rates("bin"), "by_tier": rates("tier"), "families": D.confused_families(flagged)}


def candidate_union(gold, sources, bins, combos, base="kb", others=("nbr", "llm")) -> dict[str, DataFrame]:
    return {"recall": D.union_recall(gold, sources, combos), "recovery": D.recovery(gold, sources, base, others), "strata": D.recall_by_strata(gold, sources, bins)}


def calibrate(gold, ranking, default: float | None = None) -> dict[str, DataFrame]:
    """The sweep over ranked notes, its best threshold, and codes that gain by one of their own."""
    sweep = C.threshold_sweep(gold, ranking, universe="ranking")
    best = C.best_threshold(sweep)
    thr = default if default is not None else best.first()["thr"]
    return {"sweep": sweep, "default": best, "per_code": C.per_code_thresholds(gold, ranking, thr)}


def audit_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two audits by bin."""
    cols = [c for c in before.columns if c not in ("bin", "n")]
    b = before.select("bin", *[F.col(c).alias(f"_{c}") for c in cols])
    return after.join(b, "bin").select("bin", "n", *[M.r6(F.col(c) - F.col(f"_{c}")).alias(f"delta_{c}") for c in cols])


def corpus_build(notes: DataFrame, billing: DataFrame, code_filter: str = "procedural", min_tokens: int = 100, note_select: str = "first", val: float = 0.1, test: float = 0.2, seed: int = 42) -> dict[str, DataFrame]:
    """A benchmark corpus of discharge notes (note_id, hadm_id, subject_id, note_text) and billed codes (hadm_id, subject_id, hcpcs_cd).

    Encounters with a surgical code keep the codes that the filter lets pass; each has one note of at least min_tokens words; notes
    are split by patient. corpus: note_id, hadm_id, subject_id, note_text, proc_codes, split. manifest: what each step leaves, a row a
    step. frequency: bins of the training codes.

    Notes are picked, measured and split by their ids, and texts are joined to those; ids in passing are written, so that where they
    are few no text is shuffled. Code sets, which grow with the billing, are joined last, to the notes that are left."""
    code = F.col("code")
    b = billing.select("hadm_id", "subject_id", F.upper(F.trim("hcpcs_cd")).alias("code")).where("code <> ''")
    held = b.where("hadm_id is not null").select("hadm_id", "code").distinct()
    passed = F.when(K.passes_filter(code, code_filter), code)
    sets = held.groupBy("hadm_id").agg(F.max(K.is_surgical(code)).alias("_surgical"), F.sort_array(F.collect_list(passed)).alias("codes"), F.count(passed).alias("n_codes"))
    sets = kept(sets.where("_surgical and n_codes > 0").drop("_surgical"))
    slim = notes.select("note_id", "hadm_id", "subject_id", F.length("note_text").alias("_length"))
    one = kept(D.one_note_per_encounter(slim.join(sets.select("hadm_id"), "hadm_id", "left_semi"), note_select, F.col("_length")).drop("_length"))
    texts = notes.select(F.col("note_id").alias("_n"), F.col("hadm_id").alias("_h"), "note_text")

    def with_text(ids: DataFrame) -> DataFrame:
        return ids.join(texts, (F.col("hadm_id") == F.col("_h")) & F.col("note_id").eqNullSafe(F.col("_n"))).drop("_n", "_h").dropDuplicates(["hadm_id"])

    long_ = kept(with_text(one).where(n_words(F.col("note_text")) >= min_tokens).drop("note_text"))
    split = kept(P.patient_split(long_, test, val, seed, "subject_id").select("note_id", "hadm_id", "subject_id", "split"))
    surgical = b.where(K.is_surgical(code)).select("hadm_id").distinct()
    steps = {"billed encounters": b.select("hadm_id").distinct(), "with a surgical code": surgical, "with codes kept": sets, "with a note": one, "long enough": long_}
    manifest = None
    for i, (name, df) in enumerate(steps.items()):
        row = df.agg(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count("*").alias("n"))
        manifest = row if manifest is None else manifest.unionByName(row)
    train = split.where("split = 'train'").join(sets, "hadm_id").select("note_id", F.explode("codes").alias("code"))
    corpus = with_text(split).join(sets, "hadm_id").select("note_id", "hadm_id", "subject_id", "note_text", F.array_join("codes", "|").alias("proc_codes"), "split")
    return {"corpus": corpus, "manifest": manifest, "frequency": M.frequency_bins(train), "splits": split.join(sets.select("hadm_id", "n_codes"), "hadm_id").groupBy("split").agg(F.count("*").alias("n_notes"), F.count_distinct("subject_id").alias("n_patients"), F.sum("n_codes").alias("n_instances"))}
