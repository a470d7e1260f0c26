"""python -m quillmark COMMAND: the engine over files. Each command reads CSV or Parquet and writes one table or report."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions.codes import normalize_codes
from .operators import retrieval as T
from .operators import rules as N
from .operators import sampling as P
from .operators import segment as S
from .operators.calibrate import threshold_decode
from .operators.set_metrics import frequency_bins
from .plans import drivers
from .session import session
from .sources import files as R
from .sources import sinks as K


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillmark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, **more):
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(f"--{o.rstrip('?')}", required=not o.endswith("?"))
        for o, default in more.items():
            c.add_argument(f"--{o}", type=type(default), default=default)

    command("evaluate", "gold", "pred", "bins?", "out")
    command("calibrate", "gold", "pred", "out")
    command("bm25-knn", "train", "notes", "out", top_k=25, threshold=0.10)
    command("check", "pred", "ptp", "aoc", "out", on="2025-01-01")
    command("decode", "pred", "ptp", "aoc", "out", on="2025-01-01", threshold=0.0)
    command("frequency", "gold", "out")
    command("normalize", "notes", "kb", "codes", "out")
    command("snippets", "notes", "out", max_words=180, overlap=60)
    command("scrub", "notes", "kb", "out")
    command("split", "notes", "out", patient="patient_id", test=0.2, val=0.1, seed=42)
    command("kb-check", "kb", "out")
    a = p.parse_args(argv)
    spark = session()
    save = lambda df: df.write.mode("overwrite").parquet(a.out)

    if a.command in ("evaluate", "calibrate"):
        gold, pred = R.read_gold(spark, a.gold), R.read_predictions(spark, a.pred)
        ids = R.read_csv(spark, a.gold)
        ids = ids.select(F.trim(R.resolve(ids.columns, R.ID_NAMES)).alias("note_id")).distinct()
        tables = drivers.harness(ids, gold, pred.select("note_id", "code"), pred, R.read_bins(spark, a.bins) if a.bins else None) if a.command == "evaluate" else drivers.calibrate(gold, pred)
        K.write_metrics(tables, a.out)
    elif a.command == "bm25-knn":
        train, notes = R.read_notes(spark, a.train), R.read_notes(spark, a.notes)
        top = T.bm25_topk(notes.select(F.col("note_id").alias("qid"), "note_text"), "qid", "note_text", T.bm25_index(train, "note_id", "note_text"), a.top_k)
        votes = T.knn_vote(top, R.code_sets(train, "proc_codes").withColumnRenamed("note_id", "id"), "qid", a.threshold)
        K.write_predictions(votes.withColumnRenamed("qid", "note_id"), a.out)
    elif a.command in ("check", "decode"):
        pred = R.read_predictions(spark, a.pred)
        ptp, (aoc1, aoc3) = R.active_ptp(R.read_ptp(spark, a.ptp), a.on), R.aoc_lookup(R.active_aoc(R.read_aoc(spark, a.aoc), a.on))
        save(N.check(pred.select("note_id").distinct(), pred.select("note_id", "code"), ptp, aoc1, aoc3) if a.command == "check" else N.constrained_decode(threshold_decode(pred, default=a.threshold).withColumn("pos", F.lit(1)), ptp, aoc1, a.threshold))
    elif a.command == "frequency":
        save(frequency_bins(R.read_gold(spark, a.gold)))
    elif a.command == "normalize":
        save(normalize_codes(R.read_notes(spark, a.notes), a.codes, R.read_kb(spark, a.kb)))
    elif a.command == "snippets":
        save(S.snippets(R.read_notes(spark, a.notes), "note_text", a.max_words, a.overlap))
    elif a.command == "scrub":
        words = [r["code"] for r in R.read_kb(spark, a.kb).select("code").collect()]  # a code list, of tens of thousands
        save(S.scrub(R.read_notes(spark, a.notes), "note_text", words))
    elif a.command == "split":
        save(P.patient_split(R.read_notes(spark, a.notes), a.test, a.val, a.seed, a.patient))
    elif a.command == "kb-check":
        save(R.kb_problems(R.read_csv(spark, a.kb)))


if __name__ == "__main__":
    main()
