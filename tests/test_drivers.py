import json

from pyspark.sql import functions as F

from quillmark import __main__ as cli
from quillmark.operators import diagnose as D
from quillmark.operators import filters as X
from quillmark.operators import sampling as P
from quillmark.operators import set_metrics as M
from quillmark.plans import drivers

C = "note_id string, code string"


def test_commands(spark, tmp_path):
    (tmp_path / "g.csv").write_text("note_id,note_text,proc_codes\na,alpha beta knee,11111|22222\nb,beta gamma,33333\nc,knee again,\n")
    (tmp_path / "p.csv").write_text("note_id,pred_codes,pred_scores\na,11111|44444,0.9|0.4\nb,33333,0.8\nz,1,1\n")
    cli.main(["evaluate", "--gold", str(tmp_path / "g.csv"), "--pred", str(tmp_path / "p.csv"), "--out", str(tmp_path / "m.json")])
    m = json.loads((tmp_path / "m.json").read_text())
    assert (m["set"]["tp"], m["set"]["fp"], m["set"]["fn"], m["set"]["n_notes"], m["outside"]["n_notes_outside"]) == (2, 1, 1, 3, 1)
    cli.main(["bm25-knn", "--train", str(tmp_path / "g.csv"), "--notes", str(tmp_path / "g.csv"), "--out", str(tmp_path / "knn")])
    got = {r["note_id"]: r["pred_codes"] for r in spark.read.csv(str(tmp_path / "knn"), header=True).collect()}
    assert got["b"].startswith("33333")


def test_drivers(table):
    ids = table([("a",), ("b",)], "note_id string")
    gold, pred = table([("a", "1"), ("b", "2")], C), table([("a", "1"), ("a", "3"), ("b", "4")], C)
    r = table([("a", "1", 0.9, 1), ("a", "3", 0.8, 2), ("b", "4", 0.9, 1)], C + ", score double, pos long")
    fam = table([("1", "F"), ("3", "F"), ("2", "G"), ("4", "G")], "code string, family string")
    bins = M.frequency_bins(gold)
    tiers = M.note_tiers(ids, gold, bins)
    assert drivers.harness(ids, gold, pred, r, bins, fam, n_boot=20)["set"].first()["tp"] == 1
    assert drivers.oracle(ids, gold, r, pred, bins)["top_gold"].first()["hits"] == 1
    s = drivers.siblings(gold, pred, fam, bins, tiers)
    assert s["headline"].first()["verdict"] == "targeted" and sum(x["fp"] for x in s["by_tier"].collect()) == 2
    c = drivers.calibrate(gold, r)
    assert c["default"].first()["thr"] == 0.81
    assert {x["k"]: x["recall"] for x in D.recall_buckets(gold, {"r": r.withColumn("rank", F.col("pos") - 1)}, gold, (1, 2)).collect()} == {1: 0.5, 2: 0.5}
    assert D.score_quantiles(gold, r).count() == 2


def test_filters(table):
    codes, kb = table([("a", "1"), ("a", "9"), ("b", "1")], C), table([("1",)], "code string")
    t = X.kb_tallies(codes, kb).first()
    assert (t["emitted"], t["dropped"], t["notes_hit"]) == (3, 1, 1)
    assert X.respond(codes, "candidates", kb, table([("a", "9")], C)).count() == 1
    n = table([("a", "old"), ("b", "keep")], "note_id string, note_text string")
    got = {r["note_id"]: r["note_text"] for r in X.section_override(n, table([("a", "new"), ("b", " ")], "note_id string, section_text string")).collect()}
    assert got == {"a": "new", "b": "keep"}
    led = table([(str(i), "c", f"cell{i % 3}") for i in range(90)], C + ", cell string")
    s = P.grounding_sample(led, "cell", 30, 8, 5).collect()
    assert len(s) == 30 and sum(r["co_rated"] for r in s) == 8
