"""Segmentation, scrubbing, collation, sampling, files."""

import json

import pytest
from pyspark.sql import functions as F

from quillmark.operators import collate as L
from quillmark.operators import models as V
from quillmark.operators import sampling as P
from quillmark.operators import segment as S
from quillmark.sources import files as R
from quillmark.sources import sinks as O


def test_scrubber():
    s = S.Scrubber(["43235", "0479T", "15734", "J0585", "MA", "ME", None])
    assert s.codes == {"43235", "0479T", "15734", "J0585"}
    m = S.MASK
    for text, want in {
        "did 43235LT x2 today": f"did {m} x2 today", "15734x2, CPT15734, eye43235": f"{m}, {m}, {m}", "43235MILF 43235LONGER": f"{m} 43235LONGER",
        "43235G25 43235G25BIL 43235 35": f"{m} {m} {m} 35", "j0585 aj0585": f"{m} {m}", "0479t25 toolong43235": f"{m} toolong43235", "Name MAIN female": "Name MAIN female",
        "1432350 and 4323 43235é": f"1432350 and 4323 {m}é", "": "",
    }.items():
        assert s(text)[0] == want, text
    assert s("PROC 43235 - PR EGD DIAGNOSTIC  next") == (f"PROC {m}  next", 1, 1)
    assert s("43235-pr x\n43235 - PR") == (f"{m}\n{m} - PR", 2, 1)
    once = s("A 43235 - PR X\nB0479t")[0]
    assert s(once) == (once, 0, 0)


def test_shared_prefixes_are_the_alternation():
    import re

    words = ["12345", "12399", "9", "99", "a+b"]
    p = re.compile(S.shared_prefix_pattern(words))
    assert all(p.fullmatch(w) for w in words) and not any(p.fullmatch(w) for w in ("123", "12390", "999", "aab"))
    assert p.match("99")[0] == "99" and S.shared_prefix_pattern([]) == ""


def test_masked_codes(table):
    x = table([("see 43235, x43235 and j0585",), (None,)], "t string")
    assert [r[0] for r in S.mask_codes(x, "t", ["43235", "J0585"]).collect()] == ["see [PROC_CODE], x43235 and [PROC_CODE]", None]
    assert S.mask_codes(x, "t", ["43235"], remove=True).first()[0] == "see , x43235 and j0585"


def test_headers():
    assert S.header_rule("a", " DX  of : ").pattern == r"\bDX\s+of\s*:\s*" and S.header_rule("a", "(x)").pattern == r"\(x\)\s*"
    rules = (S.header_rule("find", "Findings:"), S.header_rule("proc", "Procedure in detail"), S.header_rule("plan", "PLAN"))
    got = S.sections("intro\rFindings : all\t well\n\n\nProcedure in  detail cut\nFindings:\nmore\nPLAN\nPLAN: rest", rules)
    # The blanks behind a lone header go with it, so the first PLAN is followed by text; the second one by a colon.
    assert got == {"preamble": "intro", "find": "Findings : all well\n\nFindings: more\nPLAN", "proc": "Procedure in detail cut", "plan": "PLAN : rest"}
    assert S.sections("the findings: were", rules) == {"body": "the findings: were"}  # case counts
    assert S.sections("no PLAN here", rules) == {"body": "no PLAN here"} and S.sections(" \n", rules) == {}
    per_line = S.sections("x\nA 1\ny\nB 2", (S.Rule("l", r"^[AB] \d"),))
    assert per_line == {"preamble": "x", "l": "A 1 y"}
    tax = S.Taxonomy(("p", "f", "l"), "p", "f")
    assert S.rules_of({"patterns": [{"section": "l", "regex": "x"}, {"section": "", "regex": "y"}]}, tax) == [S.Rule("l", "x")]
    for bad in ({"patterns": []}, {"patterns": [{"section": "zz", "regex": "x"}]}):
        with pytest.raises(ValueError):
            S.rules_of(bad, tax)
    with pytest.raises(ValueError):
        S.Taxonomy(("p",), "p", "f")


def test_sentences():
    assert S.sentences("One two.  Three<br/>four five! Seen by dr. No at 6 A.M. Then; Seven: a\\nB. [x] 9") == [
        "One two.", "Three four five!", "Seen by dr. No at 6 A.M. Then;", "Seven: a B.", "[x] 9"]
    assert S.sentences(None) == S.sentences(" <p> ") == []
    assert [len(x.split()) for x in S.sentences("w " * 301)] == [40] * 7 + [21] and len(S.sentences("w " * 300)) == 1


def test_windows():
    # Two sentences of 100: the step back ends at the budget, and never at the window's own first sentence.
    assert S.windows([100, 100, 100]) == [(0, 0, 100), (1, 1, 100), (2, 2, 100)]
    assert S.windows([50, 50, 50, 50]) == [(0, 2, 150), (1, 3, 150)]
    assert S.windows([30] * 8, 120, 60) == [(0, 3, 120), (2, 5, 120), (4, 7, 120)]
    assert S.windows([200, 5, 5], 180, 60) == [(0, 0, 200), (1, 2, 10)] and S.windows([]) == []
    assert S.windows([180, 0, 1]) == [(0, 0, 180), (1, 2, 1)]


def test_snippets(spark):
    n = spark.createDataFrame([(1, "One two. Three four. Five six.", 9), (2, None, 9), (3, " ", 9)], "note_id long, text string, n_words int")
    got = S.snippets(n, max_words=4, overlap=1).orderBy("snippet_index").collect()
    assert [(r["note_id"], r["start_sentence"], r["end_sentence"], r["n_words"], r["snippet_text"]) for r in got] == [(1, 0, 1, 4, "One two. Three four."), (1, 1, 2, 4, "Three four. Five six.")]
    w = spark.createDataFrame([("a", "43235, zz", "Did 43235 today."), ("b", None, "And 43235 again."), ("c", "", " ")], "note_id string, CPT_CODES string, plan string")
    long = {r["note_id"]: r for r in S.section_snippets(w, "plan").collect()}
    assert set(long) == {"a", "b"} and long["a"]["snippet_text"] == "Did [PROC_CODE] today." and long["b"]["snippet_id"] == "b_plan_000" and long["a"]["proc_codes"] == "43235"


def test_collation(table):
    x = table([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (4.0, 4.0)], "a double, b double")
    assert L.concordance(x, "a", "b").first()["concordant"] == 5
    assert L.spearman(x, "a", "b").first()["rho"] == 0.9487
    assert L.floor_ranks({"x": 0.5, "y": 0.495, "z": 0.48}, 0.01) == {"x": 1.5, "y": 1.5, "z": 3.0}
    m = table([("m.a.f1", 1.0), ("m.b.f1", 2.0), ("m.b.p.q", 3.0)], "path string, value double")
    assert {r["path"]: r["status"] for r in L.govern(m, ["m.b.p"], {"m.*": "c"}).collect()} == {"m.a.f1": "caveat", "m.b.f1": "caveat", "m.b.p.q": "suppressed"}
    kept, dropped = L.guard({"a": 1, "text": "x", "l": [1, "a\nb"], "d": {"s": "y" * 300}})
    assert kept == {"a": 1, "l": [1], "d": {}} and dropped == ["text", "l[]", "d.s"]


def test_allocations():
    assert P.proportional({"a": 80, "b": 15, "c": 5}, 20) == {"a": 16, "b": 3, "c": 1}
    f = P.floored({"a": 100, "b": 3, "c": 50}, 40, 8)
    assert sum(f.values()) == 40 and f["b"] == 3 and min(f["a"], f["c"]) >= 8


def test_patient_split(table):
    n = table([(str(i), i % 100) for i in range(500)], "note_id string, patient_id long")
    s = P.patient_split(n)
    by = {r["split"]: r["k"] for r in s.groupBy("split").agg(F.count_distinct("patient_id").alias("k")).collect()}
    assert by == {"test": 20, "val": 10, "train": 70} and s.count() == 500


def test_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text(' note_id ,note_text,proc_codes\n 1,"a ""q""\nb",43235|x\n2,,\n1,z,J0585\n')
    n = R.read_notes(spark, str(tmp_path / "n.csv"))
    assert [(r["note_id"], r["note_text"]) for r in n.orderBy("note_id", "note_text").collect()] == [("1", 'a "q"\nb'), ("1", "z"), ("2", "")]
    assert [(r["note_id"], r["code"]) for r in R.read_gold(spark, str(tmp_path / "n.csv")).collect()] == [("1", "J0585")]
    (tmp_path / "ptp.txt").write_text("head\n" * 6 + "1\t2\t\t20200101\t*\t1\twhy\n3\t4\t\t20200101\t20201231\tx\twhy\n")
    p = R.read_ptp(spark, str(tmp_path / "ptp.txt")).collect()
    assert [(r["col1"], r["ccmi"], r["deletion"]) for r in p] == [("1", 1, None)]
    (tmp_path / "mue.csv").write_text('"some preamble"\nCode,MUE,MAI,Why\n43235,1,2 Date of Service,x\nABC,2,1,y\n')
    assert [(r["code"], r["max_units"], r["mai"]) for r in R.read_mue(spark, str(tmp_path / "mue.csv")).collect()] == [("43235", 1, 2)]
    (tmp_path / "p.csv").write_text("note_id,pred_codes,pred_scores\na,1|2,0.5|0.25\nb,1|2,0.5\n")
    got = R.read_predictions(spark, str(tmp_path / "p.csv")).orderBy("note_id", "pos").collect()
    assert [(r["note_id"], r["code"], r["score"]) for r in got] == [("a", "1", 0.5), ("a", "2", 0.25), ("b", "1", 1.0), ("b", "2", 1.0)]
    O.write_metrics({"m": spark.createDataFrame([(1, 2.0)], "a int, b double")}, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"m": {"a": 1, "b": 2.0}}


def test_kb_contract(table):
    kb = table([("CPT", "1", "x"), ("CPT", "1", "y"), ("ODD", "a", "")], "code_system string, code string, code_description string")
    assert {r["problem"] for r in R.kb_problems(kb).collect()} == {"duplicate code", "lowercase code", "blank description", "unknown system"}


def test_echo_client(table):
    n = table([("1", "t"), ("2", "u")], "note_id string, note_text string")
    assert {r["response"] for r in V.chat(n, "p", lambda: V.Echo(["43235"])).collect()} == {'Sure. {"selected": ["43235"]}'}
    t, e, c = V.fit_prompt("w " * 1000, ["x " * 300] * 3, ["y"] * 15, 900)
    assert len(t.split()) < 1000 and len(e) == 1 and len(c) == 10


def test_stream_equals_batch(spark, tmp_path):
    from quillmark.streaming import code_events as E

    rows = [(i, f"2024-01-{1 + i % 5:02d} 0{i % 9}:00:00", i % 7, "view" if i % 2 else "error", float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = E.windowed_counts(E.read_events(spark, str(tmp_path / "in"), 10)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("w")) == key(E.windowed_counts(df))
    E.upsert_latest(spark, E.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    last = max(int(p.name[2:]) for p in (tmp_path / "out").glob("v=*"))
    got = {r["user_id"]: r["m"]["event_id"] for r in spark.read.parquet(str(tmp_path / f"out/v={last}")).collect()}
    want = {r["user_id"]: r["m"]["event_id"] for r in df.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).collect()}
    assert got == want
