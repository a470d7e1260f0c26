"""Codes, dates, rules, history, retrieval, pools."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from quillmark.functions import codes as K
from quillmark.functions import dates as Y
from quillmark.functions import parsing as J
from quillmark.operators import diagnose as D
from quillmark.operators import history as H
from quillmark.operators import pool as Q
from quillmark.operators import retrieval as T
from quillmark.operators import rules as N


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("token,code", [("52235BL", "52235"), ("27130A", "27130"), ("67036G25", "67036"), ("33405TR", "33405"), ("66999.11", "66999"), ("PBHANDEXT", None), ("ROBOT39", None), ("A44320", "A4432"), ("J0585", "J0585"), ("0479T", "0479T")])
def test_strip_modifier(spark, token, code):
    assert one(spark, K.strip_modifier, token) == code


def test_find_codes(spark):
    assert one(spark, K.find_codes, "did 43235, 43235-59 and j0585; not 123456") == ["43235", "J0585"]


@pytest.mark.parametrize("code,kind", [("43235", "CPT_I"), ("1234F", "CPT_II"), ("0479T", "CPT_III"), ("0001U", "PLA"), ("0001M", "MAAA"), ("J0585", "HCPCS"), ("0001A", "UNKNOWN")])
def test_category(spark, code, kind):
    assert one(spark, K.category, code) == kind


def test_dates(spark):
    assert one(spark, Y.deleted_date, "1-Apr-89") == date(1989, 4, 1)
    assert one(spark, Y.deleted_date, "31-Feb-20") is None
    assert one(spark, Y.julian_date, "2020366") == date(2020, 12, 31)
    assert one(spark, Y.julian_date, "2021366") == date(2022, 1, 1)
    assert one(spark, Y.compact_date, "*") is None


def test_answers(spark):
    assert one(spark, J.selected_codes, 'ok {"selected": ["43235", " j0585"]} bye') == ["43235", "J0585"]
    assert one(spark, J.selected_codes, "maybe 43235 or j0585") == ["43235", "J0585"]
    assert [one(spark, lambda c: J.confidence(c), v) for v in ("0.4", "7", "85", "x")] == [0.4, 0.7, 0.85, None]
    assert J.lenient_json('```json\n{"a": "}{"} trailing') == {"a": "}{"}
    assert [c["phrase"] for c in J.concepts('{"concepts": [{"search_phrases": ["Knee  scope", "knee scope"]}, "hip"]}')] == ["Knee scope", "hip"]


CODES = "note_id string, code string"


def test_rules(table):
    codes = table([("a", "1"), ("a", "2"), ("b", "9"), ("b", "3"), ("c", "9")], CODES)
    ptp = table([("1", "2", 0), ("2", "1", 1), ("1", "3", 0)], "col1 string, col2 string, ccmi int")
    got = {(r["note_id"], r["col1"], r["col2"], r["hard"]) for r in N.ptp_check(codes, ptp).collect()}
    assert got == {("a", "1", "2", True), ("a", "2", "1", False)}
    aoc1, aoc3 = table([("9", "3"), ("9", "4")], "addon string, primary string"), table([("9",)], "addon string")
    got = {(r["note_id"], r["kind"]) for r in N.aoc_check(codes, aoc1, aoc3).collect()}
    assert got == {("c", "type1"), ("b", "type3"), ("c", "type3")}
    ids = table([("a",), ("b",), ("c",), ("d",)], "note_id string")
    assert {r["note_id"]: r["hard_valid"] for r in N.check(ids, codes, ptp, aoc1, aoc3).collect()} == {"a": False, "b": True, "c": False, "d": True}


def test_constrained_decode_repairs_and_drops(table):
    ranking = table([("n", "Z1", 0.9, 1), ("n", "P1", 0.8, 2), ("n", "Z2", 0.7, 3), ("n", "C1", 0.6, 4)], "note_id string, code string, score double, pos long")
    ptp = table([("C1", "P1", 9)], "col1 string, col2 string, ccmi int")
    aoc1 = table([("Z1", "P1"), ("Z2", "P2")], "addon string, primary string")
    got = {r["code"]: r["repaired"] for r in N.constrained_decode(ranking, ptp, aoc1).collect()}
    assert got == {"P1": False, "Z1": True}


def test_history(table):
    ev = table([("1", "deleted", date(2020, 1, 1), "2"), ("2", "deleted", date(2021, 1, 1), "3, 4"), ("3", "new", date(2030, 1, 1), None), ("4", "new", date(2019, 1, 1), None), ("5", "revised", date(2019, 1, 1), None),
                ("6", "deleted", date(2020, 1, 1), None), ("6", "new", date(2020, 1, 1), None), ("7", "deleted", date(2019, 1, 1), "8"), ("8", "deleted", date(2019, 1, 1), "7")],
               "code string, change_type string, effective_date date, crosswalk_code string")
    ev = ev.select(F.lpad("code", 5, "1").alias("code"), "change_type", "effective_date", F.when(F.col("crosswalk_code").isNotNull(), F.array_join(F.transform(F.split("crosswalk_code", ", "), lambda x: F.lpad(x, 5, "1")), ", ")).alias("crosswalk_code"))
    asked = table([(f"1111{i}", date(2022, 6, 1)) for i in range(1, 10)] + [("11111", date(2019, 6, 1))], "code string, as_of date")
    kb = table([("11115",)], "code string")
    act = {(r["code"], r["as_of"].year): r["active"] for r in H.is_active(asked, ev, kb).collect()}
    assert act == {("11111", 2022): False, ("11112", 2022): False, ("11113", 2022): False, ("11114", 2022): True, ("11115", 2022): True, ("11116", 2022): True, ("11117", 2022): False, ("11118", 2022): False, ("11119", 2022): False, ("11111", 2019): True}
    sub = {r["code"]: r["substitute"] for r in H.crosswalk(asked, ev, kb).collect()}
    assert sub["11111"] == "11114" and sub["11112"] == "11114" and sub["11117"] is None and sub["11119"] is None


def test_reconcile(table):
    a = table([("1", "deleted", 2020, None), ("2", "new", 2020, None)], "code string, change_type string, year int, crosswalk_code string")
    b = table([("1", date(2020, 4, 1), "9"), ("3", date(2020, 7, 1), None)], "code string, deleted_date date, substitute_code string")
    got = {(r["code"], r["effective_date"], r["crosswalk_code"], r["source"]) for r in H.reconcile(a, b).collect()}
    assert got == {("1", date(2020, 4, 1), "9", "code_changes+deleted_codes"), ("2", date(2020, 1, 1), None, "code_changes"), ("3", date(2020, 7, 1), None, "deleted_codes")}


def test_bm25_counts_query_terms_with_multiplicity(table):
    docs = table([(1, "a b b"), (2, "a c"), (3, "größe x")], "id long, text string")
    q = table([(1, "b b c"), (2, "GRÖßE"), (3, "zzz")], "qid long, text string")
    got = {(r["qid"], r["id"]): r["rank"] for r in T.bm25_topk(q, "qid", "text", T.bm25_index(docs, "id", "text"), 2).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (2, 3): 0}


def test_diversify(table):
    n = table([("q", 1, 0), ("q", 2, 1), ("q", 3, 2)], "qid string, id long, rank int")
    s = table([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"])], "id long, codes array<string>")
    assert sorted(r["id"] for r in T.diversify(n, s, "qid", 3).collect()) == [1, 3]


def test_pool_features(table):
    dense = table([("n", 0, "11111", 1.0, 0), ("n", 0, "33333", 0.7071, 1)], "note_id string, snippet int, code string, score double, rank int")
    bm25 = table([("n", 0, "11111", 5.0), ("n", 0, "22222", 2.0)], "note_id string, snippet int, code string, score double")
    nbr = table([("n", "A", 0, "22222"), ("n", "A", 0, "33333"), ("n", "B", 1, "33333")], "note_id string, nbr_id string, rank int, code string")
    llm = table([("n", "33333", 3, 0.9), ("n", "99999", 1, 0.5)], "note_id string, code string, rank int, confidence double")
    kb = table([(c, "CPT", "some words") for c in ("11111", "22222", "33333", "44444")], "code string, system string, description string")
    p = {r["code"]: r for r in Q.assemble(dense, bm25, nbr, llm, kb, table([("n", 1)], "note_id string, n_snippets int"), Q.PoolConfig(dense_k=2, bm25_k=2, neighbour_k=2)).collect()}
    assert set(p) == {"11111", "22222", "33333"}
    r = p["33333"]
    assert (r["kb_dense_rank"], r["nbr_rank"], r["nbr_frac"], r["n_sources"], r["llm_rank"], r["kb_bm25_present"], r["kb_bm25_rank"]) == (0.5, 0.0, 1.0, 0.75, 3 / 50, 0.0, 1.0)


def test_siblings(table):
    gold = table([("n1", "29881"), ("n1", "99999"), ("n2", "43235")], CODES)
    pred = table([("n1", "29882"), ("n1", "99999"), ("n2", "43235"), ("n2", "70000")], CODES)
    fam = table([("29881", "F"), ("29882", "F"), ("43235", "G"), ("70000", "H")], "code string, family string")
    r = D.sibling_analysis(D.sibling_flags(gold, pred, fam)).first()
    assert (r["tp"], r["fp"], r["fn"], r["sibling_fp_rate"], r["substitution_fp_rate"], r["nearmiss_fn_rate"]) == (2, 2, 1, 0.5, 0.5, 1.0)
