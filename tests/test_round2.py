"""Findings of round 2 that the driver's small tables do not show."""

from pyspark.sql import functions as F

from quillmark.functions.text import upper_each
from quillmark.operators import retrieval as T
from quillmark.operators import rules as N
from quillmark.operators import set_metrics as M
from quillmark.plans import drivers


def test_upper_case_keeps_the_length_of_a_header(table):
    got = [r["u"] for r in table([("beß",), ("ﬁx",), ("ᾳ",), ("plain é",), (None,)], "t string").select(upper_each(F.col("t")).alias("u")).collect()]
    assert got == ["BEẞ", "ﬁX", "ᾼ", "PLAIN É", None]


def test_sums_of_draws_are_those_of_resamples(table):
    notes = table([(f"n{i}", float(i % 7), i % 3) for i in range(700)], "note_id string, x double, y int")
    want = {r["b"]: (r["n"], r["x"], r["y"]) for r in M.resamples(notes, 40, 5).groupBy("b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y")).collect()}
    assert {r["b"]: (r["n"], r["x"], r["y"]) for r in M.drawn_sums(notes, ["x", "y"], 40, 5).collect()} == want


def test_macro_of_draws_is_that_of_resamples(table):
    flagged = table([(f"n{i}", f"c{i * i % 9}", int(i % 3 == 0), int(i % 3 == 1), int(i % 3 == 2)) for i in range(1200)], "note_id string, code string, tp int, fp int, fn int")
    by = M.resamples(flagged, 30, 5).groupBy("b", "code").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("tp", "fp", "fn")]).where("tp + fn > 0")
    want = {r["b"]: r["f"] for r in by.groupBy("b").agg(F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f")).collect()}
    got = {r["b"]: r["macro_f1"] for r in M.drawn_macro_f1(flagged, 30, 5).collect()}
    assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-12 for b in want)


def test_corpus_texts_are_joined_to_picked_ids(table):
    notes = table([(f"n{i}", i % 4, i % 2, "word " * 120) for i in range(12)] + [("n0", 0, 0, "word " * 120)], "note_id string, hadm_id int, subject_id int, note_text string")
    billing = table([(i, 0, "43235") for i in range(4)], "hadm_id int, subject_id int, hcpcs_cd string")
    corpus = drivers.corpus_build(notes, billing)["corpus"]
    plan = corpus._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan
    assert sorted(r["note_id"] for r in corpus.collect()) == ["n0", "n1", "n10", "n11"]


def test_rows_of_a_pair_all_count_where_every_one_is_asked(table):
    codes, ptp = table([("a", "1"), ("a", "2")], "note_id string, code string"), table([("1", "2", 1), ("1", "2", 9), ("2", "2", 0)], "col1 string, col2 string, ccmi int")
    got = sorted((r["col1"], r["col2"], r["hard"]) for r in N.ptp_check(codes, ptp, every=True).collect())
    assert got == [("1", "2", False), ("1", "2", True), ("2", "2", True)]
    assert [(r["col1"], r["col2"], r["hard"]) for r in N.ptp_check(codes, ptp).collect()] == [("1", "2", False)]


def test_an_addon_named_as_its_own_primary_holds_it(table):
    codes, aoc1 = table([("a", "1"), ("b", "2")], "note_id string, code string"), table([("1", "1"), ("2", "3")], "addon string, primary string")
    assert [r["note_id"] for r in N.aoc_check(codes, aoc1, aoc1.limit(0).select("addon")).collect()] == ["b"]


def test_codes_of_the_same_neighbours_tie(table):
    """Sums of the same scores are the same, in whatever order rows meet, so that the code decides."""
    import random

    rng = random.Random(4)
    near = [(q, 1000 * q + i, rng.uniform(1000, 9000), i) for q in range(300) for i in range(3)]
    sets = [(i, sorted(["a", "k", "z", f"own{i}"])) for _, i, _, _ in near]
    kb = table([("a",), ("k",), ("z",)], "code string")
    neighbours = table(near, "q long, id long, score double, rank int").repartition(7)
    got = T.exemplar_candidates(neighbours, table(sets, "id long, codes array<string>").repartition(5), "q", kb).collect()
    by = {}
    for r in got:
        by.setdefault(r["q"], []).append((r["rank"], r["code"], r["vote"]))
    want = {}
    for q, _, s, _ in sorted(near, key=lambda x: -x[2]):
        want[q] = want.get(q, 0.0) + s
    assert all(sorted(rows) == [(i, c, want[q]) for i, c in enumerate("akz")] for q, rows in by.items()) and len(by) == 300


def test_exact_sum_does_not_depend_on_order(table):
    import math
    import random

    rng = random.Random(5)
    x = [rng.uniform(0.1, 40) for _ in range(400)]
    for seed in range(6):
        random.Random(seed).shuffle(x)
        got = table([(v,) for v in x], "x double").repartition(1 + seed).agg(T.exact_sum(F.col("x")).alias("s")).first()["s"]
        assert abs(got - math.fsum(x)) <= 1e-12
        assert seed == 0 or got == first
        first = got


def test_edits_are_counted_without_being_made(table):
    """Rows that share a code multiply its edits: a note's totals come from counts at the ends of its rows."""
    import random

    import pytest

    rng = random.Random(6)
    rows = [(f"c{rng.randrange(9)}", rng.randrange(4), rng.randrange(4), rng.randrange(3)) for _ in range(160)] + [("once", 2, 2, 1), ("soft", 3, 3, 2)]
    ccmi = {(a, b): (0, 1, 9)[(a * b) % 3] for a in range(3) for b in range(3)}
    held = {f"n{i}": rng.sample([f"c{j}" for j in range(9)], i % 6) for i in range(20)} | {"alone": ["once"], "other": ["soft", "unknown"]}
    codes = table([(n, c) for n, cs in held.items() for c in cs], "note_id string, code string")
    ptp = N.Derived(lambda pairs: pytest.fail("edits are made"), ends=N.Ends(table(rows, "code string, first long, second long, kind long"), ccmi))
    none = table([], "addon string, primary string")
    got = {r["note_id"]: (r["ptp_hard"], r["ptp_contingent"]) for r in N.check(table([(n,) for n in held], "note_id string"), codes, ptp, none, none.select("addon"), every=True).collect()}
    for n, cs in held.items():
        met = [ccmi[x[3], y[3]] for i, x in enumerate(rows) for j, y in enumerate(rows) if i != j and x[0] in cs and y[0] in cs and x[1] == y[2]]
        assert got[n] == (sum(c in (0, 9) for c in met), met.count(1)), n
    assert max(h for h, _ in got.values()) > 1000 and got["alone"] == got["other"] == (0, 0)


def test_limits_of_a_code_are_counted_in_one_row(table):
    units = table([("n", "a", 5.0), ("n", "b", 2.0), ("m", "a", 3.0), ("o", "c", 9.0), (None, "a", 9.0)], "note_id string, code string, units double")
    mue = table([("a", 1), ("a", 3), ("a", 4), ("a", 4), ("b", 2), ("b", None), ("d", 1)], "code string, max_units long")
    for every in (True, False):
        want = {(r["note_id"], r["count"]) for r in N.mue_check(units, mue, every).groupBy("note_id").count().collect()}
        assert {(r["note_id"], r["mue"]) for r in N.mue_counts(units, mue, every).collect()} == want


def test_an_addon_that_holds_its_own_primary_is_not_looked_up(table):
    codes = table([("a", "1"), ("b", "2"), ("c", "2"), ("c", "3")], "note_id string, code string")
    asked, rules = [], table([("1", "1"), ("2", "3")], "addon string, primary string")
    derived = N.Derived(lambda pairs: asked.append(pairs) or pairs.join(rules, ["addon", "primary"]), rules.select(F.col("addon").alias("code")).distinct())
    assert [r["note_id"] for r in N.aoc_check(codes, derived, rules.limit(0).select("addon")).collect()] == ["b"]
    assert {r["addon"] for r in asked[-1].collect()} == {"2"}
