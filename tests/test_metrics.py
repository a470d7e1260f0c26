"""Hand-computed metrics."""

import pytest

from quillmark.operators import calibrate as C
from quillmark.operators import rank_metrics as R
from quillmark.operators import set_metrics as M


@pytest.fixture
def small(table):
    ids = table([("A",), ("B",)], "note_id string")
    ranking = table([("A", "X", 0.9, 1), ("A", "Z", 0.8, 2), ("A", "Y", 0.7, 3), ("A", "W", 0.6, 4), ("B", "Q", 0.9, 1), ("B", "P", 0.5, 2)], "note_id string, code string, score double, pos long")
    gold = table([("A", "X"), ("A", "Y"), ("B", "P")], "note_id string, code string")
    return ids, gold, ranking


def test_recall_at_budgets(small):
    got = {r["b"]: r for r in R.recall_at(*small, budgets=(1, 2, 3)).collect()}
    assert [round(got[b]["recall"], 4) for b in (1, 2, 3)] == [0.3333, 0.6667, 1.0]
    assert got[3]["precision"] == pytest.approx(0.6)
    assert got[3]["shown_mean"] == 2.5 and got[3]["pool_ceiling"] == 1


def test_burden(small):
    got = {r["target"]: r["burden"] for r in R.burden_at(R.burden_curve(*small)).collect()}
    assert got == {0.8: pytest.approx(2.2), 0.9: pytest.approx(2.35)}


def test_ties_keep_the_order_given(table):
    r = table([("A", "a", 0.1, 1), ("A", "b", 0.9, 2), ("A", "c", 0.9, 3)], "note_id string, code string, score double, pos long")
    assert [x["code"] for x in R.positions(r).orderBy("r").collect()] == ["b", "c", "a"]


def test_family_mrr(small, table):
    fam = table([("X", "F1"), ("Z", "F1"), ("Y", "F2"), ("W", "F2"), ("P", "F3"), ("Q", "F3")], "code string, family string")
    got = R.family_mrr(small[1], small[2], fam, budgets=(1, 2)).first()
    assert got["family_mrr"] == pytest.approx((1 + 1 + 0.5) / 3, abs=1e-6)


def test_empty_sets_agree(table):
    ids = table([("a",), ("b",)], "note_id string")
    gold, pred = table([("a", "1")], "note_id string, code string"), table([("a", "1")], "note_id string, code string")
    m = M.set_metrics(ids, gold, pred).first()
    assert m["exact_match"] == 1 and m["mean_jaccard"] == 1 and m["n_notes"] == 2


def test_no_prediction_at_all(table):
    ids = table([("a",)], "note_id string")
    empty = table([], "note_id string, code string")
    m = M.set_metrics(ids, table([("a", "1")], "note_id string, code string"), empty).first()
    assert (m["tp"], m["fp"], m["fn"], m["micro_f1"]) == (0, 0, 1, 0)


def test_frequency_bins(table):
    g = table([("n%d" % i, "A") for i in range(8)] + [("n1", "B"), ("n2", "C")], "note_id string, code string")
    got = {r["code"]: (r["frequency"], r["rank"], r["bin"]) for r in M.frequency_bins(g).collect()}
    assert got == {"A": (8, 1, "head"), "B": (1, 2, "torso"), "C": (1, 3, "tail")}


def test_sweep_keeps_the_lowest_of_the_best(small):
    s = C.threshold_sweep(small[1], small[2])
    by = {r["thr"]: (r["tp"], r["fp"], r["fn"]) for r in s.collect()}
    assert by[0.5] == (3, 3, 0) and by[0.7] == (2, 2, 1) and by[0.9] == (1, 1, 2)
    assert C.best_threshold(s).first()["thr"] == 0.05


def test_threshold_decode_fills_up(small):
    got = C.threshold_decode(small[2], default=0.95, min_predictions=1)
    assert sorted((r["note_id"], r["code"]) for r in got.collect()) == [("A", "X"), ("B", "Q")]


def test_bootstrap(table):
    """The intervals hold the plain values, and metrics of notes that are all alike do not vary."""
    ids = table([(str(i),) for i in range(60)], "note_id string")
    gold = table([(str(i), c) for i in range(60) for c in "ab"], "note_id string, code string")
    pred = table([(str(i), "a") for i in range(60)] + [(str(i), "b") for i in range(0, 60, 3)], "note_id string, code string")
    got = {r["metric"]: r for r in M.bootstrap_ci(ids, gold, pred, 200).collect()}
    assert set(got) == {"micro_precision", "micro_recall", "micro_f1", "example_f1", "exact_match", "jaccard_mean", "macro_f1"}
    assert got["micro_precision"]["std"] == 0 and got["micro_precision"]["mean"] == 1
    assert got["micro_recall"]["ci_lo"] < 2 / 3 < got["micro_recall"]["ci_hi"] and got["exact_match"]["ci_lo"] < 1 / 3 < got["exact_match"]["ci_hi"]
    rank = pred.selectExpr("note_id", "code", "1.0D as score", "cast(if(code = 'a', 1, 2) as long) as pos")
    r = {x["metric"]: x for x in R.bootstrap_ci(ids, gold, rank, (1, 2), 200).collect()}
    assert r["recall_at_1"]["mean"] == 0.5 and r["coverage_at_1"]["mean"] == 0 and abs(r["coverage_at_2"]["mean"] - 1 / 3) < 0.03
