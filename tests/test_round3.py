"""Findings of round 3 that the driver's small tables do not show."""

from collections import Counter

from quillmark.operators import models as V
from quillmark.operators import pool as Q
from quillmark.plans import adapters as A
from quillmark.plans import drivers, knowledge, texts


def test_code_sets_are_not_carried_through_the_choice_of_notes(table, monkeypatch):
    """A billed set has thousands of codes where encounters are few: it goes to the note that is picked, not to all of its encounter's."""
    notes = table([(f"n{i:02}", i % 4 if i < 20 else None, i % 3, "word " * (120 if i % 4 else 90)) for i in range(24)], "note_id string, hadm_id int, subject_id int, note_text string")
    billing = table([(i, 0, c) for i in (1, 2, 3) for c in (" g0463", "99213", "j0585", "43235")][:-1] + [(0, 0, "43235"), (None, 0, "43235"), (1, 1, "J0585")], "hadm_id int, subject_id int, hcpcs_cd string")
    seen, pick = [], drivers.D.one_note_per_encounter
    monkeypatch.setattr(drivers.D, "one_note_per_encounter", lambda df, *rest: seen.append(df.columns) or pick(df, *rest))
    got = drivers.corpus_build(notes, billing)
    assert sorted((r["note_id"], r["hadm_id"], r["subject_id"], r["proc_codes"]) for r in got["corpus"].collect()) == [("n01", 1, 1, "43235|J0585"), ("n02", 2, 2, "43235|J0585")]
    assert [r["n"] for r in got["manifest"].orderBy("step").collect()] == [5, 4, 3, 3, 2]
    assert seen and all("codes" not in columns for columns in seen)


def test_splits_count_codes_without_reading_them(table):
    notes = table([(f"n{i}", i, i, "word " * 120) for i in range(10)], "note_id string, hadm_id int, subject_id int, note_text string")
    billing = table([(i, 0, c) for i in range(10) for c in ["43235", "G0463", "J0585", "j0585 ", "A0021"][: 2 + i % 4]], "hadm_id int, subject_id int, hcpcs_cd string")
    got = drivers.corpus_build(notes, billing)["splits"]
    assert {r["split"]: (r["n_notes"], r["n_patients"]) for r in got.collect()} == {"train": (7, 7), "val": (1, 1), "test": (2, 2)}
    assert sum(r["n_instances"] for r in got.collect()) == sum((1, 2, 2, 3)[i % 4] for i in range(10))
    assert "codes:array" not in got._jdf.queryExecution().executedPlan().toString()


def test_parts_that_share_a_code_are_fitted_and_scored_once(spark, table, tmp_path, monkeypatch):
    """Part numbers of six digits share codes, and every part is a row of the pool: alike ones are kept once, and all come out."""
    keys = [10000, *range(100000, 100009), 10001, 10002, 10003, 1, 3, 4, 6]
    d = str(tmp_path)
    table([(k, f"part no {k % 2}", "type", 7 if k % 3 else 5) for k in keys], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    table([(i,) for i in range(40)], "o_orderkey long").write.parquet(f"{d}/orders.parquet")
    lines = [(i % 40, keys[i * i % 13 if i % 4 else i % 17], i % 7, float(1 + i * 7 % 50), i % 11 / 100, "NRA"[i % 3]) for i in range(300)]
    table(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    kept, written = texts.kept, []
    monkeypatch.setattr(texts, "kept", lambda df: written.append(kept(df)) or written[-1])
    got = [tuple(r) for r in texts.verifier_scores(spark, d).select("note_id", "code", "score").collect()]
    pool = knowledge.pool_union_phi(spark, d)
    assert Counter(x[:2] for x in got) == Counter((r["note_id"], r["code"]) for r in pool.select("note_id", "code").collect())
    assert written[0].count() < len(got) / 2
    examples = Q.pair_examples(pool, A.gold(spark, d))
    one, many = (V.apply_verifier(V.train_verifier(x, max_iter=200), pool).collect() for x in (Q.weighed(Q.grouped_examples(written[0])), examples))
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 for a, b in zip(sorted(map(tuple, one)), sorted(map(tuple, many))))
    label = lambda df: Counter(tuple(r) for r in df.groupBy(*Q.FEATURES, "label").count().collect())
    assert label(examples) == Counter(tuple(r) for r in Q.grouped_examples(written[0]).collect())
