import numpy as np
import pytest

from quillmark.llm import mixing as M


def targets(sizes, share=1.5, cap=2.0):
    """Resharing by rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_apportion_is_highest_quotients():
    rng = np.random.default_rng(0)
    for _ in range(50):
        votes = rng.random(6) * 100
        most = rng.integers(1, 60, 6)
        seats = int(rng.integers(0, most.sum()))
        won = np.zeros(6, int)
        for _ in range(seats):
            q = np.where(won < most, votes / (2 * won + 1), -1)
            won[int(q.argmax())] += 1
        assert list(M.apportion(votes, seats, most)) == list(won)


def test_mix(docs, rows):
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    want = targets(sizes)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source_size"], [r["target"], 0])[1] += r["taken"]
    assert sorted(x[0] for x in by.values()) == pytest.approx(sorted(want.values()))
    for target, taken in by.values():
        assert abs(taken - target) <= max(0.05 * target, 70)
    key = lambda rs: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["taken"]) for r in rs)
    assert key(got) == key(M.mix(docs.repartition(5)).collect())


def test_documents_of_the_mix_have_the_words_taken(docs, empty):
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(r["text"].encode().split()) for r in out.collect())
    assert words == sum(r["taken"] for r in M.mix(docs).collect())
    assert M.mix(empty).count() == 0 and M.mix_documents(empty).count() == 0
    assert M.cut_words(" a  b\nc ", [(0, 3), (1, 2)]) == " a  b\nc \nb"


def test_blocks_are_equal_and_carry():
    """Brute force of one shard: every quota is blocks of one size, whatever the source, or the words wanted of a small source."""
    rng = np.random.default_rng(5)
    import pandas as pd

    for case in range(20):
        share = {"a": 1.7, "b": 0.4, "c": 2.0, None: 1.1}
        src = [list(share)[i] for i in rng.choice(4, 60, p=[0.6, 0.3, 0.05, 0.05])]
        pdf = pd.DataFrame({"key": rng.permutation(60), "source": src, "size": rng.integers(0, 90, 60), "share": [share[s] for s in src], "shard": 3})
        spans = M.mix_shard(pdf, 1, 16, 8, 2)
        names, totals = list(dict.fromkeys(src)), {s: int(pdf["size"][[x is s or x == s for x in src]].sum()) for s in share}
        taken = {s: sum(b - a for i, x in enumerate(src) if x == s for a, b in spans[i]) for s in names}
        held = [s for s in sorted(names, key=lambda s: "n" if s is None else f"s{s}") if totals[s]]
        votes = np.array([totals[s] * share[s] / 16 for s in held])
        won = np.zeros(len(held), int)
        for _ in range(int(round(votes.sum()))):
            q = np.where(won < np.array([2 * totals[s] // 16 for s in held]), votes / (2 * won + 1), -1)
            if q.max() > 0:
                won[int(q.argmax())] += 1
        for s, n, v in zip(held, won, votes):
            assert taken[s] == (16 * n if totals[s] >= 8 * 16 else min(round(16 * v), 2 * totals[s])), (case, s)
        for i, row in enumerate(spans):
            count = np.zeros(pdf["size"][i], int)
            for a, b in row:
                count[a:b] += 1
            assert count.max(initial=0) - count.min(initial=2) <= 1 or count.max(initial=0) <= 2


def test_clashing_names(spark):
    names = ["_size", "_key", "_source", "_share", "_shard", "row", "own", "first", "key", "target", "N_chars2"]
    docs = spark.createDataFrame([(i, "w " * 20, "s", *[i] * len(names)) for i in range(50)], ["doc_id", "text", "source", *names])
    out = M.mix_documents(docs)
    assert out.dtypes == docs.dtypes and all(r["_size"] == r["doc_id"] == r["row"] for r in out.collect())
    assert M.mix(docs).count() == 50


def test_small_sources_lie_together(spark):
    """A source of few words is not scattered over shards in which no block of it fits."""
    docs = spark.createDataFrame([(i, "w " * 30, "big") for i in range(6000)] + [(10_000 + i, "w " * 30, "small") for i in range(100)], "doc_id long, text string, source string")
    got = M.mix(docs, shard_rows=64).groupBy("source_size").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.02 * r["max(target)"] + 32


SQL = r"""
WITH RECURSIVE s AS (SELECT source, sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0))::DOUBLE AS size FROM documents GROUP BY source),
n AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 1.5 * sum(size) OVER () AS total FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY 2 * size / w, source NULLS LAST) AS i FROM n),
g AS (SELECT *, coalesce(sum(2 * size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM f),
l AS (SELECT (total - before) / rest AS level FROM g WHERE (total - before) / rest < 2 * size / w ORDER BY i LIMIT 1)
SELECT source, size::BIGINT AS source_size, least(2 * size, coalesce((SELECT level FROM l) * w, 2 * size)) AS target FROM n
"""


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_targets_are_those_of_sql(spark, sf):
    import duckdb

    d = f"/root/testdata/{sf}"
    want = duckdb.sql(SQL.replace("documents", f"'{d}/documents.parquet'")).fetchall()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = M.source_targets(docs.select("source", M.n_words(docs["text"]).alias("size"))).collect()
    assert {r["source"]: (r["source_size"], round(r["target"], 6)) for r in got} == {s: (n, round(t, 6)) for s, n, t in want}
    by = M.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 0.01 * r["max(target)"] + 64 for r in by)
