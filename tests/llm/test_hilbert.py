import itertools
import zlib

import numpy as np
import pytest

from quillmark.llm import hilbert as H


@pytest.mark.parametrize("d,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    h = H.hilbert_index(cells, bits)
    assert sorted(h) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(1) == 1).all()


def test_shards(docs, rows, empty):
    got = H.hilbert_shards(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(24)]
    assert set(by) <= set(range(24)) and max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in got)
    copies = [i for i, r in enumerate(order) if r["text_crc32"] == zlib.crc32(rows[3][1].encode())]
    assert copies == list(range(copies[0], copies[0] + 8))
    assert H.hilbert_shards(empty).count() == 0


def test_files(docs, tmp_path):
    few = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).drop("shard")
    H.write_shards(few, H.hilbert_shards(few, 4), str(tmp_path / "out"))
    assert few.sparkSession.read.parquet(str(tmp_path / "out")).count() == few.count()


def test_files_prune_by_every_dimension(spark, tmp_path):
    """A file of a shard covers a small box: a value of any dimension is in few of them, where rows dealt by id are in all."""
    import pyarrow.parquet as pq

    rows = [(i, "w" * (1 + i * 7919 % 4000), f"s{i * 31 % 16}", f"l{i * 17 % 8}", "x") for i in range(6400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard string")
    H.write_shards(docs, H.hilbert_shards(docs, 32), str(tmp_path / "out"))
    held = {}
    for f in (tmp_path / "out").rglob("*.parquet"):
        t = pq.read_table(f, partitioning=None)
        assert t.schema.names == docs.columns
        held.setdefault(f.parent.name, []).append(t.to_pandas())
    assert len(held) == 32 and sum(len(x) for v in held.values() for x in v) == len(rows)
    boxes = [(set(x["source"]), set(x["lang"]), (x["text"].str.len().min(), x["text"].str.len().max())) for v in held.values() for x in v]
    share = lambda test: sum(map(test, boxes)) / len(boxes)
    assert np.mean([share(lambda b: f"s{i}" in b[0]) for i in range(16)]) < 0.6
    assert np.mean([share(lambda b: f"l{i}" in b[1]) for i in range(8)]) < 0.75
    assert np.mean([share(lambda b: b[2][0] <= n <= b[2][1]) for n in (50, 500, 1500, 3500)]) < 0.9
    with __import__("pytest").raises(ValueError):
        H.write_shards(docs.union(docs.where("doc_id = 1")), H.hilbert_shards(docs, 4), str(tmp_path / "bad"))


def test_counts_are_those_of_sql(spark):
    import duckdb

    p = "/root/testdata/sf0.01/documents.parquet"
    want = duckdb.sql(f"SELECT s, (SELECT count(*) FROM '{p}') // 24 + CASE WHEN s < 0 THEN 1 ELSE 0 END FROM range(24) t(s)").fetchall()
    n, least = duckdb.sql(f"SELECT count(*), count(*) // 24 FROM '{p}'").fetchall()[0]
    got = {r["shard"]: (r["count"], r["top"]) for r in H.hilbert_shards(spark.read.parquet(p)).groupBy("shard").agg({"*": "count", "slot": "max"}).toDF("shard", "count", "top").collect()}
    assert set(got) == {s for s, _ in want} and sum(c for c, _ in got.values()) == n
    assert all(c in (least, least + 1) and top == c - 1 for c, top in got.values())
    sizes = duckdb.sql(f"SELECT doc_id, coalesce(strlen(text), 0) + 8 FROM '{p}'").fetchall()
    assert {r["doc_id"]: r["size"] for r in H.hilbert_shards(spark.read.parquet(p)).collect()} == dict(sizes)
