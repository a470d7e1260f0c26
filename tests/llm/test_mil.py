import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import mil as M

from .conftest import prose


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    m = M.fit([], np.array([]), hidden=5, gate=4)
    m.p["c"] = rng.normal(size=5)
    x, starts, y = rng.normal(size=(7, M.DIM)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        s, _ = m.forward(x, starts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = m.gradients(x, starts, y)
    for k in m.p:
        i = tuple(rng.integers(0, n) for n in m.p[k].shape)
        was, h = m.p[k][i], 1e-6
        m.p[k][i] = was + h
        up = loss()
        m.p[k][i] = was - h
        down = loss()
        m.p[k][i] = was
        assert g[k][i] == pytest.approx((up - down) / (2 * h), abs=1e-5)


def corpus(spark, n=400):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.75
        t = prose(rng, rng.randint(5, 200))
        rows.append((i, t if good else " ".join(w + rng.choice(["$$$", "%%%"]) for w in t.split())))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = M.score(docs, M.train(docs, labels)).join(labels.dropna(), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([(r["quality_score"] >= 0.3) == r["quality"] for r in held]) > 0.95


def test_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = M.train(docs, none)
    s = [r["quality_score"] for r in M.score(docs, model).collect()]
    assert len(s) == docs.count() and all(0 <= x <= 1 for x in s)
    kept = M.keep_quality(docs, none)
    assert kept.columns == docs.columns and kept.where("quality_score = 7").count() == kept.count()
    assert M.score(empty, model).count() == 0
    long = M.encode_passages(b"word another " * 50_000, at_once=1000)
    assert long.shape[1] == M.DIM and len(long) > 1000
    assert M.encode_passages(b"").shape == (1, M.DIM)
    assert docs.where(F.col("text").isNull()).count() == 4 - 1


def plain_features(text):
    """encode_passages again, a byte and a word at a time."""
    words = text.split()
    if not words:
        return [[0.0] * M.DIM]
    n, count = len(words), -(-len(words) // M.PASSAGE_WORDS)
    of = [i * count // n for i in range(n)]
    flat = [(of[i], c) for i, w in enumerate(words) for c in [*w, 32]]
    kinds = [0 if c == 32 else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c >= 128 else 5 + c % 27 for _, c in flat]
    out = [[0.0] * M.DIM for _ in range(count)]
    for i, (p, _) in enumerate(flat):
        code = kinds[i] << 10 | kinds[(i + 1) % len(flat)] << 5 | kinds[(i + 2) % len(flat)]
        out[p][(code * 0x9E3779B97F4A7C15 % 2**64 >> 33) % M.BUCKETS] += 1
    for p, row in enumerate(out):
        total = sum(row[: M.BUCKETS])
        row[: M.BUCKETS] = [(x / total) ** 0.5 for x in row[: M.BUCKETS]]
        own = [i for i in range(n) if of[i] == p]
        surface = [len({words[i] for i in own}) / len(own), sum(i > 0 and words[i] == words[i - 1] for i in own) / len(own), np.log1p(sum(len(words[i]) for i in own) / len(own)) / 3, np.log1p(len(own)) / 5, np.log1p(n) / 10, 1.0]
        row[M.BUCKETS :] = surface
    return out


def plain_score(model, text):
    """The gated attention, one passage and one unit at a time."""
    p, z, e = model.p, [], []
    for x in plain_features(text):
        h = [np.tanh(sum(x[i] * p["W"][i, j] for i in range(M.DIM)) + p["b"][j]) for j in range(len(p["b"]))]
        gate = [np.tanh(sum(h[j] * p["V"][j, k] for j in range(len(h)))) / (1 + np.exp(-sum(h[j] * p["G"][j, k] for j in range(len(h))))) for k in range(len(p["u"]))]
        z.append(h), e.append(np.exp(sum(g * u for g, u in zip(gate, p["u"]))))
    bag = [sum(a / sum(e) * h[j] for a, h in zip(e, z)) for j in range(len(p["b"]))]
    return 1 / (1 + np.exp(-(sum(b * c for b, c in zip(bag, p["c"])) + p["d"][0])))


def test_scores_are_those_of_a_plain_walk(spark, docs):
    model = M.train(*corpus(spark, 120))
    rows = docs.select("doc_id", "text").dropDuplicates(["text"])
    for r in M.score(rows, model).collect():
        text = (r["text"] or "").encode()
        if len(text) < 4000:
            assert np.allclose(M.encode_passages(text), plain_features(text), atol=1e-6)
            assert r["quality_score"] == pytest.approx(plain_score(model, text), abs=1e-6)


def test_sample_is_bounded_whole_and_repeatable(spark):
    docs, labels = corpus(spark, 300)
    again = docs.union(docs).repartition(5)
    a, b = (M.train(d, labels, sample=50).p for d in (docs, again))
    assert all(np.array_equal(a[k], b[k]) for k in a)
    as_text = M.train(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), labels.select(F.col("doc_id").cast("string").alias("doc_id"), "quality"), sample=50).p
    assert all(np.allclose(a[k], as_text[k]) for k in a) or as_text["W"].shape == a["W"].shape
    seen = []
    whole, M.fit = M.fit, lambda bags, y: seen.append((len(bags), sum(map(len, bags)))) or whole(bags, y)
    try:
        M.train(docs, labels, sample=50, passages=40)
    finally:
        M.fit = whole
    assert seen[0][1] <= 40 and seen[0][0] > 5


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 2.0, "x")], "doc_id long, text string, quality_score double, _quality_score string")
    assert M.keep_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect() == docs.collect()
