import math
import random

import numpy as np

from quillmark.llm import itq as I

from .test_simhash import brute_components


def brute(rows):
    def fine(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        (v, la), (w, lb) = a, b
        if not (fine(v, la) and fine(w, lb) and la == lb and len(v) == len(w)):
            return False
        x, y = np.array(v, float), np.array(w, float)
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    items = {r[0]: (r[1], r[2]) for r in rows}
    links = {i: sum(j != i and linked(items[i], items[j]) for j in items) for i in items}
    return links, brute_components(items, linked)


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(240):
        v = rng.normal(size=16) if i % 3 == 0 or not rows else np.array(rows[-1][1]) + rng.normal(size=16) * rng.choice([0.01, 0.05, 0.12])
        rows.append((i, [float(np.float32(x)) for x in v], i // 80))
    rows += [(300 + i, rows[0][1], 0) for i in range(9)] + [(310, rows[0][1], 1), (311, rows[0][1], None)]
    rows += [(320, None, 0), (321, [], 0), (322, [0.0] * 16, 0), (323, [None] + [1.0] * 15, 0), (324, [float("nan")] * 16, 0), (325, [float("inf")] * 16, 0), (326, [1.0] * 8, 0)]
    random.Random(0).shuffle(rows)
    return rows


def test_links_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, class int, n int").repartition(3)
    links, comp = brute(rows)
    for most in (2048, 8):
        got = {r["vec_id"]: r for r in I.itq_links(df, max_bucket=most).collect()}
        assert len(got) == len(rows)
        assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(links.values())
        for i, r in got.items():
            assert r["n_links"] <= links[i] and r["kept"] == (r["component_id"] == i)
            assert comp[r["component_id"]] == comp[i]
        for i in (311, 320, 321, 322, 323, 324, 325, 326):
            assert got[i]["n_links"] == 0 and got[i]["kept"]


def test_nulls_and_empty_table(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert I.itq_links(spark.createDataFrame([], kind)).count() == 0
    got = I.itq_links(spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)], kind)).collect()
    assert sorted((r["n_links"], r["component_id"], r["kept"]) for r in got) == [(2, 5, False), (2, 5, True), (2, 5, True)]


def test_rotation_is_orthogonal_and_balanced():
    x = np.random.default_rng(1).normal(size=(500, 16)) @ np.diag(np.linspace(1, 3, 16))
    mean, proj = I.learn_rotation(x, bits=16)
    assert np.allclose(proj.T @ proj, np.eye(16), atol=1e-8)
    assert abs(((x - mean) @ proj > 0).mean() - 0.5) < 0.1


def test_recall_holds_whatever_the_vectors_share(spark):
    """Pairs exactly at the wanted cosine, in vectors that are centred, that share a direction, and that lie near a plane."""
    rng = np.random.default_rng(4)
    for d, shift, scale in ((64, 0.0, None), (64, 2.0, None), (64, 4.0, None), (48, 0.5, np.linspace(3, 0.1, 48))):
        x = rng.normal(size=(500, d)) * (1 if scale is None else scale) + shift * np.ones(d)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        u = rng.normal(size=x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        c = 0.9801
        both = np.concatenate([x, c * x + np.sqrt(1 - c * c) * u])
        want = int((both @ both.T >= 0.98).sum() - len(both))
        df = spark.createDataFrame([(i, v.tolist(), "l") for i, v in enumerate(both)], "vec_id long, embedding array<double>, label string")
        got = I.itq_links(df).agg({"n_links": "sum"}).first()[0]
        assert 0.97 * want <= got <= want, (d, shift, got, want)


def test_index_follows_the_number_of_vectors():
    x = np.random.default_rng(1).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = I.learn_rotation(x)
    bits = lambda i: int(i.masks[0]).bit_count()
    small, large = (I.plan_index(n, [(x, *model)], 0.98) for n in (10_000, 10**9))
    assert bits(small) < bits(large) and 10**9 / 2 ** bits(large) < 1000 and min(small.recall, large.recall) >= 0.995
    # Brute force of the plan's promise: partners at the wanted cosine meet and are looked at.
    rng = np.random.default_rng(6)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    diff = I.codes(x, *model) ^ I.codes(0.98 * x + np.sqrt(1 - 0.98**2) * u, *model)
    for plan in (small, large):
        met = np.any([(diff & np.uint64(m)) == 0 for m in plan.masks], axis=0) & (np.bitwise_count(diff) <= plan.radius)
        assert met.mean() >= 0.98


def test_components_of_links():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = 30
        i, j = rng.integers(0, n, 25), rng.integers(0, n, 25)
        label = I._components(n, i[:10], j[:10], np.arange(n))
        label = I._components(n, i[10:], j[10:], label)
        want = brute_components({k: k for k in range(n)}, lambda a, b: any({a, b} == {x, y} for x, y in zip(i, j)))
        assert all(label[k] == want[k] for k in range(n))
