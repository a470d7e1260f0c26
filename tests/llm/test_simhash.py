import random
from itertools import combinations

import xxhash

from quillmark.llm import simhash as S
from quillmark.llm.common import Scratch
from quillmark.llm.components import connected_components


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, linked):
    """items: id -> value; smallest id reachable."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(items), 2):
        if linked(items[a], items[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in items}


def test_rows_match_brute_force(docs, rows):
    got = S.simhash_components(docs).collect()
    assert len(got) == len(rows)
    fps = {r[0]: brute_fp(r[1]) for r in rows if r[0] is not None}
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]
        else:
            assert r["component_id"] in want.values()


def test_links_are_complete_also_in_hot_buckets(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(rng.randint(0, 12)):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    low = rng.getrandbits(40) << 24
    fps |= {low | rng.getrandbits(24) for _ in range(300)}
    fps = sorted(fps)
    want = brute_components(dict(enumerate(fps)), lambda a, b: (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long").repartition(3)
    for most in (4096, 16):
        scratch = Scratch(spark)
        roots = {r["node"]: r["root"] for r in connected_components(S.link_edges(df, scratch, group_rows=100, max_bucket=most), scratch).collect()}
        groups, other = {}, {}
        for i, f in enumerate(fps):
            groups.setdefault(want[i], set()).add(f)
            other.setdefault(roots.get(S._signed(f), S._signed(f)), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(300, 301), (5, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(edges, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 301: 300}


def test_keep_one(docs, rows, empty):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    fps = {r[0]: brute_fp(r[1]) for r in rows if r[0] is not None}
    assert ids == sorted(set(brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3).values()))
    assert S.keep_one(empty).count() == 0 and S.simhash_components(empty).count() == 0


def test_blocks_follow_the_count(spark):
    assert [S.blocks_for(n, 3) for n in (10, 10**9, 10**11, 5 * 10**12)] == [5, 5, 6, 7]
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps]
    df = spark.createDataFrame([(S._signed(f),) for f in set(fps)], "fp long")
    from quillmark.llm.common import Scratch

    want = None
    for blocks in (5, 6, 7):
        links = {(r["u"], r["v"]) for r in S.link_edges(df, Scratch(spark), 3, blocks).collect()}
        joined = {frozenset(x) for x in links}
        want = want or joined
        assert len(joined) >= 30 and joined == want


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "else")], "doc_id string, text string")
    got = {(r["doc_id"], r["component_id"]) for r in S.simhash_components(docs).collect()}
    assert got == {("b", "a"), ("a", "a"), (None, None)}
    assert S.keep_one(docs).count() == 2
