"""Near-duplicates against brute force over the shingles themselves."""

import random

import corpus_pipeline
from quillmark.llm import near as R
from quillmark.llm import simhash as S
from quillmark.llm.common import Scratch
from quillmark.llm.components import connected_components

from .conftest import SCHEMA, prose
from .test_simhash import brute_components


def brute_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b or (len(a & b) / len(a | b) >= 0.8 if a and b else False)


def copies(seed=6):
    """Texts and copies of them with words changed here and there, on both sides of the rule."""
    rng, texts = random.Random(seed), []
    for _ in range(40):
        base = prose(rng, rng.randint(40, 400)).split()
        texts.append(" ".join(base))
        for _ in range(4):
            w = list(base)
            for i in rng.sample(range(len(w)), rng.randint(1, max(1, len(w) // 30))):
                w[i] = prose(rng, 1)
            texts.append(" ".join(w))
    return texts


def survivors(rows):
    sets = {i: brute_set(t) for i, t in rows}
    return sets, sorted(set(brute_components(sets, alike).values()))


def test_stage_leaves_no_pair_of_the_rule(spark):
    rows = list(enumerate(copies()))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert kept.dtypes == docs.dtypes
    _, want = survivors(rows)
    assert len(want) < len(rows) and sorted(r["doc_id"] for r in kept.collect()) == want


def test_groups_also_when_dealt_to_chunks(spark):
    rows = list(enumerate(copies(7)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, want = survivors(rows)
    kept = R.keep_one_near(docs, group_rows=50, max_bucket=2, max_words=300)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_nulls_repeats_and_empty_table(docs, rows, empty, spark):
    got = R.near_groups(docs, Scratch(spark)).collect()
    assert len(got) == len(rows)
    _, want = survivors([(r[0], r[1]) for r in rows if r[0] is not None])
    assert sorted(r["doc_id"] for r in R.keep_one_near(docs).collect()) == want
    assert R.keep_one_near(empty).count() == 0


def test_minima_estimate_similarity():
    a = R.shingle_set(" ".join(map(str, range(3004))).encode())
    b = R.shingle_set(" ".join(map(str, range(300, 3304))).encode())
    assert len(a) == 3000 and abs((R.minima(a) == R.minima(b)).mean() - 2700 / 3300) < 0.15


def test_simhash_of_the_stage():
    """Its leading bits are the operator's fingerprint; pairs of the rule lie near, others do not."""
    words = [f"w{i}" for i in range(3000)]
    for n in (1, 4, 9, 255, 256, 900):
        text = " ".join(words[:n]).encode()
        assert R.simhash(R.shingle_set(text))[:8] == S.fingerprint(text, 5).to_bytes(8, "big")

    def apart(a, b):
        x, y = (int.from_bytes(R.simhash(R.shingle_set(" ".join(t).encode())), "big") for t in (a, b))
        return (x ^ y).bit_count()

    for at in range(0, 2000, 20):
        assert apart(words[at : at + 8], words[at : at + 9]) <= R.APART  # four shingles of five
        assert apart(words[at : at + 904], words[at + 100 : at + 1004]) <= R.APART  # 800 of 1,000
        assert apart(words[at : at + 300], words[at + 300 : at + 600]) > R.APART


def test_fingerprints_bring_candidates_of_their_own(spark):
    rng = random.Random(3)
    fps = {}
    for i in range(60):
        base = rng.getrandbits(64)
        for j, flips in enumerate((0, 0, 1, 3, 5)):
            fps[100 * i + j] = base ^ sum(1 << b for b in rng.sample(range(64), flips))
    rows = spark.createDataFrame([(c, S._signed(x)) for c, x in fps.items()], "class long, fp long")
    scratch = Scratch(spark)
    got = {r["node"]: r["root"] for r in connected_components(R.fingerprint_links(rows, scratch), scratch).collect()}
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {c: got.get(c, c) for c in fps} == want
