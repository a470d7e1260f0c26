import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmark.llm import lattice as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(v, s):
    """Every segmentation of a text, as lists of pieces."""
    if not s:
        return [[]]
    out = [[v.ids[s[:n]], *rest] for n in range(1, min(len(s), v.longest) + 1) if s[:n] in v.ids for rest in segmentations(v, s[n:])]
    if s[0] not in v.ids:
        out += [[*(v.byte_ids[b] for b in s[0].encode()), *rest] for rest in segmentations(v, s[1:])]
    return out


def plain(v, logs, word):
    """Log probability of a word, and the pieces expected in it, by listing its segmentations."""
    p = [(math.exp(sum(logs[i] for i in x)), x) for x in segmentations(v, L.MARK + word)]
    total, expected = sum(q for q, _ in p), Counter()
    for q, x in p:
        for i in x:
            expected[i] += q / total
    return math.log(total), expected


def test_lattice_sums_all_segmentations():
    v = L.vocabulary(PATH)
    logs, end = L.piece_logs(v, {v.ids["▁the"]: 50, v.ids["e"]: 9}, 10)
    assert math.exp(end) + sum(math.exp(x) for x in logs) == pytest.approx(1)
    lat = L.Lattice(v, logs)
    words = ["the", "thee", "hello", "été", "漢\U0001f600x", "a", "the", "understanding"]
    got = lat.words(words)
    want = [plain(v, logs, w) for w in words]
    assert list(got) == pytest.approx([x for x, _ in want])
    n, expected = np.arange(1.0, len(words) + 1), Counter()
    for k, (_, x) in zip(n, want):
        for i, q in x.items():
            expected[i] += k * q
    found = lat.expected(words, n)
    assert {i: x for i, x in enumerate(found) if x} == pytest.approx(dict(expected))
    assert np.isfinite(lat.words(["q" * 5000, "\U0001f600" * 300])).all() and len(lat.words([])) == 0
    lat._blocks = lambda words: [(i, i + 1) for i in range(len(words))]
    assert list(lat.words(words)) == pytest.approx(list(got))


def test_rounds_raise_the_likelihood_of_training_words():
    v = L.vocabulary(PATH)
    words, n = ["understanding", "thandoun", "hewhoner", "ontionst"], np.array([5.0, 40.0, 30.0, 20.0])
    logs, seen = L.piece_logs(v, {}, 1, 0.001)[0], []
    for _ in range(4):
        lat = L.Lattice(v, logs)
        seen.append(float(n @ lat.words(words)))
        logs = L.piece_logs(v, dict(enumerate(1e4 * lat.expected(words, n))), 1, 0.001)[0]
    assert seen == sorted(seen) and seen[-1] > seen[0] + 10


@pytest.mark.parametrize("head", [0, 20, 50_000])
def test_scores_against_brute_force(docs, rows, head):
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    got = L.lattice_scores(docs, train, PATH, head=head).collect()
    assert len(got) == len(rows)
    split = lambda t: (t or "").encode().lower().split()
    c = Counter()
    ends = 0
    for r in rows:
        if r[0] is not None and r[0] % 3:
            c.update(split(r[1]))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    vocab = L.vocabulary(PATH)
    logs, end = L.piece_logs(vocab, {}, ends)
    known = [(w.decode(), k) for w, k in c.items()]
    for _ in range(2):
        logs, end = L.piece_logs(vocab, dict(enumerate(L.Lattice(vocab, logs).expected([w for w, _ in known], np.array([float(k) for _, k in known])))), ends)
    every = sorted({x.decode() for r in rows for x in split(r[1])})
    word = dict(zip(every, L.Lattice(vocab, logs).words(every)))
    want = {}
    for r in rows:
        w = split(r[1])
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want.setdefault(r[0], []).append((len(w) + 1, sum(c[x] > 0 for x in w) + 1, base, (sum(word[x.decode()] for x in w) + end) / math.log(10)))
    for r in got:
        assert r["train_tokens"] == n
        assert any((r["n_tokens"], r["n_known"]) == x[:2] and r["base_score"] == pytest.approx(x[2]) and r["score"] == pytest.approx(x[3]) for x in want[r["doc_id"]])


def test_empty_table(empty):
    assert L.lattice_scores(empty, F.lit(True), PATH).count() == 0


def test_a_worker_hands_back_what_its_counts_took(spark, monkeypatch):
    """The last words go out after the last batch, so the counts' memory must be given back once more."""
    import pyarrow as pa

    from quillmark.llm import lattice

    class Rows:
        def __getattr__(self, _):
            return lambda *a: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    rows, seen = Rows(), []
    monkeypatch.setattr(lattice, "hand_back", lambda: seen.append("back"), raising=False)
    lattice.count_words(rows, F.lit(True))
    for b in rows.run(iter([pa.RecordBatch.from_arrays([pa.array(["a b", "b"]), pa.array([True, False])], ["text", "train"])])):
        seen.append(b.num_rows)
    assert seen == [2, "back"]
