import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from quillmark.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer, rows):
    rng = random.Random(3)
    marks = [*" \n\t\r'.,!|a bcsé_|#½²日\x1c\x0b\xa0ÀŠ12T\u180e\u200b\u3000", "<|endoftext|>", " <|endoftext|> ", "'s", " the", "  "]
    texts = ["".join(rng.choice(marks) for _ in range(25)) for _ in range(4000)] + ["hello <|endoftext|> end", "", " ", "a ", " a"] + [r[1] or "" for r in rows]
    for enc in (P.Encoder(PATH), P.Encoder(PATH, most=10)):
        assert enc.parts
        got = [x for at in range(0, len(texts), 100) for x in enc.encode(texts[at : at + 100])]
        for t, ids in zip(texts, got, strict=True):
            assert ids == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert len(next(P.Encoder(PATH).encode(["hello <|endoftext|> end"]))) == 4 * 4


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, t = P.Encoder(path), Tokenizer.from_file(path)
    assert not enc.parts
    assert list(enc.encode(["Some words, here "])) == [np.array(t.encode("Some words, here ", add_special_tokens=False).ids, "<u4").tobytes()]


def test_placement_minimises_the_sum_of_squares():
    rng, s = random.Random(2), P.SumOfSquares(24)
    for _ in range(600):
        n = rng.randint(1, 23)
        before = s.count.copy()

        def total(h):
            c = before.copy()
            c[h] -= h > 0
            if h + n < 24:
                c[h + n] += 1
            return int((c**2).sum())

        best = min(total(h) for h in range(24 - n + 1) if h == 0 or before[h])
        s.place(("p", n), n)
        assert int((s.count**2).sum()) == best
        assert all(len(v) == s.count[h] for h, v in s.open.items())


def check(pieces, docs, tokenizer, window=2048):
    by, seqs = {}, {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in docs.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or at & (at - 1) == 0


def test_pack(docs, rows, empty, tokenizer):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check(P.pack(unique, PATH).collect(), {r[0]: r[1] for r in rows if r[0] is not None}, tokenizer)
    assert P.pack(docs, PATH).where("start = 0").count() == len(rows)
    assert P.pack(empty, PATH).count() == 0


def test_open_windows_are_carried(spark, empty, tokenizer):
    """What partitions leave open is packed on: the level arrays of both stages place most of it, whatever the partitions."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 150)))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    pieces = P.pack(docs, PATH, 128).cache()
    check(pieces.collect(), dict(rows), tokenizer, 128)
    by = lambda x: {r["placed_by"]: r["sum(length)"] for r in x.groupBy("placed_by").sum("length").collect()}
    many, one = by(pieces), by(P.pack(docs.coalesce(1), PATH, 128))
    assert set(many) <= set(P.PLACED) and many["carried"] > many["cut"] and many["cut"] < 2 * one["cut"]
    with_ids = P.pack(docs, PATH, 128, with_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in with_ids)


def test_brute_force_of_both_stages():
    """Every token of every document once, windows full or powers of two, and carried pieces placed whole."""
    rng = random.Random(9)
    for window in (16, 64):
        docs = [(i, np.arange(rng.randint(1, 3 * window), dtype="<u4").tobytes()) for i in range(400)]
        first = list(P.pack_stream(iter(docs), window))
        open_ = [s for how, s in first if how < 0]
        assert all(0 < sum(len(p[2]) for p in s) < 4 * window for s in open_)
        last = list(P.pack_open((p for s in open_ for p in s), window))
        held = {}
        for how, s in [x for x in first if x[0] >= 0] + last:
            n = sum(len(p[2]) for p in s) // 4
            assert n == window or how == 3 and n & (n - 1) == 0
            for doc_id, start, ids, tokens in s:
                held.setdefault(doc_id, []).append((start, ids))
        assert {k: b"".join(x for _, x in sorted(v)) for k, v in held.items()} == dict(docs)
        whole = {id(p) for s in open_ for p in s}
        assert all(id(p) in whole for how, s in last if how == 2 for p in s)


def test_ends_of_words_are_looked_up_once():
    import public_tokenizers

    enc = P.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words, asked, piece = [f"{a}{b}né&&&" for a in "abcdef" for b in "xyz"], [], enc.piece
    enc.piece = lambda run: asked.append(run) or piece(run)
    enc.learn(words)
    assert asked.count("&&&") == 1
    assert all(enc.known[w] == enc.whole(" " + w) for w in words)


def test_first_runs_are_tokenised_once(tokenizer):
    enc, asked = P.Encoder(PATH), []
    piece = enc.piece
    enc.piece = lambda x: asked.append(x) or piece(x)
    texts = ["so wörd, wörd. wörd!? wörd", "so plain: plain; plain.\nPlain, x", "so wörd, again", "a_b c<|endoftext|> d| <|", "one"]
    for t in texts:
        assert list(enc.encode([t])) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(asked) == len(set(asked)) and asked.count(" wörd") == 1
    assert "wörd" in enc.known and "wörd!?" not in enc.known


def test_words_met_again_outlive_a_full_encoder(tokenizer):
    enc = P.Encoder(PATH, most=20)
    texts = [f"x keep kept, new{i} {' '.join(chr(97 + i) + chr(97 + j) for j in range(9))} keep." for i in range(26)]
    assert list(enc.encode(texts[:1])) + [x for t in texts[1:] for x in enc.encode([t])] == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert "keep" in enc.known and len(enc.known) + len(enc.before) < 60
