"""The pipeline against its stages' own operators, and what each stage must keep."""

import corpus_pipeline as C
from quillmark.llm import packing


def test_stages_in_order_and_columns(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = docs.count()
    assert [k for k, _ in C.STAGES] == ["quality_classifier", "quality_rules", "simhash_dedup", "mix_sources", "pack_sequences"]
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, d)
        if name != "pack_sequences":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in ("quality_classifier", "quality_rules", "simhash_dedup"):
            assert 0.5 * n < docs.count() <= n
            n = docs.count()
    tokens = docs.agg({"length": "sum"}).first()[0]
    mixed = spark.read.parquet(str(tmp_path / "mix_sources"))
    enc = packing.encoder(packing_path())
    assert tokens == sum(len(i) // 4 + 1 for i in enc.encode([r["text"] for r in mixed.collect()]))


def packing_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_nulls_repeats_and_clashing_columns(spark, docs, tmp_path):
    """Every stage keeps the columns it is given, whatever their names, and has a result for nulls, repeats and long texts."""
    d = "/root/testdata/sf0.001"
    x = docs.withColumnsRenamed({"n": "_size", "t": "row", "rank": "text_hash", "cell": "_quality_score", "word": "class"})
    for name, stage in C.STAGES:
        out = stage(spark, x, d)
        assert name == "pack_sequences" or out.dtypes == x.dtypes, name
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "simhash_dedup":
            assert out.count() == out.select("doc_id", "text").distinct().count() and out.select("text").distinct().count() == out.count()
            assert out.where("text = 'w'").count() == 0
        x = out
    assert x.where("start = 0").count() > 0


def test_empty_tables(spark, empty, tmp_path):
    for name, stage in C.STAGES:
        out = stage(spark, empty, "/root/testdata/sf0.001")
        assert out.count() == 0, name


def test_run_leaves_its_result_alone(spark):
    from quillmark.llm import common

    before = {p for _, p in common._scratch}
    got = C.run(spark, "/root/testdata/sf0.001")
    assert len({p for _, p in common._scratch} - before) == 1 and got.count() > 0


def test_stages_against_brute_force(spark):
    """Rules, near-duplicates, mix and packing of sf0.001, each recomputed plainly on its own input."""
    from quillmark.llm import mil, near, quality_rules
    import regex

    from tests.llm.test_quality_rules import brute

    def good(t):
        words, chars, symbols, dup, repeat = brute(t)
        w = t.encode().split()
        lines = sum(bool(x.encode().split()) for x in t.split("\n"))
        stutter = sum(a == b for a, b in zip(w, w[1:]))
        return not (words < 10 or 100 * repeat > 20 * words or 100 * symbols > 10 * words or dup >= 3 and 100 * dup > 30 * lines
                    or 100 * len(regex.findall(r"\p{Lu}", t)) > 40 * chars or chars > 40 * words or 100 * stutter > 25 * words)

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = mil.train(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}

    def score(t):
        x = mil.encode_passages((t or "").encode()).astype(float)
        return model.forward(x, __import__("numpy").array([0]))[0][0]

    kept = {r["doc_id"] for r in C.quality_classifier(spark, docs, d).collect()}
    assert kept == {i for i, t in text.items() if score(t) >= mil.THRESHOLD}
    kept_good = C.quality_rules(spark, docs.where(docs["doc_id"].isin(*kept)), d)
    assert {r["doc_id"] for r in kept_good.collect()} == {i for i in kept if good(text[i] or "")}
    sets = {r["doc_id"]: set(near.shingle_set((r["text"] or "").encode()).tolist()) for r in kept_good.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in C.simhash_dedup(spark, kept_good, d).collect()} == {i for i in ids if find(i) == i}
