import re

from quillmark.llm import quality_rules as Q


def brute(text):
    t = text or ""
    w = t.encode().split()
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


ODD = ["a b c d e a b c d e", "x x x x x x x", "a\na\n \n b\nb\na", "# * $ < 漢 |", "a b c d e f " * 50, "p q r s t u p q r s t p q r s t u", "one two three\x1cfour"]


def test_measurements_match_brute_force(spark, rows):
    texts = [r[1] for r in rows] + ODD
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.ledger(df).collect():
        m = r["measured"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_bits_policies_and_ablation(spark):
    texts = ["a b", "a b c d e " * 9, "w%d " * 0 + " ".join(f"word{i}" for i in range(30)), " ".join(f"WORD{chr(65 + i % 26)}{i}" for i in range(30)), " ".join(f"w{i} w{i}" for i in range(20)), "| ".join(f"w{i}" for i in range(20))]
    led = Q.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    bits = {r["doc_id"]: r["failed_rules"] for r in led.collect()}
    assert bits[0] & 1 and bits[1] & 2 and bits[2] == 0 and bits[3] == Q.mask(["shouting"]) and bits[4] == Q.mask(["stutter"]) and bits[5] == Q.mask(["symbols"])
    ab = {r["rule"]: r for r in Q.ablation(led, "strict-1").collect()}
    assert ab["shouting"]["failing_alone"] == 1 and ab["shouting"]["kept_without"] == 2


def test_keeps_columns_and_takes_empty_tables(docs, empty):
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and 50 < kept.count() < docs.count()
    assert Q.keep_good(empty).count() == 0 and Q.ablation(Q.ledger(empty), "strict-1").count() == 0
    plan = Q.ledger(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(c in plan for c in ("Python", "Pandas", "Arrow", "SortMergeJoin"))
