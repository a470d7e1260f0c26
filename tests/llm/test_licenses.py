import itertools
import random

from quillmark.llm import licenses as L


def words(t):
    return t.encode().translate(L._FOLD).split()


def accepts(parts, toks):
    """Whether the whole of toks matches: parts are words, ["opt", parts] or ("var", lo, hi)."""
    if not parts:
        return not toks
    p, rest = parts[0], parts[1:]
    if isinstance(p, bytes):
        return bool(toks) and toks[0] == p and accepts(rest, toks[1:])
    if p[0] == "opt":
        return accepts(rest, toks) or accepts(p[1] + rest, toks)
    return any(accepts(rest, toks[n:]) for n in range(p[1], min(p[2], len(toks)) + 1))


def test_automaton_against_backtracking():
    t = "a <<beginOptional>>b <<var;name=x;words=0-2>> c<<endOptional>> d <<beginOptional>>e<<endOptional>>"
    parts = [b"a", ["opt", [b"b", ("var", 0, 2), b"c"]], b"d", ["opt", [b"e"]]]
    a, s = L.compile_template("t", t), L.Scanner()
    rng = random.Random(1)
    for n in range(1, 8):
        for _ in range(300):
            toks = [rng.choice([b"a", b"b", b"c", b"d", b"e", b"z"]) for _ in range(n)]
            got = s.matches(toks, a)
            want, past = [], 0
            for i in range(n):
                if i >= past:
                    ends = [j for j in range(i + 1, n + 1) if accepts(parts, toks[i:j])]
                    if ends:
                        want.append((i, max(ends) - i))
                        past = max(ends)
            assert got == want, toks


def test_places_and_labels():
    s = L.Scanner()
    r = s.scan(b"Under-the MIT/License; under the mit licenses, under the mit license")
    assert r["places"] == [0, 8] and r["base_labels"] == {"mit"} and r["score"] == 1.0
    r = s.scan("This work is licensed under the GNU General Public License, version 3.".encode())
    assert r["labels"] == {"gpl-3"} and not r["places"]
    part = s.scan(b"licensed under the gnu general public license of nothing")
    assert not part["labels"] and 0 < part["score"] < 1
    full = L.TEMPLATES["mit"][1]
    text = L._OPT.sub(lambda m: "Jane Doe 2020" if m[1] == "var" else " ", full)
    assert s.scan(text.encode())["labels"] == {"mit"}
    assert not s.scan(text.replace("sublicense", "rent").encode())["labels"]


def test_query(docs, rows, empty):
    got = L.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for r in rows:
        if r[0] is not None:
            assert by[r[0]]["n_words"] == len(words(r[1] or "")) and by[r[0]]["n_base"] == 0 and by[r[0]]["first_word"] is None and by[r[0]]["labels"] == ""
    assert L.scan_licenses(empty).count() == 0


def plain_share(tokens, a):
    """The longest run of mandatory words that begins with two of them side by side, by trying every state at every place."""
    best = 0
    for i in range(len(tokens)):
        for s in range(len(a.words)):
            states = {(s, 0)}
            for k, w in enumerate(tokens[i:]):
                nxt = set()
                for t, n in states:
                    if w in a.words[t]:
                        to = a.words[t][w]
                        nxt.add((to, n + a.mandatory[to] - a.mandatory[t]))
                    nxt |= {(to, n) for to in a.any_[t]}
                states = {(u, n) for t, n in nxt if k > 1 or n == k + 1 for u in a.closure([t])}
                if k:
                    best = max([best, *(n for _, n in states)])
    return best / len(a.required)


def test_score_is_the_longest_run():
    rng = random.Random(6)
    template = "one two <<beginOptional>>three four<<endOptional>> five <<var;name=x;words=0-2>> six one seven <<var;name=y;words=1-1>> eight nine"
    a = L.compile_template("t", template)
    scanner = L.Scanner({"t": [template]}, {"zz zz": "zz"})
    words = [b"one", b"two", b"three", b"four", b"five", b"six", b"seven", b"eight", b"nine", b"x"]
    for _ in range(300):
        tokens = [rng.choice(words) for _ in range(rng.randint(0, 6))]
        at = rng.randint(0, 4)
        tokens[at:at] = b"one two five x six one seven x eight nine".split()[rng.randint(0, 5) : rng.randint(4, 10)]
        if not scanner.matches(tokens, a):
            assert scanner.share(tokens) == plain_share(tokens, a), tokens
    mit = L.TEMPLATES["mit"][1]
    plain = L._OPT.sub("", mit.replace("<<var;name=holder;words=1-12>>", "me"))
    words = plain.encode().translate(L._FOLD).split()
    full = L.Scanner()
    assert full.scan(b" ".join(words))["score"] == 1.0
    assert 0.9 < full.scan(b" ".join(words[8:]))["score"] < 1.0
    at = words.index(b"documentation")
    assert 0.7 < full.scan(b" ".join(words[:at] + words[at + 1 :]))["score"] < 1.0
    assert full.scan(b"nothing here of it")["score"] == 0.0


BASE_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
p AS (SELECT * FROM (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) v(words, label)),
h AS (SELECT doc_id, i - 1 AS pos, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), p WHERE w[i:i + len(words) - 1] = words)
SELECT t.doc_id, len(w)::BIGINT, count(pos), min(pos), max(pos), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM t LEFT JOIN h ON t.doc_id = h.doc_id GROUP BY t.doc_id, w
"""


def test_base_columns_are_those_of_sql(spark, tmp_path):
    import duckdb

    rows = [(0, "Released UNDER the MIT-license; under the mit license"), (1, None), (2, ""), (3, "cc by nc cc-by-nc 4"), (4, "Apache License, Version 2.0"), (5, "under the mit"), (6, "é cc\tby\nnc"), (7, "cc by nc " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    for path, glob in ((str(tmp_path / "d"), "/*.parquet"), ("/root/testdata/sf0.01/documents.parquet", "")):
        want = {r[0]: r[1:] for r in duckdb.sql(BASE_SQL.replace("documents", f"'{path}{glob}'")).fetchall()}
        got = L.scan_licenses(spark.read.parquet(path)).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got} == want
