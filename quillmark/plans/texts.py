"""Queries over texts, dates, answers, collation, streams and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as Y
from ..functions import parsing as J
from ..functions import text as X
from ..operators import collate as L
from ..operators import models as V
from ..operators import pool as Q
from ..operators import segment as S
from ..sources import sinks as O
from ..sources.scratch import kept
from ..streaming import code_events as E
from . import adapters as A
from .adapters import with_sql
from .knowledge import pool_alike

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _docs(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("note_id"), "text")


@query("token_counts", r"""SELECT doc_id::VARCHAR AS note_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::BIGINT AS n_tokens, len(list_filter(regexp_split_to_array(trim(text, chr(32) || chr(10)), '\s+'), lambda x: x <> ''))::BIGINT AS n_words FROM documents""")
def token_counts(spark, d):
    t = _docs(spark, d)
    return t.select("note_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"), X.n_words(F.col("text")).cast("long").alias("n_words"))


@query("word_chunks", r"""WITH w AS (SELECT doc_id::VARCHAR AS note_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT *, len(w) // 3 AS k FROM w)
SELECT note_id, unnest(CASE WHEN len(w) >= 3 THEN range(3) ELSE [0] END)::INT AS chunk,
 unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[1:k], ' '), array_to_string(w[k + 1:2 * k], ' '), array_to_string(w[2 * k + 1:], ' ')] ELSE [text] END) AS text FROM s""")
def word_chunks(spark, d):
    """Texts with fewer words than chunks stay as they are."""
    return _docs(spark, d).select("note_id", F.posexplode(X.word_chunks(F.col("text"), 3)).alias("chunk", "text"))


@query("kb_texts", with_sql("kb", "SELECT code, code || '. ' || description || CASE WHEN lower(trim(lay_term)) <> lower(trim(description)) THEN ' | ' || lay_term ELSE '' END || ' | ' || family AS text, '- ' || code || ': ' || description || ' (' || lay_term || ')' AS line FROM kb"))
def kb_texts(spark, d):
    c = F.col
    return A.kb(spark, d).select("code", X.kb_text(c("code"), c("description"), c("lay_term"), c("family")).alias("text"), X.candidate_line(c("code"), c("description"), c("lay_term")).alias("line"))


def _answers(spark, d):
    p = A.table(spark, d, "part").select("p_partkey")
    code, m = A.as_code(F.col("p_partkey")), F.col("p_partkey") % 4
    text = (
        F.when(m == 0, F.concat(F.lit('Sure {"selected": ["'), code, F.lit('", " j0585 "]}'))).when(m == 1, F.concat(F.lit("I would code "), code, F.lit(" and 12345.")))
        .when(m == 2, F.lit("no codes here")).otherwise(F.concat(F.lit('{"selected": ["'), code, F.lit('"')))
    )
    return p.select("p_partkey", code.alias("code"), text.alias("answer"))


@query("parse_llm_json", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lpad(p_partkey::VARCHAR, 5, '0') || '|J0585' WHEN 1 THEN lpad(p_partkey::VARCHAR, 5, '0') || '|12345' WHEN 2 THEN '' ELSE lpad(p_partkey::VARCHAR, 5, '0') END AS codes FROM part""")
def parse_llm_json(spark, d):
    return _answers(spark, d).select("p_partkey", F.array_join(J.selected_codes(F.col("answer")), "|").alias("codes"))


@query("leakage_scrub", """WITH c AS (SELECT p_partkey, p_name, lpad(p_partkey::VARCHAR, 5, '0') AS code, '<CPT_MASK>' AS m FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'PROC ' || m || '  ' || m || ' x2' WHEN 1 THEN m || ' and ' || m WHEN 2 THEN 'toolong' || code || ' and 1' || code WHEN 3 THEN m || chr(10) || 'Name ' || m ELSE '99998 stays' END AS text,
 CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN 2 ELSE 0 END::BIGINT AS n_codes, CASE WHEN p_partkey % 5 IN (0, 3) THEN 1 ELSE 0 END::BIGINT AS n_tails FROM c""")
def leakage_scrub(spark, d):
    """Every code of knowledge base and gold, alone, glued to letters, and with what may not cling to it; a modifier masks nothing."""
    p = A.table(spark, d, "part")
    code, m = A.as_code(F.col("p_partkey")), F.col("p_partkey") % 5
    text = (
        F.when(m == 0, F.concat(F.lit("PROC "), code, F.lit(" - PR "), F.upper("p_name"), F.lit("  "), code, F.lit("L x2")))
        .when(m == 1, F.concat(F.lit("eye"), code, F.lit("x2 and "), code, F.lit("G25"))).when(m == 2, F.concat(F.lit("toolong"), code, F.lit(" and 1"), code))
        .when(m == 3, F.concat(code, F.lit("-pr note\nName "), code)).otherwise(F.lit("99998 stays"))
    )
    modifiers = spark.createDataFrame([("ME",), ("na",), (None,)], "code string")
    known = S.code_vocabulary(A.kb(spark, d), A.gold(spark, d), modifiers)
    vocab = [r["code"] for r in known.collect()]  # codes of five characters: a code list, of tens of thousands
    return S.scrub(p.select("p_partkey", text.alias("text")), "text", vocab)


RULES = (S.header_rule("findings", "FINDINGS :"), S.header_rule("procedure", "PROCEDURE IN DETAIL"), S.header_rule("plan", "PLAN"), S.Rule("signed", r"^Signed by \w+"))


@query("sectionize", """WITH s AS (SELECT p_partkey, p_name, p_type, p_partkey % 4 AS m FROM part),
r AS (SELECT p_partkey, m, unnest(CASE m WHEN 0 THEN [['preamble', 'intro ' || p_name], ['findings', 'FINDINGS: ' || p_type || chr(10) || 'PLAN is none' || chr(10) || chr(10) || 'FINDINGS: again'], ['procedure', 'PROCEDURE IN DETAIL cut findings:']]
 WHEN 1 THEN [['body', 'findings: ' || p_name]] WHEN 2 THEN [['plan', 'PLAN : rest ' || p_name], ['signed', 'Signed by me today']] ELSE [['preamble', p_name], ['findings', 'FINDINGS : ' || p_type]] END) AS x FROM s)
SELECT p_partkey::VARCHAR AS note_id, x[1] AS section, x[2] AS section_text FROM r""")
def sectionize(spark, d):
    """Headers of several words and of one, repeated, in lower case, inside a line, without content, and a pattern per line."""
    p, m, name = A.table(spark, d, "part"), F.col("p_partkey") % 4, F.col("p_name")
    text = (
        F.when(m == 0, F.concat(F.lit("intro  "), name, F.lit("\r\n\nFINDINGS:\t"), F.col("p_type"), F.lit("\nPLAN is none\nPROCEDURE  IN DETAIL cut findings:\n FINDINGS: again ")))
        .when(m == 1, F.concat(F.lit("findings: "), name)).when(m == 2, F.concat(F.lit("  PLAN : rest "), name, F.lit("\nSigned by me today")))
        .otherwise(F.concat(name, F.lit("\nFINDINGS : "), F.col("p_type"), F.lit("\nPROCEDURE IN DETAIL ")))
    )
    t = p.select(F.col("p_partkey").cast("string").alias("note_id"), S.sectionize(text, RULES).alias("sections"))
    return t.select("note_id", F.explode("sections").alias("section", "section_text"))


def _windows_sql(source: str, keys: str, most: int, overlap: int) -> str:
    """Sentences by replacing, windows by recursion over the next start of every sentence. source gives ``keys`` and text."""
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return (
        "WITH RECURSIVE src AS (" + source + r"""),
t AS (SELECT """ + keys + r""", trim(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)(\\r\\n|\\n|\\r|<br\s*/?>|</p>|<p>)', ' ', 'g'), '[\s\v\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS t FROM src),
p AS (SELECT """ + keys + r""", regexp_replace(t, '(?i)(^|[^\p{L}\p{N}_])(dr|mr|ms|mrs|st|vs|etc|e\.g|i\.e|a\.m|p\.m|no|pt)\.', '\1\2' || chr(2), 'g') AS t FROM t),
l AS (SELECT """ + keys + r""", list_filter(list_transform(string_split(regexp_replace(t, '([.!?;:]) ([A-Z0-9\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(replace(x, chr(2), '.'))), lambda x: x <> '') AS l FROM p),
f AS (SELECT """ + keys + r""", CASE WHEN len(l) = 1 AND len(regexp_extract_all(l[1], '[\p{L}\p{N}_]+')) > 300 THEN list_transform(range(0, len(string_split(l[1], ' ')), 40), lambda i: array_to_string(string_split(l[1], ' ')[i + 1:i + 40], ' ')) ELSE l END AS l FROM l),
e AS (SELECT """ + keys + r""", unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i, len(l) AS n FROM f),
z AS (SELECT *, len(regexp_extract_all(s, '[\p{L}\p{N}_]+')) AS k, sum(len(regexp_extract_all(s, '[\p{L}\p{N}_]+'))) OVER (PARTITION BY """ + keys + f""" ORDER BY i) AS c FROM e),
en AS (SELECT {own}, a.i, any_value(a.n) AS n, any_value(a.c - a.k) AS c0, max(b.i) AS e, max(b.c) AS ce FROM z a JOIN z b ON {on} AND (b.i = a.i OR b.i > a.i AND b.c - (a.c - a.k) <= {most} AND b.c - b.k - (a.c - a.k) < {most}) GROUP BY {own}, a.i),
nx AS (SELECT {own}, a.i, any_value(a.n) AS n, any_value(a.e) AS e, any_value(a.ce - a.c0) AS words, greatest(a.i + 1, coalesce(max(b.i) FILTER (WHERE a.ce - (b.c - b.k) >= {overlap}), a.i + 1)) AS nxt FROM en a LEFT JOIN z b ON {on} AND b.i > a.i AND b.i <= a.e GROUP BY {own}, a.i),
w AS (SELECT {keys}, 0 AS snippet_index, i, e, n, words, nxt FROM nx WHERE i = 1 UNION ALL SELECT {own}, b.snippet_index + 1, a.i, a.e, a.n, a.words, a.nxt FROM w b JOIN nx a ON {on} AND a.i = b.nxt WHERE b.e < b.n),
sn AS (SELECT {own}, a.snippet_index::INT AS snippet_index, (a.i - 1)::INT AS start_sentence, (a.e - 1)::INT AS end_sentence, (a.e - a.i + 1)::INT AS n_sentences, a.words::INT AS n_words, array_to_string(b.l[a.i:a.e], ' ') AS snippet_text FROM w a JOIN f b ON {on})
"""
    )


@query("sentence_windows", _windows_sql("SELECT doc_id::VARCHAR AS note_id, text FROM documents", "note_id", 180, 60) + "SELECT * FROM sn")
def sentence_windows(spark, d):
    return S.snippets(_docs(spark, d))


_TALK = "SELECT conv_id::VARCHAR AS note_id, role AS section, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM conversations GROUP BY ALL"


@query("snippet_cap", _windows_sql(_TALK, "note_id, section", 40, 10) + """, o AS (SELECT *, row_number() OVER (PARTITION BY note_id, section ORDER BY n_words DESC, snippet_index) = 1 AS first FROM sn)
SELECT note_id, section, snippet_index, n_words FROM o QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY first DESC, n_words DESC, section, snippet_index) <= 4""")
def snippet_cap(spark, d):
    """What each role says in a conversation is a section."""
    said = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    c = A.table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("note_id"), F.col("role").alias("section")).agg(F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("text"))
    s = S.snippets(c, section="section", max_words=40, overlap=10)
    return S.cap_snippets(s, 4).select("note_id", "section", "snippet_index", "n_words")


@query("kendall_spearman", """WITH x AS (SELECT p_size::DOUBLE AS a, (p_partkey % 50)::DOUBLE AS b FROM part), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x),
g AS (SELECT a, b, count(*) AS k FROM x GROUP BY ALL), p AS (SELECT sum(g.k * h.k) FILTER (WHERE g.b < h.b) AS c, sum(g.k * h.k) FILTER (WHERE g.b > h.b) AS d FROM g JOIN g h ON g.a < h.a)
SELECT (SELECT count(*) FROM x) AS n, (SELECT round(corr(ra, rb), 4) FROM r) AS rho, c::BIGINT AS concordant, d::BIGINT AS discordant, round((c - d) / (c + d), 4) AS gamma FROM p""")
def kendall_spearman(spark, d):
    x = A.table(spark, d, "part").select(F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 50).cast("double").alias("b"))
    return L.spearman(x, "a", "b").crossJoin(L.concordance(x, "a", "b"))  # one row each


@query("governed_metrics", """WITH m AS (SELECT 'metrics.' || lower(n_name) || '.' || CASE WHEN n_nationkey % 2 = 0 THEN 'f1' ELSE 'precision' END AS path, n_nationkey::DOUBLE AS value FROM nation)
SELECT path, CASE WHEN path LIKE '%precision' THEN NULL ELSE value END AS value, CASE WHEN path LIKE '%precision' THEN 'suppressed' WHEN value < 10 THEN 'caveat' ELSE 'ok' END AS status, CASE WHEN path NOT LIKE '%precision' AND value < 10 THEN 'small' END AS note FROM m""")
def governed_metrics(spark, d):
    kind = F.when(F.col("n_nationkey") % 2 == 0, "f1").otherwise("precision")
    m = A.table(spark, d, "nation").select(F.concat_ws(".", F.lit("metrics"), F.lower("n_name"), kind).alias("path"), F.col("n_nationkey").cast("double").alias("value"))
    small = {r["path"]: "small" for r in m.where("value < 10").collect()}
    return L.govern(m, ["metrics.*.precision"], small)


@query("prediction_rows", with_sql("ranking pred", "SELECT note_id, string_agg(code, '|' ORDER BY score DESC, code) AS pred_codes, string_agg(printf('%.6f', score), '|' ORDER BY score DESC, code) AS pred_scores FROM pred GROUP BY note_id"))
def prediction_rows(spark, d):
    return O.prediction_rows(A.pred(spark, d))


@query("history_dates", """SELECT event_id, (ts::DATE)::VARCHAR AS compact, (make_date(2020, 1, 1) + (event_id % 400)::INT)::VARCHAR AS julian, (make_date(CASE WHEN event_id % 100 <= 40 THEN 2000 ELSE 1900 END + (event_id % 100)::INT, 4, 7))::VARCHAR AS deleted FROM events""")
def history_dates(spark, d):
    e = A.table(spark, d, "events")
    n = F.col("event_id")
    return e.select(
        "event_id", Y.compact_date(F.date_format("ts", "yyyyMMdd")).cast("string").alias("compact"), Y.julian_date(F.concat(F.lit("2020"), F.lpad((n % 400 + 1).cast("string"), 3, "0"))).cast("string").alias("julian"),
        Y.deleted_date(F.concat(F.lit("7-Apr-"), F.lpad((n % 100).cast("string"), 2, "0"))).cast("string").alias("deleted"),
    )


@query("event_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark, d):
    """The batch twin of the streaming counts."""
    return E.windowed_counts(A.table(spark, d, "events"))


@query("verifier_scores")
def verifier_scores(spark, d):
    """Where parts share a code the pool has a row for each: rows that are alike are fitted and scored once, and all come out."""
    pool = kept(Q.labelled(pool_alike(spark, d), A.gold_sets(spark, d)))  # read for the fit and the scores
    examples = Q.weighed(kept(Q.grouped_examples(pool)))
    return V.apply_verifier(V.train_verifier(examples, max_iter=10), pool)
