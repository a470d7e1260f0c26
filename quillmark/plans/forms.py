"""Queries over answers, text forms, rankings of chunks, code sets by date, training tables and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as Y
from ..functions import parsing as J
from ..functions import text as X
from ..operators import collate as L
from ..operators import diagnose as D
from ..operators import history as H
from ..operators import models as V
from ..operators import pool as Q
from ..operators import rank_metrics as R
from ..operators import retrieval as T
from ..operators import sampling as P
from . import adapters as A
from . import drivers
from .adapters import with_sql
from .knowledge import _HIST, _VOTE, _kb_codes, _labels, _top

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- text and answers ------------------------------------------------------------------------------------------------


@query("text_forms", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '.' ELSE substr(repeat(p_name || ' ', 40), 1, 200) END AS short, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
 '[SECTION=Findings] ' || p_name AS tag, array_to_string(string_split(p_type || ' one two three four five', ' ')[1:4], ' ') AS cut, '## plan' || chr(10) || p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '## note' || chr(10) || p_type ELSE '' END AS joined FROM part""")
def text_forms(spark, d):
    k, name, kind = F.col("p_partkey") % 2 == 0, F.col("p_name"), F.col("p_type")
    text = F.when(k, F.concat(name, F.lit(". "), kind, F.lit(". x"))).otherwise(F.repeat(F.concat(name, F.lit(" ")), F.lit(40)))
    parts = F.create_map(F.lit("plan"), name, F.lit("note"), F.when(k, kind).otherwise(F.lit("  ")))
    return A.table(spark, d, "part").select(
        "p_partkey", X.short_description(text).alias("short"), X.slug(kind).alias("slug"), X.snippet_tag(F.lit("Findings"), name).alias("tag"),
        X.truncate_words(F.concat(kind, F.lit(" one two three four five")), 3).alias("cut"), X.section_concat(parts).alias("joined"))


@query("candidate_answers", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lpad(p_partkey::VARCHAR, 5, '0') || ':0.85|J0585:0.7|A0021:-' WHEN 1 THEN lpad(p_partkey::VARCHAR, 5, '0') || ':-' ELSE 'J0585:-' END AS codes,
 CASE WHEN p_partkey % 3 = 0 THEN 'SUPPORTED' ELSE 'PARSE_ERROR' END AS verdict, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS dug FROM part""")
def candidate_answers(spark, d):
    """Objects with confidences in percent, tenths and words; a plain list; no JSON at all. Judge and payload fields beside them."""
    code, m = A.as_code(F.col("p_partkey")), F.col("p_partkey") % 3
    rich = F.concat(F.lit('text {"verdict": " supported ", "a": {"b": "'), F.col("p_brand"), F.lit('"}, "candidate_codes": [{"code": " '), code, F.lit('", "confidence": 85}, {"code": "j0585", "confidence": "7"}, {"code": "A0021", "confidence": "high"}]}'))
    answer = F.when(m == 0, rich).when(m == 1, F.concat(F.lit('{"selected": ["'), code, F.lit('"]}'))).otherwise(F.lit("perhaps j0585"))
    told = F.transform(J.candidate_codes(answer), lambda x: F.concat(x["code"], F.lit(":"), F.coalesce(x["confidence"].cast("string"), F.lit("-"))))
    return A.table(spark, d, "part").select("p_partkey", F.array_join(told, "|").alias("codes"), J.verdict(answer)["verdict"].alias("verdict"), J.dig(F.regexp_extract(answer, r"\{.*\}", 0), "a.b").alias("dug"))


@query("concept_answers", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '~seen here|other~seen here' WHEN 1 THEN p_type || '~' ELSE '' END AS concepts, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS parsed FROM part""")
def concept_answers(spark, d):
    """Fenced JSON with braces in a string and repeats in another case; an older form; none."""
    m = F.col("p_partkey") % 3
    rich = F.concat(F.lit('Sure {not json}. ```json\n{"concepts": [{"search_phrases": ["'), F.col("p_name"), F.lit('", "other", "Other"], "evidence": "seen  here", "x": "a } b"}]}```'))
    answer = F.when(m == 0, rich).when(m == 1, F.concat(F.lit('{"procedures": [{"name": " '), F.col("p_type"), F.lit(' "}]}'))).otherwise(F.lit("{ nothing"))
    told = F.array_join(F.transform(J.concept_list(answer), lambda x: F.concat(x["phrase"], F.lit("~"), x["evidence"])), "|")
    return A.table(spark, d, "part").select("p_partkey", told.alias("concepts"), J.first_object(answer).isNotNull().alias("parsed"))


@query("header_payloads", "SELECT p_partkey, 'findings' AS section, p_name || '|' || p_type AS headers FROM part")
def header_payloads(spark, d):
    payload = F.to_json(F.create_map(F.lit("findings"), F.array(F.concat(F.lit(" "), F.col("p_name")), F.col("p_type"), F.col("p_name"), F.lit(" ")), F.lit("unknown"), F.array(F.lit("x"))))
    x = A.table(spark, d, "part").select("p_partkey", F.explode(J.header_payload(payload, ["findings", "plan"])).alias("section", "h"))
    return x.select("p_partkey", "section", F.array_join("h", "|").alias("headers"))


@query("procedure_dates", """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE ts::DATE END AS day, CASE WHEN event_id % 6 = 5 THEN 'UNK' ELSE year(ts)::VARCHAR END AS stratum FROM events""")
def procedure_dates(spark, d):
    m, f = F.col("event_id") % 6, lambda p: F.date_format("ts", p)
    text = F.when(m == 0, f("yyyy-MM-dd")).when(m == 1, f("yyyy-MM-dd HH:mm:ss")).when(m == 2, f("M/d/yyyy")).when(m == 3, f("M/d/yyyy H:mm")).when(m == 4, f("yyyyMMdd")).otherwise(F.lit("soon"))
    day = Y.procedure_date(text)
    return A.table(spark, d, "events").select("event_id", day.alias("day"), Y.year_stratum(day).alias("stratum"))


# --- retrieval -------------------------------------------------------------------------------------------------------


@query("chunk_merge", with_sql("ranking", ", c AS (SELECT note_id, code, pos % 3 AS chunk, score, row_number() OVER (PARTITION BY note_id, pos % 3 ORDER BY score DESC, code) - 1 AS rank FROM ranking UNION ALL SELECT note_id, code, 3, score / 2, pos - 1 FROM ranking WHERE pos <= 4)\n"
       "SELECT note_id, code AS id, min(rank) AS rank, round(arg_max(score, -rank * 1000 + score), 6) AS score FROM c GROUP BY ALL"))
def chunk_merge(spark, d):
    from pyspark.sql.window import Window

    r = A.ranking(spark, d)
    w = Window.partitionBy("note_id", F.col("pos") % 3).orderBy(F.col("score").desc(), "code")
    c = r.select("note_id", F.col("code").alias("id"), (F.col("pos") % 3).alias("chunk"), "score", (F.row_number().over(w) - 1).cast("long").alias("rank"))
    c = c.unionByName(r.where("pos <= 4").select("note_id", F.col("code").alias("id"), F.lit(3).cast("long").alias("chunk"), (F.col("score") / 2).alias("score"), (F.col("pos") - 1).alias("rank")))
    return T.merge_chunks(c, "note_id").withColumn("score", F.round("score", 6))


@query("rerank_kept", with_sql("ranking", ", b AS (SELECT note_id, code AS id, score, row_number() OVER (PARTITION BY note_id ORDER BY score DESC, code) - 1 AS rank, count(*) FILTER (score >= 0.9) OVER (PARTITION BY note_id) AS n FROM ranking) SELECT note_id, id, round(score, 6) AS score, rank FROM b WHERE score >= 0.9 AND rank < 3 OR n = 0 AND rank < 2"))
def rerank_kept(spark, d):
    pairs = A.ranking(spark, d).select("note_id", F.col("code").alias("id"), "score")
    both = pairs.unionByName(pairs.withColumn("score", F.col("score") / 3))
    return T.rerank(both, "note_id", 0.9, 3, 2).withColumn("score", F.round("score", 6))


@query("shortlist_padded", with_sql("ranking", """, t AS (SELECT note_id, code, score, pos - 1 AS rank FROM ranking WHERE pos <= 2), f AS (SELECT note_id, min(score) AS floor, count(*) AS n FROM t GROUP BY note_id),
m AS (SELECT r.note_id, r.code, f.floor, f.n, row_number() OVER (PARTITION BY r.note_id ORDER BY r.pos, r.code) - 1 AS j FROM ranking r JOIN f USING (note_id) WHERE r.pos > 2)
SELECT note_id, code, round(score, 9) AS score, rank::BIGINT AS rank FROM t UNION ALL SELECT note_id, code, round(floor * 1e-3::DOUBLE / (j + 1), 9), n + j FROM m WHERE n + j < 4"""))
def shortlist_padded(spark, d):
    r = A.ranking(spark, d).select("note_id", "code", "score", (F.col("pos") - 1).alias("rank"))
    s = T.shortlist(r.where("rank < 2"), r.select("note_id", "code", "rank"), 4, pad=True)
    return s.select("note_id", "code", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("knn_tune", with_sql("gold ranking", """, t AS (SELECT round(0.05 * i, 2)::DOUBLE AS thr FROM range(1, 19) r(i)), s AS (SELECT thr, count(g.code) AS tp, count(*) AS n FROM t JOIN ranking r ON round(r.score, 12) >= thr LEFT JOIN gold g USING (note_id, code) GROUP BY thr),
f AS (SELECT thr, tp, n - tp AS fp, (SELECT count(*) FROM gold) - tp AS fn, round(2 * tp / (n + (SELECT count(*) FROM gold)), 4) AS f1 FROM s) SELECT *, row_number() OVER (ORDER BY f1 DESC, thr) = 1 AS best FROM f"""))
def knn_tune(spark, d):
    return T.knn_tune(A.gold(spark, d), A.ranking(spark, d).select("note_id", "code", "score"))


@query("exemplar_votes", _VOTE.replace("WITH ", "WITH RECURSIVE ", 1) + """, st AS (SELECT id, list_sort(list_distinct(list(code))) AS codes FROM lb WHERE code IS NOT NULL GROUP BY id), nb AS (SELECT item_id, top.id, score, rank, codes, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS n FROM top JOIN st USING (id) WHERE rank < 9),
g(item_id, n, sets, ids) AS (SELECT DISTINCT item_id, 0::BIGINT, []::VARCHAR[][], []::BIGINT[] FROM nb UNION ALL SELECT g.item_id, nb.n, CASE WHEN len(sets) < 3 AND len(list_filter(sets, lambda y: len(list_intersect(y, nb.codes)) / len(list_distinct(list_concat(y, nb.codes))) > 0.8)) = 0 THEN list_append(sets, nb.codes) ELSE sets END,
 CASE WHEN len(sets) < 3 AND len(list_filter(sets, lambda y: len(list_intersect(y, nb.codes)) / len(list_distinct(list_concat(y, nb.codes))) > 0.8)) = 0 THEN list_append(ids, nb.id) ELSE ids END FROM g JOIN nb ON nb.item_id = g.item_id AND nb.n = g.n + 1),
f AS (SELECT item_id, arg_max(ids, n) AS ids FROM g GROUP BY item_id), e AS (SELECT nb.item_id, nb.score, unnest(nb.codes) AS code FROM nb JOIN f ON f.item_id = nb.item_id AND list_contains(f.ids, nb.id))
SELECT item_id, code, round(sum(score), 6) AS vote, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(score), 12) DESC, code) - 1 AS rank FROM e WHERE code NOT LIKE 'Q%' GROUP BY item_id, code""")
def exemplar_votes(spark, d):
    """Over-fetched neighbours, diversified, vote for codes that the knowledge base has."""
    labels = _labels(spark, d)
    sets = labels.groupBy("id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    kb = labels.select("code").distinct().where("code not like 'Q%'")
    return T.exemplar_candidates(_top(spark, d, T.over_fetch(3)), sets, "item_id", kb).withColumn("vote", F.round("vote", 6))


# --- history ---------------------------------------------------------------------------------------------------------


_DAY = "2024-01-20"
_ON_DAY = _HIST.replace("ask AS (SELECT", f"ask0 AS (SELECT DISTINCT note_id, code FROM gold), ask AS (SELECT '' AS note_id, code, DATE '{_DAY}' AS as_of FROM (SELECT code FROM code_events UNION SELECT code FROM kb) UNION ALL SELECT", 1)


@query("active_on_day", _ON_DAY + f" SELECT code FROM ac WHERE active AND as_of = DATE '{_DAY}' AND code IN (SELECT code FROM code_events UNION SELECT code FROM k)")
def active_on_day(spark, d):
    return H.active_codes(A.code_events(spark, d), _kb_codes(spark, d), _DAY)


# --- training tables -------------------------------------------------------------------------------------------------


@query("label_vocabulary", with_sql("gold", "SELECT code, count(*) AS n FROM gold GROUP BY code HAVING count(*) >= 5"))
def label_vocabulary(spark, d):
    return V.label_vocabulary(A.gold(spark, d))


@query("sft_examples", with_sql("gold bins", """SELECT note_id, 'note ' || note_id AS prompt, '{"selected":["' || string_agg(code, '","' ORDER BY rank) || '"]}' AS completion FROM gold JOIN bins USING (code) GROUP BY note_id"""))
def sft_examples(spark, d):
    from ..operators.set_metrics import frequency_bins

    notes = A.note_ids(spark, d).withColumn("note_text", F.concat(F.lit("note "), F.col("note_id")))
    return V.sft_examples(notes, A.gold(spark, d), frequency_bins(A.gold(spark, d)))


@query("negatives", with_sql("gold ranking kb", """, x AS (SELECT r.note_id, r.code, (g.code IS NOT NULL)::INT AS label, family FROM ranking r LEFT JOIN gold g USING (note_id, code) LEFT JOIN kb USING (code)),
y AS (SELECT *, sum(label) OVER (PARTITION BY note_id) AS p, CASE WHEN family IS NULL THEN 0 ELSE max(label) OVER (PARTITION BY note_id, family) END AS sib, md5('42' || note_id || '/' || code) AS h FROM x),
b AS (SELECT *, CASE WHEN p > 0 THEN p * 1 ELSE 50 END AS budget, row_number() OVER (PARTITION BY note_id, label, sib ORDER BY h) AS nth FROM y), f AS (SELECT *, sib = 1 AND nth <= round_even(budget * 0.5, 0) AS first FROM b),
i AS (SELECT *, row_number() OVER (PARTITION BY note_id, label ORDER BY first DESC, h) AS i FROM f) SELECT note_id, code, label FROM i WHERE label = 1 OR i <= budget"""))
def negatives(spark, d):
    x = Q.pair_examples(A.ranking(spark, d).select("note_id", "code"), A.gold(spark, d))
    return Q.subsample_negatives(x, A.kb(spark, d).select("code", "family"), neg_per_pos=1).select("note_id", "code", "label")


@query("multi_hot", with_sql("gold", ", v AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS i FROM (SELECT code FROM gold GROUP BY code HAVING count(*) >= 5)) SELECT note_id, string_agg(i::VARCHAR, ' ' ORDER BY i) AS ones FROM gold JOIN v USING (code) GROUP BY note_id"))
def multi_hot(spark, d):
    m = V.multi_hot(A.gold(spark, d), V.label_vocabulary(A.gold(spark, d)))
    return m.select("note_id", F.array_join(F.transform("ones", lambda x: x.cast("string")), " ").alias("ones"))


@query("capped_merge", with_sql("ranking", ", s AS (SELECT note_id, pos % 3 AS src, code, pos FROM ranking), o AS (SELECT note_id, code, min(src * 1000 + pos) AS place FROM s GROUP BY ALL) SELECT note_id, string_agg(code, '|' ORDER BY place) AS codes FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY place) <= 4) GROUP BY note_id"))
def capped_merge(spark, d):
    """Lists of three sources, one after the other: first appearances, four at most."""
    lists = A.ranking(spark, d).groupBy("note_id", (F.col("pos") % 3).alias("src")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes"))
    all_ = lists.groupBy("note_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("src", "codes"))), lambda x: x["codes"]).alias("lists"))
    return all_.select("note_id", F.array_join(V.merge_lists(F.col("lists"), 4), "|").alias("codes"))


@query("topk_with_floor", with_sql("ranking rk", "SELECT note_id, code, r::BIGINT AS r FROM rk WHERE r <= 5 AND score >= 0.4"))
def topk_with_floor(spark, d):
    return R.top_k(A.ranking(spark, d), 5, 0.4).select("note_id", "code", F.col("r").cast("long").alias("r"))


@query("worst_recall", with_sql("gold ranking", "SELECT code, count(*) AS n, round(avg((r.code IS NOT NULL)::INT), 6) AS recall FROM gold LEFT JOIN ranking r USING (note_id, code) GROUP BY code ORDER BY round(avg((r.code IS NOT NULL)::INT), 6), n DESC, code LIMIT 10"))
def worst_recall(spark, d):
    return D.worst_codes(A.gold(spark, d), A.ranking(spark, d))


# --- export and collation --------------------------------------------------------------------------------------------

_ALLOWED = ("f1", "n_notes", "noted", "texts", "ids", "title")
_KEYS = ", ".join(f"({i}, '{k}', {str(k in L.DENIED).lower()})" for i, k in enumerate((*L.DENIED, *_ALLOWED)))


@query("leak_guard", f"""SELECT i, key, CASE WHEN denied THEN '{{}}' ELSE '{{"' || key || '": 1}}' END AS plain, CASE WHEN denied THEN '{{}}' ELSE '{{"' || upper(key) || '": 1}}' END AS upper_case, CASE WHEN denied THEN '{{"a": {{}}}}' ELSE '{{"a": {{"' || key || '": 1}}}}' END AS nested FROM (VALUES {_KEYS}) v(i, key, denied)""")
def leak_guard(spark, d):
    """Every denied key and some that are not, in lower and upper case, at the top and below."""
    x = spark.createDataFrame(list(enumerate((*L.DENIED, *_ALLOWED))), "i long, key string")
    wrap = lambda k, head, tail: L.guard_json(F.concat(F.lit(head), k, F.lit(tail)))["kept"]
    return x.select("i", "key", wrap(F.col("key"), '{"', '": 1}').alias("plain"), wrap(F.upper("key"), '{"', '": 1}').alias("upper_case"), wrap(F.col("key"), '{"a": {"', '": 1}}').alias("nested"))


@query("preferred_metric", "SELECT 'map' AS metric")
def preferred_metric(spark, d):
    """A metric that one cell lacks does not count; of the others the first in order."""
    n = A.table(spark, d, "nation").select(F.col("n_name").alias("system"), F.col("n_regionkey").cast("string").alias("corpus"), F.col("n_nationkey").alias("k"))
    cells = n.withColumn("metric", F.explode(F.array(*map(F.lit, ("micro_f1", "map", "ndcg"))))).withColumn("value", F.when((F.col("metric") != "micro_f1") | (F.col("k") != 3), F.col("k").cast("double")))
    return L.preferred_metric(cells, ["micro_f1", "map", "ndcg"])


# --- corpus ----------------------------------------------------------------------------------------------------------

_CORPUS = r"""WITH b AS (SELECT DISTINCT l_orderkey % 700 AS hadm_id, CASE l_linenumber % 4 WHEN 0 THEN '99213' WHEN 1 THEN lpad((l_partkey * 37 % 100000)::VARCHAR, 5, '0') WHEN 2 THEN 'G0463' ELSE 'J0585' END AS code FROM lineitem),
s AS (SELECT DISTINCT hadm_id FROM b WHERE TRY_CAST(code AS INT) BETWEEN 10004 AND 69990), f AS (SELECT * FROM b SEMI JOIN s USING (hadm_id) WHERE code <> 'G0463' AND NOT coalesce(TRY_CAST(code AS INT) BETWEEN 99202 AND 99499, false)),
c AS (SELECT hadm_id, list_sort(list(code)) AS codes FROM f GROUP BY hadm_id), n AS (SELECT doc_id::VARCHAR AS note_id, doc_id % 700 AS hadm_id, doc_id % 90 AS subject_id, text AS note_text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS words FROM documents),
o AS (SELECT n.*, codes FROM n JOIN c USING (hadm_id) QUALIFY row_number() OVER (PARTITION BY hadm_id ORDER BY note_id) = 1), l AS (SELECT * FROM o WHERE words >= 100), p AS (SELECT DISTINCT subject_id FROM l),
r AS (SELECT subject_id, row_number() OVER (ORDER BY md5('42' || subject_id::VARCHAR), subject_id) AS i, count(*) OVER () AS k FROM p), z AS (SELECT l.*, CASE WHEN i <= round_even(k * 0.2, 0) THEN 'test' WHEN i <= round_even(k * 0.2, 0) + round_even(k * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM l JOIN r USING (subject_id))"""


def _corpus(spark, d):
    code = F.when(F.col("l_linenumber") % 4 == 0, "99213").when(F.col("l_linenumber") % 4 == 1, F.lpad((F.col("l_partkey") * 37 % 100000).cast("string"), 5, "0")).when(F.col("l_linenumber") % 4 == 2, " g0463").otherwise("J0585")
    billing = A.table(spark, d, "lineitem").select((F.col("l_orderkey") % 700).alias("hadm_id"), F.lit(0).alias("subject_id"), code.alias("hcpcs_cd"))
    notes = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("note_id"), (F.col("doc_id") % 700).alias("hadm_id"), (F.col("doc_id") % 90).alias("subject_id"), F.col("text").alias("note_text"))
    return drivers.corpus_build(notes, billing)


@query("corpus_build", _CORPUS + " SELECT note_id, hadm_id, subject_id, note_text, array_to_string(codes, '|') AS proc_codes, split FROM z")
def corpus_build(spark, d):
    return _corpus(spark, d)["corpus"]


@query("corpus_manifest", _CORPUS + """ SELECT 0 AS step, 'billed encounters' AS name, count(DISTINCT hadm_id) AS n FROM b UNION ALL SELECT 1, 'with a surgical code', count(*) FROM s UNION ALL SELECT 2, 'with codes kept', count(*) FROM c UNION ALL SELECT 3, 'with a note', count(*) FROM o UNION ALL SELECT 4, 'long enough', count(*) FROM l""")
def corpus_manifest(spark, d):
    return _corpus(spark, d)["manifest"]


@query("corpus_splits", _CORPUS + " SELECT split, count(*) AS n_notes, count(DISTINCT subject_id) AS n_patients, sum(len(codes))::BIGINT AS n_instances FROM z GROUP BY split")
def corpus_splits(spark, d):
    return _corpus(spark, d)["splits"]
