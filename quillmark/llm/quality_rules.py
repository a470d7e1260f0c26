"""Rule bitmask ledger.

Every rule is evaluated once a document. The ledger stores the measurements and
one long whose bit i says that rule i failed; policies are named masks over
those bits, so a new policy or an ablation reads the ledger and no text.
DataFrame functions only, no shuffle: a document is measured inside its row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, fresh, table


@dataclass(frozen=True)
class Rule:
    """``fails`` gets the struct of measurements and says whether the document fails; null counts as not failing."""

    name: str
    fails: Callable[[Column], Column]


#: Bit i of the ledger is RULES[i]; append only, so that stored ledgers keep their meaning.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    Rule("duplicate_lines", lambda m: (m["n_dup_lines"] >= 3) & (100 * m["n_dup_lines"] > 30 * m["n_lines"])),
    Rule("shouting", lambda m: 100 * m["n_upper"] > 40 * m["word_chars"]),
    Rule("word_length", lambda m: (m["word_chars"] > 40 * m["n_words"])),
    Rule("stutter", lambda m: 100 * m["n_stutter"] > 25 * m["n_words"]),
)
BASE = ("few_words", "repeated_windows")

#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "base-1": BASE,
    "strict-1": tuple(r.name for r in RULES),
}

WINDOW = 5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words that is found twice or more in the text, each word once.

    Windows are compared by 64-bit hashes; only a text in which some hash recurs pays for the sort by (hash, place).
    """
    n = F.size(words)

    def places(h: Column) -> Column:
        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = _let(at, lambda z: F.filter(z, lambda s, i: (s["h"] == F.get(z, i - 1)["h"]) | (s["h"] == F.get(z, i + 1)["h"])))
        return F.sort_array(F.transform(twice, lambda s: s["p"]))

    def covered(p: Column) -> Column:
        spans = F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(p, i + 1) - x), F.lit(WINDOW)))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    windows = F.transform(
        F.arrays_zip(*[F.slice(words, F.lit(i + 1), n - (WINDOW - 1)) for i in range(WINDOW)]), lambda w: F.xxhash64(w)
    )
    some = _let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(places(h), covered)),
    )
    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(some)


def measurements(text: Column) -> Column:
    """Struct of long measurements of the whole text; null text has no words."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, WORD_SEPARATORS + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(
        words,
        lambda w: _let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                F.size(ls).cast("long").alias("n_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_stutter"),
            ),
        ),
    )


def _bits(m: Column, rules: tuple[Rule, ...]) -> Column:
    out = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        out = out.bitwiseOR(F.when(F.coalesce(r.fails(m), F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def mask(names, rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << i for i, r in enumerate(rules) if r.name in set(names))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measured: str = "measured", failed: str = "failed_rules") -> DataFrame:
    """``docs`` with a struct ``measured`` and a long ``failed`` (bit i: rule i failed). Reads ``text`` alone; other
    columns pass, and columns of those two names are replaced. Null or empty text: zero in all measurements, so that
    few_words fails. Repeated rows are measured each; an empty table stays empty."""
    m = docs.withColumn(measured, measurements(docs["text"]))
    return m.withColumn(failed, _bits(F.col(measured), rules))


def passes(failed: Column, policy: str, rules: tuple[Rule, ...] = RULES) -> Column:
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy], rules)).cast("long")) == 0


def ablation(ledger_df: DataFrame, policy: str, failed: str = "failed_rules", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of ``policy``: documents failing it, failing it alone (what dropping the rule would let in), and
    kept without it. The ledger is first reduced to one row per distinct bit set, at most 2 to the number of rules."""
    full = mask(POLICIES[policy], rules)
    sets = ledger_df.groupBy(F.col(failed).bitwiseAND(F.lit(full).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if full >> i & 1])
    each = sets.withColumn("r", F.explode(named))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    bit = F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        n(F.col("bits").bitwiseAND(bit) != 0).alias("failing"),
        n(F.col("bits") == bit).alias("failing_alone"),
        n((F.col("bits") == 0) | (F.col("bits") == bit)).alias("kept_without"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ~passes(F.col("failed_rules"), "base-1")
    m = F.col("measured")
    return done.select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"), passes(F.col("failed_rules"), "strict-1").alias("kept"), "failed_rules",
    )


def keep_good(docs: DataFrame, policy: str = "strict-1") -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, with their own columns alone, whatever their names. Null and empty text fail
    few_words and go; repeated rows stay or go alike; an empty table stays empty."""
    measured, failed = fresh("measured", docs.columns), fresh("failed_rules", docs.columns)
    return ledger(docs, measured=measured, failed=failed).where(passes(F.col(failed), policy)).drop(measured, failed)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '\p{Lu}')) AS n_upper,
             len(list_filter(w, lambda x, i: x = w[i - 1])) AS n_stutter
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END)
             + (CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN 100 * n_upper > 40 * word_chars THEN 16 ELSE 0 END)
             + (CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN 100 * n_stutter > 25 * n_words THEN 64 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed,
       bits = 0 AS kept, bits::BIGINT AS failed_rules FROM b
"""
