"""Filters of notes, codes and records, with the tallies that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import n_words
from .history import is_active


def long_enough(notes: DataFrame, min_tokens: int = 100, count: str | None = None, text: str | None = "note_text") -> DataFrame:
    """Notes of at least min_tokens by a count column, else by words; without either all pass."""
    if count is not None and count in notes.columns:
        return notes.where(F.col(count).try_cast("double") >= min_tokens)
    return notes.where(n_words(F.col(text)) >= min_tokens) if text in notes.columns else notes


def with_codes(notes: DataFrame, codes: str) -> DataFrame:
    return notes.where(F.size(codes) > 0)


def label_tallies(notes: DataFrame, codes: str) -> DataFrame:
    """One row: notes, and those that ``with_codes`` drops."""
    return notes.agg(F.count("*").alias("rows_in"), F.sum((F.size(codes) <= 0).cast("int")).alias("rows_no_codes"))


def in_kb(codes: DataFrame, kb: DataFrame) -> DataFrame:
    return codes.join(kb.select("code").distinct(), "code", "left_semi")


def kb_tallies(codes: DataFrame, kb: DataFrame) -> DataFrame:
    """One row: codes emitted, those dropped, and notes with a drop."""
    k = kb.select("code", F.lit(1).alias("known")).distinct()
    x = codes.join(k, "code", "left")
    return x.agg(F.count("*").alias("emitted"), F.sum(F.col("known").isNull().cast("int")).alias("dropped"), F.count_distinct(F.when(F.col("known").isNull(), F.col("note_id"))).alias("notes_hit"))


def respond(codes: DataFrame, level: str, kb: DataFrame, candidates: DataFrame) -> DataFrame:
    """Codes of a response held to the candidates of their note, to the knowledge base, or to nothing."""
    if level == "candidates":
        return codes.join(candidates.select("note_id", "code").distinct(), ["note_id", "code"], "left_semi")
    return in_kb(codes, kb) if level == "kb" else codes


def active_only(codes: DataFrame, as_of: str, events: DataFrame, kb: DataFrame) -> DataFrame:
    """Codes in force on a day."""
    asked = codes.select("code").distinct().withColumn("as_of", F.lit(as_of).cast("date"))
    return codes.join(is_active(asked, events, kb).where("active").select("code"), "code", "left_semi")


def grounded(ledger: DataFrame) -> DataFrame:
    """Ledger rows that were selected and carry a snippet."""
    return ledger.where(F.col("selected_pre_rule") & (F.trim(F.coalesce("evidence_snippet", F.lit(""))) != ""))


def grounding_tallies(ledger: DataFrame) -> DataFrame:
    """One row: ledger rows, those selected, and those selected that lack a snippet."""
    chosen = F.col("selected_pre_rule")
    blank = F.trim(F.coalesce("evidence_snippet", F.lit(""))) == ""
    return ledger.agg(F.count("*").alias("n"), F.sum(chosen.cast("int")).alias("selected"), F.sum((chosen & blank).cast("int")).alias("without_snippet"))


def section_override(notes: DataFrame, sections: DataFrame, text: str = "note_text") -> DataFrame:
    """notes with the text of ``sections`` (note_id, section_text, and ``place`` if there are several sources: the last one
    counts, blank or not) where it is not blank."""
    last = F.max_by("section_text", "place") if "place" in sections.columns else F.max("section_text")
    s = sections.groupBy("note_id").agg(last.alias("_s"))
    given: Column = F.nullif(F.trim(F.coalesce("_s", F.lit(""))), F.lit(""))
    return notes.join(s, "note_id", "left").withColumn(text, F.when(given.isNotNull(), F.col("_s")).otherwise(F.col(text))).drop("_s")
