"""Procedure codes as column expressions: shapes, parsing, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes of codes after upper-casing.
SHAPE = r"(?:\d{5}|\d{4}[AFMTU]|[A-Z]\d{4})"
CATEGORIES = ("CPT_I", "CPT_II", "CPT_III", "PLA", "MAAA", "HCPCS")
# Surgical range, evaluation-and-management range, HCPCS codes that name no procedure.
SURGERY = (10004, 69990)
EVALUATION = (99202, 99499)
NON_PROCEDURAL = ("G0378", "G0379", "G0380", "G0381", "G0382", "G0383", "G0384", "G0425", "G0426", "G0427", "G0463", "G0316", "G0317", "G0318", "G2212")
# Fixed value: how a change note names codes.
PROSE_CODE = r"(?<![A-Za-z0-9])(?:\d{4}[A-Z]|\d{5}|[A-Z]\d{4})(?![A-Za-z0-9])"


def norm(code: Column) -> Column:
    return F.upper(F.trim(code))


def pipe_split(codes: Column) -> Column:
    """Codes of a pipe-joined column: trimmed, upper-cased, blanks dropped, order and repeats kept; null is empty."""
    parts = F.transform(F.split(F.coalesce(codes, F.lit("")), r"\|"), norm)
    return F.filter(parts, lambda x: x != "")


def pipe_join(codes: Column) -> Column:
    return F.array_join(codes, "|")


def find_codes(text: Column) -> Column:
    """Distinct code shapes in free text, first appearance first; a code next to a letter or digit is none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)(?<![A-Za-z0-9]){SHAPE}(?![A-Za-z0-9])"), F.lit(0))
    return F.array_distinct(F.transform(found, F.upper))


def codes_in_prose(text: Column) -> Column:
    """Codes that a change note names: case-sensitive, any letter as suffix."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PROSE_CODE), F.lit(0)))


def has_shape(code: Column) -> Column:
    return F.coalesce(norm(code).rlike(f"^{SHAPE}$"), F.lit(False))


def strip_modifier(token: Column) -> Column:
    """The five-character code that a billing token begins with, or null."""
    t = norm(token)
    first = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return F.coalesce(first(rf"^({SHAPE})$"), first(r"^([A-Z]\d{4})"), first(r"^(\d{5})"), first(r"^(\d{4}[AFMTU])"))


def category(code: Column) -> Column:
    c = norm(code)
    out = F.when(c.rlike(r"^\d{5}$"), "CPT_I").when(c.rlike(r"^[A-Z]\d{4}$"), "HCPCS")
    for suffix, name in (("F", "CPT_II"), ("T", "CPT_III"), ("U", "PLA"), ("M", "MAAA")):
        out = out.when(c.rlike(rf"^\d{{4}}{suffix}$"), name)
    return out.otherwise("UNKNOWN")


def _number(code: Column) -> Column:
    return F.when(norm(code).rlike(r"^\d{5}$"), norm(code).try_cast("int"))


def is_surgical(code: Column, low: int = SURGERY[0], high: int = SURGERY[1]) -> Column:
    return F.coalesce(_number(code).between(low, high), F.lit(False))


def is_non_procedural(code: Column) -> Column:
    return F.coalesce(_number(code).between(*EVALUATION), F.lit(False)) | norm(code).isin(*NON_PROCEDURAL)


def passes_filter(code: Column, mode: str) -> Column:
    """Code filter of a corpus build: none, surgery or procedural."""
    return {"none": F.lit(True), "surgery": is_surgical(code), "procedural": ~is_non_procedural(code)}[mode]


def section(code: Column) -> Column:
    """Coarse section: what is not five digits is hcpcs2, and five digits outside the four named ranges are medicine."""
    n = _number(code)
    return (
        F.when(n.isNull(), "hcpcs2").when(n.between(*SURGERY), "surgery").when(n.between(*EVALUATION), "em")
        .when(n.between(70010, 79999), "radiology").when(n.between(80047, 89398), "pathology").otherwise("medicine")
    )


def size_bucket(n: Column) -> Column:
    return F.when(n <= 1, "single").when(n <= 4, "small").otherwise("large")


def normalize_codes(notes: DataFrame, raw: str, kb_codes: DataFrame, note_id: str = "note_id") -> DataFrame:
    """note_id, accepted, unresolved, dropped (arrays in order of appearance): tokens of ``raw`` split on , ; | and blanks.

    accepted and unresolved are told apart by ``kb_codes`` (one column, code) and hold each base code once; tokens without
    a code are dropped, as often as they stand. The knowledge base is joined, not looked up on the driver.
    """
    tokens = F.filter(F.split(F.coalesce(F.col(raw), F.lit("")), r"[,;|\s]+"), lambda x: x != "")
    each = notes.select(note_id, F.posexplode_outer(tokens).alias("pos", "token")).withColumn("base", strip_modifier(F.col("token")))
    known = kb_codes.select(norm(F.col("code")).alias("base")).distinct().withColumn("known", F.lit(True))
    each = each.join(known, "base", "left")

    def ordered(condition: Column, value: str) -> Column:
        held = F.sort_array(F.collect_list(F.when(condition, F.struct("pos", F.col(value).alias("v")))))
        return F.transform(held, lambda x: x["v"])

    base, known_ = F.col("base").isNotNull(), F.coalesce(F.col("known"), F.lit(False))
    return each.groupBy(note_id).agg(
        F.array_distinct(ordered(base & known_, "base")).alias("accepted"),
        F.array_distinct(ordered(base & ~known_, "base")).alias("unresolved"),
        ordered(~base & F.col("token").isNotNull(), "token").alias("dropped"),
    )
