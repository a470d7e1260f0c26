"""Dates of rule and history files. Every parse gives null for what it cannot read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names of deletion lists.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def compact_date(text: Column) -> Column:
    """yyyyMMdd; blank and * are null."""
    return F.when(F.trim(text).rlike(r"^\d{8}$"), F.try_to_timestamp(F.trim(text), F.lit("yyyyMMdd")).cast("date"))


def julian_date(text: Column) -> Column:
    """YYYYDDD; a day count beyond the year runs on into the next."""
    t = F.trim(text)
    ok = t.rlike(r"^\d{7}$") & (F.substring(t, 5, 3) != "000") & (F.substring(t, 1, 4) != "0000")
    first = F.make_date(F.substring(t, 1, 4).try_cast("int"), F.lit(1), F.lit(1))
    return F.when(ok, F.date_add(first, F.substring(t, 5, 3).try_cast("int") - 1))


def deleted_date(text: Column, cutoff: int = 40) -> Column:
    """D-MMM-YY; years up to ``cutoff`` are of this century."""
    t = F.lower(F.trim(text))
    part = lambda i: F.regexp_extract(t, r"^(\d{1,2})-([a-z]{3})-(\d{2})$", i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(2))
    yy = part(3).try_cast("int")
    year = yy + F.when(yy <= cutoff, 2000).otherwise(1900)
    iso = F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.when((part(1) != "") & (month > 0), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


def procedure_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "M/d/yyyy H:mm", "yyyyMMdd")) -> Column:
    """The first of an explicit list of formats that fits."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats]).cast("date")


def year_stratum(date: Column) -> Column:
    return F.coalesce(F.year(date).cast("string"), F.lit("UNK"))


def in_force(on: Column, effective: Column, deleted: Column) -> Column:
    """Open bounds are null."""
    return (effective.isNull() | (effective <= on)) & (deleted.isNull() | (deleted >= on))
