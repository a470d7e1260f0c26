"""Temporal code history: which codes are in force on a day, and what replaces them.

Canonical inputs: events(code, change_type, effective_date, crosswalk_code, ...), kb(code), asked(code, as_of).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.codes import codes_in_prose
from ..sources.scratch import kept


def reconcile(annual: DataFrame, deletions: DataFrame) -> DataFrame:
    """Annual events (code, change_type, year, crosswalk_code) with the precise dates of deletions (code, deleted_date,
    substitute_code): code, change_type, effective_date, crosswalk_code, source.

    A deletion dates the code's deleted event of that year, the first if there are several, and fills a missing crosswalk; a
    deletion without one is an event of its own. Events alike in code, type, date and source stand once."""
    nth = F.row_number().over(Window.partitionBy("code", "change_type", "year").orderBy(F.col("crosswalk_code").asc_nulls_last()))
    a = annual.withColumn("nth", nth)
    d = deletions.where("deleted_date is not null").select(F.col("code").alias("dc"), "deleted_date", "substitute_code", F.year("deleted_date").alias("dy")).withColumn("dnth", F.row_number().over(Window.partitionBy("dc", "dy").orderBy("deleted_date", F.col("substitute_code").asc_nulls_last())))
    on = (F.col("code") == F.col("dc")) & (F.col("year") == F.col("dy")) & (F.col("change_type") == "deleted") & (F.col("nth") == F.col("dnth"))
    j = a.join(d, on, "full_outer")
    merged = j.select(
        F.coalesce("code", "dc").alias("code"), F.coalesce("change_type", F.lit("deleted")).alias("change_type"),
        F.coalesce("deleted_date", F.make_date("year", F.lit(1), F.lit(1))).alias("effective_date"), F.coalesce("crosswalk_code", "substitute_code").alias("crosswalk_code"),
        F.when(F.col("dc").isNull(), "code_changes").when(F.col("code").isNull(), "deleted_codes").otherwise("code_changes+deleted_codes").alias("source"),
    )
    first = F.row_number().over(Window.partitionBy("code", "change_type", "effective_date", "source").orderBy(F.col("crosswalk_code").asc_nulls_last()))
    return merged.withColumn("_n", first).where("_n = 1").drop("_n")


def is_active(asked: DataFrame, events: DataFrame, kb: DataFrame) -> DataFrame:
    """code, as_of, active. The last new or deleted event up to the day decides (new wins a day it shares); before the first,
    a code is in force unless that first event makes it new; without any, if the knowledge base has it."""
    days = asked.select("code", "as_of").distinct()
    state = events.where(F.col("change_type").isin("new", "deleted")).select("code", "change_type", "effective_date")
    key = F.struct("effective_date", "change_type")
    j = days.join(state, "code", "left").groupBy("code", "as_of").agg(
        F.max(F.when(F.col("effective_date") <= F.col("as_of"), key)).alias("last"), F.min(key).alias("first"), F.count("effective_date").alias("n")
    )
    known = kb.select("code", F.lit(True).alias("known")).distinct()
    out = j.join(known, "code", "left")
    active = F.when(F.col("n") == 0, F.coalesce("known", F.lit(False))).when(F.col("last").isNotNull(), F.col("last.change_type") == "new").otherwise(F.col("first.change_type") != "new")
    return out.select("code", "as_of", active.alias("active"))


def crosswalk(asked: DataFrame, events: DataFrame, kb: DataFrame, depth: int = 5) -> DataFrame:
    """code, as_of, substitute of codes not in force on the day: depth-first through the codes that the latest deletion names,
    the first one in force; null if there is none within ``depth`` steps.

    Each round follows every open path one step for all codes at once; a path is an array of ordinals, and the first path in
    that order is the one that a depth-first search meets first among those found."""
    days = asked.select("code", "as_of").distinct()
    deleted = events.where("change_type = 'deleted'")
    text = F.coalesce(F.nullif(F.trim("crosswalk_code"), F.lit("")), *([F.col("new_descriptor")] if "new_descriptor" in events.columns else []))
    named = deleted.select(F.col("code").alias("from"), "effective_date", codes_in_prose(text).alias("subs"))

    open_ = days.select("code", "as_of", F.col("code").alias("at"), F.array("code").alias("seen"), F.array().cast("array<int>").alias("path"))
    act = kept(is_active(days, events, kb))
    open_ = open_.join(act.where(~F.col("active")).select("code", "as_of"), ["code", "as_of"], "left_semi")
    answers = None
    for _ in range(depth):
        step = open_.join(named, (F.col("at") == F.col("from")) & (F.col("effective_date") <= F.col("as_of")))
        latest = step.groupBy("code", "as_of", "at", "seen", "path").agg(F.max(F.struct("effective_date", "subs")).alias("m"))
        nxt = latest.select("code", "as_of", "seen", "path", F.posexplode("m.subs").alias("ord", "to")).where(~F.array_contains("seen", F.col("to")))
        state = is_active(nxt.select(F.col("to").alias("code"), "as_of"), events, kb).select(F.col("code").alias("to"), "as_of", "active")
        # Written for its two readers, and to keep plans short.
        nxt = kept(nxt.join(state, ["to", "as_of"]).withColumn("path", F.concat("path", F.array("ord"))))
        found = nxt.where("active").select("code", "as_of", "path", F.col("to").alias("substitute"))
        answers = found if answers is None else answers.unionByName(found)
        open_ = nxt.where(~F.col("active")).select("code", "as_of", F.col("to").alias("at"), F.concat("seen", F.array("to")).alias("seen"), "path")
    # Paths compare as arrays, which is the order of a depth-first search.
    best = answers.groupBy("code", "as_of").agg(F.min_by("substitute", "path").alias("substitute"))
    return act.where(~F.col("active")).select("code", "as_of").join(best, ["code", "as_of"], "left")


def advice(events: DataFrame, asked: DataFrame, years: int = 1) -> DataFrame:
    """Events of the asked codes whose year is within ``years`` of the day's."""
    return asked.join(events, "code").where(F.abs(F.year("effective_date") - F.year("as_of")) <= years)


def enrich(rows: DataFrame, events: DataFrame, kb: DataFrame, codes: str = "codes", as_of: str = "as_of") -> DataFrame:
    """note_id, codes_on_date, codes_crosswalked, n_retired, n_crosswalked. rows: note_id, codes (array), as_of.

    A row without a day passes through with zeros; crosswalked codes are not deduplicated, those without a substitute go."""
    each = rows.select("note_id", F.col(as_of).alias("as_of"), F.posexplode_outer(codes).alias("pos", "code"))
    days = each.where("as_of is not null and code is not null").select("code", "as_of").distinct()
    act = is_active(days, events, kb)
    sub = crosswalk(days, events, kb)
    j = each.join(act, ["code", "as_of"], "left").join(sub, ["code", "as_of"], "left")
    dated, alive = F.col("as_of").isNotNull(), F.coalesce("active", F.lit(False))

    def ordered(value: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct("pos", value.alias("v"))))), lambda x: x["v"])

    return j.groupBy("note_id").agg(
        ordered(F.when(~dated | alive, F.col("code"))).alias("codes_on_date"), ordered(F.when(~dated | alive, F.col("code")).otherwise(F.col("substitute"))).alias("codes_crosswalked"),
        F.sum((dated & F.col("code").isNotNull() & ~alive).cast("int")).alias("n_retired"), F.sum((dated & ~alive & F.col("substitute").isNotNull()).cast("int")).alias("n_crosswalked"),
    )


def event_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("change_type").agg(F.count("*").alias("n_events"), F.count_distinct("code").alias("n_codes"))


def family(kb: DataFrame, levels: int = 6) -> DataFrame:
    """code, family, level: the deepest range before the first blank one."""
    ranges = F.array(*[F.nullif(F.trim(F.col(f"code_range_{i}")), F.lit("")) for i in range(1, levels + 1)])
    depth = F.coalesce(F.nullif(F.array_position(F.transform(ranges, lambda x: F.coalesce(x, F.lit(""))), ""), F.lit(0)) - 1, F.lit(levels)).cast("int")
    return kb.select("code", F.when(depth > 0, F.element_at(ranges, F.greatest(depth, F.lit(1)))).alias("family"), depth.alias("level"))


def siblings(kb: DataFrame, levels: int = 6) -> DataFrame:
    """code, sibling: codes with the same range at the code's own deepest level, however deep they go themselves."""
    fam = family(kb, levels).where("family is not null")
    ranges = kb.select(F.col("code").alias("sibling"), F.posexplode(F.array(*[F.trim(F.col(f"code_range_{i}")) for i in range(1, levels + 1)])).alias("l", "range"))
    return fam.join(ranges, (F.col("family") == F.col("range")) & (F.col("level") == F.col("l") + 1)).where("code <> sibling").select("code", "sibling")


def active_codes(events: DataFrame, kb: DataFrame, as_of: str) -> DataFrame:
    """All codes of events and knowledge base that are in force on a day."""
    every = events.select("code").union(kb.select("code")).distinct().withColumn("as_of", F.lit(as_of).cast("date"))
    return is_active(every, events, kb).where("active").select("code")


def crosswalk_map(events: DataFrame, kb: DataFrame, as_of: str, depth: int = 5) -> DataFrame:
    """code, substitute of every code with events that is not in force on a day and has a substitute."""
    asked = events.select("code").distinct().withColumn("as_of", F.lit(as_of).cast("date"))
    return crosswalk(asked, events, kb, depth).where("substitute is not null").select("code", "substitute")


def crosswalk_set(codes: DataFrame, events: DataFrame, kb: DataFrame, as_of: str, keep_unresolved: bool = False) -> DataFrame:
    """note_id, code: sets of codes as of a day; codes not in force become their substitute, or go, or stay if asked."""
    days = codes.select("code").distinct().withColumn("as_of", F.lit(as_of).cast("date"))
    x = codes.join(is_active(days, events, kb).select("code", "active"), "code").join(crosswalk(days, events, kb).select("code", "substitute"), "code", "left")
    new = F.when(F.col("active"), F.col("code")).otherwise(F.coalesce("substitute", F.col("code") if keep_unresolved else F.lit(None).cast("string")))
    return x.select("note_id", new.alias("code")).where("code is not null").distinct()
