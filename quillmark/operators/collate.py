"""Collation across corpora: rank correlation, governance of what may be quoted, export with a leak guard."""

from __future__ import annotations

import fnmatch
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_ranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Ascending ranks from 1; equal values share the mean of theirs."""
    by = df.groupBy(value).agg(F.count("*").alias("_k"))
    w = Window.orderBy(value)
    by = by.select(F.col(value).alias("_v"), (F.sum("_k").over(w) - (F.col("_k") - 1) / 2).alias(out))
    return df.join(by, F.col(value) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, rho by the correlation of average ranks; null under three rows."""
    x = average_ranks(average_ranks(df.select(a, b), a, "_ra"), b, "_rb")
    return x.agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 3, F.corr("_ra", "_rb")), 4).alias("rho"))


def concordance(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: concordant and discordant pairs, and (c - d) / (c + d), ties left out. Pairs are counted, not made: values are
    grouped, and the grouped table, one row a pair of values, is compared with itself."""
    g = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("k"))
    h = g.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("k").alias("k2"))
    p = g.join(h, F.col("a") < F.col("a2"))
    s = p.agg(F.coalesce(F.sum(F.when(F.col("b") < F.col("b2"), F.col("k") * F.col("k2"))), F.lit(0)).alias("concordant"), F.coalesce(F.sum(F.when(F.col("b") > F.col("b2"), F.col("k") * F.col("k2"))), F.lit(0)).alias("discordant"))
    return s.withColumn("gamma", F.round(F.when(F.col("concordant") + F.col("discordant") > 0, (F.col("concordant") - F.col("discordant")) / (F.col("concordant") + F.col("discordant"))), 4))


def floor_ranks(values: dict[str, float], floor: float) -> dict[str, float]:
    """Descending ranks of a few systems; values within ``floor`` of the first of their group tie and share its mean rank."""
    order = sorted(values, key=lambda k: (-values[k], k))
    out, i = {}, 0
    while i < len(order):
        j = i
        while j < len(order) and values[order[i]] - values[order[j]] <= floor:
            j += 1
        for k in order[i:j]:
            out[k] = (i + 1 + j) / 2
        i = j
    return out


def path_matches(path: str, pattern: str) -> bool:
    """Equal, below, or by glob, where * crosses dots."""
    return path == pattern or path.startswith(pattern + ".") or fnmatch.fnmatchcase(path, pattern) or fnmatch.fnmatchcase(path, pattern + ".*")


def path_condition(path: Column, pattern: str) -> Column:
    """path_matches as a column expression."""
    glob = re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".")
    return path.rlike(rf"^{glob}(\..*)?$")


def govern(metrics: DataFrame, suppress: list[str], caveats: dict[str, str]) -> DataFrame:
    """metrics (path, value) with status (ok, caveat, suppressed) and note; suppression comes before any caveat."""
    p = F.col("path")
    hidden = F.lit(False)
    for s in suppress:
        hidden = hidden | path_condition(p, s)
    note = F.coalesce(*[F.when(path_condition(p, k), F.lit(v)) for k, v in caveats.items()], F.lit(None).cast("string")) if caveats else F.lit(None).cast("string")
    x = metrics.withColumn("_hidden", hidden).withColumn("note", note)
    return x.select("path", F.when(~F.col("_hidden"), F.col("value")).alias("value"), F.when(F.col("_hidden"), "suppressed").when(F.col("note").isNotNull(), "caveat").otherwise("ok").alias("status"), F.when(~F.col("_hidden"), F.col("note")).alias("note"))


def preferred_metric(cells: DataFrame, order: list[str]) -> DataFrame:
    """The first metric of ``order`` that every system has on every corpus. cells: corpus, system, metric, value."""
    n = cells.select("corpus", "system").distinct().agg(F.count("*").alias("n"))
    full = cells.where("value is not null").groupBy("metric").agg(F.count_distinct("corpus", "system").alias("k")).crossJoin(n).where("k = n")  # one row
    place = F.array_position(F.array(*map(F.lit, order)), F.col("metric"))
    return full.where(place > 0).orderBy(place).limit(1).select("metric")


# Keys that never leave the site.
DENIED = (
    "note_id", "note_ids", "note_index", "note_text", "notes_text", "text", "subject_id", "subject_ids", "hadm_id", "hadm_ids", "encounter_csn_id",
    "pat_mrn_id", "mrn", "patient_id", "snippet", "snippets", "evidence", "raw_text", "full_text", "report_text", "note", "rows", "records",
    "per_note", "examples_text",
)


def guard(node, deny=DENIED, max_str: int = 200, max_list: int = 64, path: str = "") -> tuple[object, list[str]]:
    """A JSON tree without denied keys (whatever their case), texts of several lines, long texts and long lists, which also leave
    lists that hold them; and the paths dropped."""
    if isinstance(node, dict):
        out, dropped = {}, []
        for k, v in node.items():
            here = f"{path}.{k}" if path else k
            if str(k).lower() in deny:
                dropped.append(here)
                continue
            kept, more = guard(v, deny, max_str, max_list, here)
            dropped += more
            if here not in more:
                out[k] = kept
        return out, dropped
    if isinstance(node, list):
        if len(node) > max_list:
            return None, [path]
        pairs = [guard(v, deny, max_str, max_list, f"{path}[]") for v in node]
        return [v for v, more in pairs if f"{path}[]" not in more], sorted({x for _, more in pairs for x in more})
    if isinstance(node, str) and ("\n" in node or "\r" in node or len(node) > max_str):
        return None, [path]
    return node, []


def guard_json(column: Column, deny=DENIED, max_str: int = 200, max_list: int = 64) -> Column:
    """``guard`` of a column of JSON objects: struct of kept (JSON with sorted keys) and dropped (paths)."""
    @F.pandas_udf("kept string, dropped array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [guard(json.loads(t), deny, max_str, max_list) for t in texts]
        return pd.DataFrame({"kept": [json.dumps(k, sort_keys=True) for k, _ in rows], "dropped": [d for _, d in rows]})

    return run(column)


def markdown(rows: list[dict], columns: list[str], digits: int = 4) -> str:
    """A table of a collected summary; the best number of each column is bold, suppressed cells are dashes."""
    show = lambda v: "—" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    best = {c: max((r[c] for r in rows if isinstance(r.get(c), float)), default=None) for c in columns}
    line = lambda r: "| " + " | ".join(f"**{show(r.get(c))}**" if r.get(c) is not None and r.get(c) == best[c] else show(r.get(c)) for c in columns) + " |"
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *map(line, rows)])
