"""Sinks. Spark's commit protocol makes a write appear whole or not at all."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import file_system, write_bytes


def prediction_rows(scored: DataFrame) -> DataFrame:
    """note_id, pred_codes, pred_scores (six decimals), pipe-joined by falling score."""
    held = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "code")))
    x = scored.groupBy("note_id").agg(held.alias("h"))
    return x.select("note_id", F.array_join(F.transform("h", lambda r: r["code"]), "|").alias("pred_codes"), F.array_join(F.transform("h", lambda r: F.format_string("%.6f", -r["s"])), "|").alias("pred_scores"))


def write_predictions(scored: DataFrame, path: str) -> None:
    prediction_rows(scored).write.mode("overwrite").csv(path, header=True, escape='"')


def write_scores(ranking: DataFrame, path: str) -> None:
    """The whole pool, a row a code."""
    ranking.write.mode("overwrite").parquet(path)


def generation_scores(predictions: DataFrame) -> DataFrame:
    """note_id, code, score of arrays of codes without scores: what comes first scores highest."""
    return predictions.select("note_id", F.size("codes").alias("n"), F.posexplode("codes").alias("i", "code")).select("note_id", "code", (F.col("n") - F.col("i")).cast("double").alias("score"))


def append_split(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("split").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> int:
    """One JSON object a row; the number of rows, counted as they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_metrics(metrics: dict[str, DataFrame], path: str, apart: tuple[str, ...] = ("per_code",), most: int = 10_000) -> dict:
    """One JSON file of small metric tables, keys sorted, and a text summary beside it; lists where a table has several rows. Tables named in
    ``apart`` have a row a code: they are written whole as Parquet beside the file, which names their place. Any other table of
    more than ``most`` rows is an error."""
    out = {}
    for name, df in metrics.items():
        if name in apart:
            out[name] = {"parquet": f"{path}.{name}.parquet"}
            df.write.mode("overwrite").parquet(out[name]["parquet"])
            continue
        rows = [r.asDict() for r in df.limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"metric table {name} has more than {most} rows; name it in apart")
        out[name] = rows[0] if len(rows) == 1 else rows
    spark = next(iter(metrics.values())).sparkSession
    write_bytes(spark, path, json.dumps(out, sort_keys=True, indent=1, default=str).encode())
    write_bytes(spark, f"{path}.summary.txt", summary(out).encode())
    return out


def summary(metrics: dict) -> str:
    """Names and values of one-row tables, a line each, for a reader."""
    lines = []
    for name, table in sorted(metrics.items()):
        if isinstance(table, dict) and "parquet" not in table:
            lines += [name, *(f"  {k}: {v:.6f}" if isinstance(v, float) else f"  {k}: {v}" for k, v in table.items())]
    return "\n".join(lines) + "\n"


def write_sections(df: DataFrame, path: str, names: list[str], column: str = "sections", key: str | None = None) -> None:
    """One column a section beside the original ones, and note_index if there is none: the hash of ``key``, else the row's place
    among all rows, for tables that one task can sort."""
    wide = df.select(*[c for c in df.columns if c != column], *[F.col(column)[n].alias(n) for n in names])
    if "note_index" not in wide.columns:  # by content, so that another partitioning gives the same numbers
        order = [F.col(c) for c in wide.columns]
        wide = wide.withColumn("note_index", F.row_number().over(Window.orderBy(*order)) - 1) if key is None else wide.withColumn("note_index", F.xxhash64(key))
    wide.write.mode("overwrite").csv(path, header=True, escape='"')


def cached(df_or_make, root: str, config: dict, spark, need: tuple[str, ...] = ()) -> DataFrame:
    """A table kept in a folder named by its configuration: made once, read afterwards. One that lacks a column of ``need`` (a
    pool kept without gold, say) is made anew."""
    name = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:20]
    path = f"{root}/{name}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    if not there or not set(need) <= set(spark.read.parquet(path).columns):
        (df_or_make() if callable(df_or_make) else df_or_make).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume(todo: DataFrame, done_path: str, key: str = "note_id") -> DataFrame:
    """Rows of ``todo`` that the output so far lacks; an output that is not there yet lacks all."""
    where, system = file_system(todo.sparkSession, done_path)
    if not system.exists(where):
        return todo
    return todo.join(todo.sparkSession.read.parquet(done_path).select(key).distinct(), key, "left_anti")
