"""Structured Streaming over code events; each stream has a batch twin, which the same function makes of a batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their value by window and type; rows later than the watermark are left out of a stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").cast("string").alias("window_start"), "event_type", "n", F.round("value", 4).alias("value"))


def upsert_latest(spark: SparkSession, events: DataFrame, target: str, checkpoint: str):
    """A table of the latest event of each code, kept by batches: each batch is merged with the version before it and written as
    the next version, so a repeated batch writes the same version again."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
        if batch_id:
            latest = latest.unionByName(spark.read.parquet(f"{target}/v={batch_id - 1}")).groupBy("user_id").agg(F.max("m").alias("m"))
        latest.write.mode("overwrite").parquet(f"{target}/v={batch_id}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
