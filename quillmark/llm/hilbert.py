"""Sharding along a Hilbert curve.

Metadata dimensions are quantised, rows are sorted by their place on the Hilbert
curve through those cells, and the order is cut into runs, so that files of a
shard cover a small box of every dimension and prune by any of them. Rows with
equal texts take the cell of the first of them and so lie side by side.
The order is a range partitioning of slim rows (no text) with the id as the last
key, so one hot cell or group of copies spreads over partitions.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table

#: Bits a dimension.
ORDER = 8


def hilbert_index(axes: np.ndarray, bits: int = ORDER) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``axes`` (n rows, d columns of integers below 2**bits), d * bits <= 63.

    Gray-code form of the transform: bit planes from the top, undoing the reflection and exchange of each plane."""
    x = np.array(axes, dtype=np.int64).T.copy()
    d = len(x)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for i in range(d):
            set_ = (x[i] >> plane) & 1 == 1
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip = np.where((x[d - 1] >> plane) & 1 == 1, flip ^ ((1 << plane) - 1), flip)
    x ^= flip
    out = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> plane) & 1)
    return out


def text_size(text: Column) -> Column:
    """UTF-8 bytes and eight more; null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _named(c: Column) -> Column:
    """A name dimension: equal names share a cell. Null is the cell 0."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c.cast("string")), F.lit(1 << ORDER))).cast("int")


def _sized(c: Column) -> Column:
    """A size dimension on a log scale, eight cells a doubling."""
    return F.least(F.floor(F.log2(c.cast("double")) * 8), F.lit((1 << ORDER) - 1)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, hilbert (place on the curve), shard, slot of every row of ``docs``.

    Law ``rows``: counts of shards are at most one apart, slots are gapless from 0. Null names have a cell of their own,
    null and empty text count as empty text, a null doc_id sorts first, repeated rows get slots of their own, an empty
    table gives no rows. Columns of ``dims`` that ``docs`` lacks count as null; ids may be of any type; other columns, whatever their
    names, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    col = lambda c: docs[c] if c in docs.columns else F.lit(None)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    size = text_size(docs["text"])
    rows = scratch.keep(
        docs.select(
            docs["doc_id"].alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("same"), F.array(*[_named(col(d)) for d in dims], _sized(size)).alias("cell"),
        )
    )
    groups = scratch.keep(rows.groupBy("same").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "cell"))["cell"].alias("first_cell")).where("n > 1").select(F.col("same").alias("_same"), "first_cell"))
    placed = rows.join(groups, F.col("same") == F.col("_same"), "left").withColumn("cell", F.coalesce("first_cell", "cell"))
    dims_n = len(dims) + 1

    def curve(batches):
        for b in batches:
            cells = np.array(b.column("cell").flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims_n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "size", "text_crc32", "same")), pa.array(hilbert_index(cells), pa.int64())], ["doc_id", "size", "text_crc32", "same", "hilbert"])

    id_type = dict(docs.dtypes)["doc_id"]
    on_curve = placed.select("doc_id", "size", "text_crc32", "same", "cell").mapInArrow(curve, f"doc_id {id_type}, size long, text_crc32 long, same long, hilbert long")
    # The place inside its range partition is stored with each row, so later stages read one fixed order.
    keys = ["hilbert", "same", "doc_id"]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    ranged = on_curve.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = scratch.keep(ranged)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(ranged.groupBy(part.alias("p")).count().collect())  # one row a partition
    total = sum(r["count"] for r in counts)
    before, run = [], 0
    for r in counts:
        before.append((r["p"], run))
        run += r["count"]
    offsets = F.broadcast(spark.createDataFrame(before, "p long, before long"))  # one row a partition
    rank = (F.col("before") + place).alias("rank")
    ranked = ranged.join(offsets, part == F.col("p")).select("doc_id", "size", "text_crc32", "hilbert", rank)
    shard = F.expr(f"(rank * {shards}L) div {max(total, 1)}L").cast("int")
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - start).select("doc_id", "size", "text_crc32", "hilbert", "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as one folder a shard (shard=0, ...), rows in curve order, with the columns of ``docs`` alone, whatever their
    names. Ids must be unique and not null: rows of ``docs`` without a place would not be written, which is an error. An empty table
    writes no folder."""
    id_, shard, slot = (fresh(c, docs.columns) for c in ("id", "shard", "slot"))
    order = placed.select(F.col(id_col).alias(id_), F.col("shard").alias(shard), F.col("slot").alias(slot))
    n = placed.agg(F.count(id_col).alias("ids"), F.count_distinct(id_col).alias("distinct"), F.count("*").alias("rows")).first()
    if not n["ids"] == n["distinct"] == n["rows"] == docs.count():
        raise ValueError("ids must be unique, not null, and all placed")
    (
        docs.join(order, docs[id_col] == F.col(id_))
        .repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(id_, slot)
        .write.partitionBy(shard).parquet(path)
    )


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
