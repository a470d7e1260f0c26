"""Shared plumbing of the training-data operators: tables, scratch storage, text bytes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One class of separators for all "words": space and U+0009 to U+000D. bytes.split() without arguments uses the same six.
WORD_SEPARATORS = r"[\x20\x09-\x0D]"

_scratch: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken) -> str:
    """``name``, with underscores before it until it is none of ``taken``, whatever the case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary folder if all runs on this machine; on a
    cluster an error, as executors could not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already; nothing else can be done at exit
            return


atexit.register(_sweep)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of what no table refers to any more: the shuffle files of finished steps, which otherwise stay until the driver
    happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables written to the shared folder. They cut lineage: a lost executor costs at most the running stage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark)}/quillmark-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        _scratch.append((self.spark, path))
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        _delete(self.spark, path)
        _scratch[:] = [x for x in _scratch if x[1] != path]

    def close(self) -> None:
        """Delete every table of this scratch; what reads them must be done."""
        for _, path in [x for x in _scratch if x[1].startswith(self.root + "/")]:
            self.drop(path)


class Release:
    """A context that deletes, at its end, the scratch tables written inside it but those named with ``spare``: for steps whose
    result has been written elsewhere."""

    def __init__(self):
        self.spared: set[str] = set()

    def spare(self, path: str) -> None:
        self.spared.add(path)

    def __enter__(self) -> Release:
        self.before = {path for _, path in _scratch}
        return self

    def __exit__(self, *_) -> None:
        for spark, path in [x for x in _scratch if x[1] not in self.before and x[1] not in self.spared]:
            _delete(spark, path)
            _scratch[:] = [x for x in _scratch if x[1] != path]


def id_kind(df: DataFrame, name: str) -> tuple[str, pa.DataType]:
    """Type of an id column in results: text stays text, all else is a long."""
    return ("string", pa.string()) if dict(df.dtypes)[name] == "string" else ("long", pa.int64())


def hand_back() -> None:
    """Give freed memory back to the system. Arrow's pool and the allocator keep it otherwise, hundreds of MB in each Python worker,
    which Spark keeps for the next stage's tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone
    if trim:
        trim(0)


def slices(batches, rows: int = 512):
    """Record batches in smaller pieces, so that few texts are Python objects at a time; what a batch took is handed back."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        hand_back()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def id_crc(column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
