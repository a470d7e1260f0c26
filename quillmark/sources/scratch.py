"""Folders for files in passing, on storage that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: list = []


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, system = file_system(spark, path)
    system.delete(where, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written by the driver to whatever storage the path names; an old one is replaced."""
    where, system = file_system(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the interpreter ends. Where the setting is absent, a temporary one if
    all runs on this machine; on a cluster an error, as executors could not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/quillmark-files-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a folder of its own and read again: it is computed once however many read it, its plan ends here, and a lost
    executor costs nothing of it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _folders:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already; nothing else can be done at exit
            return


atexit.register(_sweep)
