"""Shared helpers: tables, the shared folder, durable intermediate tables, byte files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and runs on this machine alone (as in tests), a temporary folder is
    set and goes with the process; a cluster must name one. Tables that operators write to a named folder stay there, as results are read from them lazily.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="lumendex-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str, scratch: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts the lineage with a table that outlives any executor, unlike a
    cache or a local checkpoint. scratch: gets the path, for ``remove`` when nothing reads the table any more.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths of the shared folder through Hadoop's file system API, and empty the list."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    paths.clear()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def write_bytes(df: DataFrame, column: str | Column, path: str, last: str) -> None:
    """Write one binary value per row, back to back, as files below ``path``.

    Spark's text writer puts out a string's bytes unchanged and then its line
    separator. Every value must end in the character ``last``; that byte is cut off
    and comes back as the separator, so a file is exactly the concatenation of
    its rows. Files appear by Spark's commit protocol: a lost task leaves nothing.
    """
    value = F.col(column) if isinstance(column, str) else column
    body = F.substring(value, F.lit(1), F.length(value) - 1).cast("string")
    df.select(body.alias("value")).write.option("lineSep", last).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``content`` of each file below ``path`` that write_bytes left."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
