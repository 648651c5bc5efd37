"""Shared storage for intermediate results.

Intermediate tables are written as Parquet under ``spark.checkpoint.dir``, the
folder that driver and executors share, so that they outlive lost executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A session on one machine (``local[...]``) that names none gets a folder under its
    warehouse. On a cluster that would be one machine's disk, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one operator run. ``keep`` writes and rereads one, ``free`` removes those named."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, new_path(spark, label), 0

    def keep(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        """The table as written, compressed with ``codec``; ``rows_of`` and ``mark_of`` know its rows without another job."""
        path = f"{self.root}/t{self.count}"
        self.count += 1
        seen = Observation()
        mark = F.bit_xor(F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")))).alias("mark")
        df.observe(seen, F.count(F.lit(1)).alias("rows"), mark).write.parquet(path, compression=codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._rowloom_path, out._rowloom_seen = path, seen.get
        return out

    def free(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._rowloom_path)

    def close(self) -> None:
        """Removes all tables of the run; only for runs whose result doesn't read them any more."""
        remove(self.spark, self.root)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Here each write removes its shuffle files when it has ended; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def remove(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(table: DataFrame) -> int:
    """Rows of a kept table; a repeated task may count twice, so only 0 and the order of magnitude are exact."""
    return table._rowloom_seen["rows"]


def mark_of(table: DataFrame) -> tuple:
    """Tells changed tables apart; rows in another order have the same mark."""
    return table._rowloom_seen["rows"], table._rowloom_seen["mark"]


#: Rows that Spark hands to a Python worker at once, so that a batch of long texts stays in memory.
ROWS_AT_ONCE = 512


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch length to ``ROWS_AT_ONCE`` if it is longer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_ONCE:
        spark.conf.set(key, str(ROWS_AT_ONCE))
