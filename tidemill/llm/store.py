"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: In place of a missing id: such rows come after all others.
LAST = 2**63 - 1
#: Spark's switch for deleting an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[Scratch] = []


class Scratch:
    """A folder of intermediate tables below the shared one.

    A lazy result may read it, so it stays until ``release`` or the end of the driver's Python process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if not _made:
            atexit.register(_release_all)
        _made.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it read back: short lineage, survives lost executors; the write's shuffle files go when it ends."""
        path = f"{self.root}/{name}"
        schema = df.schema
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def mark() -> int:
    """A place in the sequence of scratch folders, for ``release``."""
    return len(_made)


def release(since: int = 0) -> None:
    """Delete the scratch folders made since a ``mark``: for when every result that reads them has been written."""
    while len(_made) > since:
        scratch = _made.pop()
        delete(scratch.spark, scratch.root)


def _release_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended first
        release()


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns that rows have in common if their id and their text are equal: ``rid`` and ``mark``, never null."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return [F.coalesce(doc, F.lit(LAST)).alias("rid"), F.xxhash64(text, text.isNull(), doc.isNull()).alias("mark")]


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``, through the driver's JVM."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)
