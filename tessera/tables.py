"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables that live until the session ends, as returned frames read them lazily.
_KEPT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all tasks run on this machine, as
    in tests, a temporary folder is made and set as checkpoint folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            found = jvm_dir.get()
        elif not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            found = tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`materialize`."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@atexit.register
def _remove_kept() -> None:
    for spark, path in _KEPT:
        try:
            remove(spark, path)
        except Exception:  # the session is gone: whoever owns the shared folder clears it
            return


def keep(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the session ends."""
    _KEPT.append((spark, path))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of few rows while something is written: texts of thousands of documents at once would double an executor's memory.

    It is a setting of the session. Other queries that run meanwhile get smaller batches too, which changes no result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Materialized:
    """A frame written to the shared folder: ``df`` reads it, ``drop`` deletes it."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.path)
        _KEPT[:] = [x for x in _KEPT if x[1] != self.path]


def materialize(df: DataFrame, name: str, part: str | None = None) -> Materialized:
    """Write a frame once as Parquet in the shared folder, in a directory for each value of ``part`` if that is given, and read it back.

    This cuts lineage as checkpoint() does, without computing the frame twice,
    and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(part) if part else writer).parquet(path)
    keep(spark, path)
    return Materialized(spark, path, df.schema)
