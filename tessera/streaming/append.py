"""Incremental append and event roll-ups with Structured Streaming.

A file source with a checkpoint reads each file once; digests make rows unique over all files, as repeated batch runs would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.rows import with_digest


def new_rows(spark: SparkSession, source: str, schema: StructType, columns: Sequence[str], model: str) -> DataFrame:
    """Rows of Parquet files as they appear, the first of each digest."""
    rows = with_digest(spark.readStream.schema(schema).parquet(source), columns)
    return rows.withColumn("model_name", F.lit(model)).dropDuplicates(["model_name", "row_digest"])


def append_new(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is there and stop; the next call goes on from the checkpoint."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; those later than ``late`` are left out, so state is bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "events", "total")
