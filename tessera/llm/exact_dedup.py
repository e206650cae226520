"""Operator 10: exact dedup with two Bloom passes.

Pass one sends a 64-bit hash of each text (once or twice per task, however often it occurs) to the
segment of the filter it falls in, and there makes two-bit counters: a position
is kept if at least two rows set it. The kept positions, of which there is a fixed
number, are broadcast. Pass two tests every row: a row with a position that is not
kept is certainly alone and passes straight through; only the others shuffle, as
(hash, id) without their text, to be grouped by SHA-256. Tables of more rows than one filter holds bits for are
divided by hash, and each part has its two passes, so the share of rows that shuffle for nothing doesn't grow.

Defined cases: a null text counts as empty; null ids are smaller than others, and a group of null ids alone
keeps one of them as ``keep_id`` null; rows equal in id and text form one group and of these one is marked kept;
an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import build_filter, may_hold, parts
from .common import Materialized, join_groups, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(column):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(column.cast("string"), F.lit("")), _UPPER, _LOWER)


def _test(kept):
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = may_hold(batch.column("h").to_numpy(zero_copy_only=False), kept.value)
            yield batch.append_column("repeated", pa.array(found))

    return test


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, shuffled.

    ``keep_id`` is the largest id of the equal texts; ``shuffled`` tells which rows left their task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalized(F.col("text")), 256).alias("text_sha256"))
    total = rows.select("doc_id").count()
    n = parts(total)
    h = F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long")
    hashed: Materialized = materialize(rows.withColumn("h", h).withColumn("part", F.pmod(F.shiftright("h", 40), F.lit(n))), "hashes", "part" if n > 1 else None)
    tested: list[Materialized] = []
    for k in range(n):
        own = hashed.df.where(F.col("part") == k).drop("part")
        kept = spark.sparkContext.broadcast(build_filter(own.select("h"), -(-total // n), least=2))
        tested.append(materialize(own.mapInArrow(_test(kept), "doc_id long, text_sha256 string, h long, repeated boolean"), "tested"))
        kept.unpersist()
    hashed.drop()
    every = spark.read.schema(tested[0].df.schema).parquet(*[t.path for t in tested])
    alone = every.where("not repeated").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", F.lit(False).alias("shuffled"))
    maybe = every.where("repeated").drop("h", "repeated")
    groups = materialize(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    joined = join_groups(maybe, groups.df, ["text_sha256"], "group_size", maybe.count()).select(columns)
    # A row equal to the one that stays in id and text is a copy of it: number them, which only touches kept ids.
    stays = joined.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(columns).agg(F.count(F.lit(1)).alias("n"))
    stays = stays.select(*columns, F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: i == 1)).alias("kept"))
    goes = joined.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    rest = stays.unionByName(goes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", F.lit(True).alias("shuffled"))
    return alone.unionByName(rest)
