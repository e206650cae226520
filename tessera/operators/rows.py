"""Row hygiene: projection, filters, digests, first occurrences, roll-over into partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank_to_null, partition_name, row_digest, strip
from ..tables import materialize

# Cells that count as missing, as they are written.
MISSING = ("", "NA", "N/A")


def _column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def project(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Target columns from source columns; a missing source gives nulls, no mapping keeps all columns. ``keep`` are carried along."""
    if not mapping:
        return df
    return df.select(*[_column(df, source).alias(target) for target, source in mapping.items()], *[F.col(c) for c in keep])


def remap(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Add or overwrite target columns and keep the others; a later entry sees what an earlier one made."""
    for target, source in mapping.items():
        df = df.withColumn(target, _column(df, source))
    return df


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows for which none of the columns is missing; a column that isn't there is missing in every row."""
    for name in columns:
        df = df.where(~F.coalesce(strip(_column(df, name).cast("string")), F.lit("")).isin(*MISSING))
    return df


def blanks_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = df.columns if columns is None else columns
    strings = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    return df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) if c in names and c in strings else F.col(f"`{c}`") for c in df.columns])


def with_digest(df: DataFrame, columns: Sequence[str], name: str = "row_digest") -> DataFrame:
    return df.withColumn(name, row_digest(*[F.col(f"`{c}`") for c in columns]))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``. Grouped with partial aggregation, so a key with many rows is no load on one task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def unseen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in ``seen``."""
    return df.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def dedupe_rows(df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = (), seen: DataFrame | None = None) -> DataFrame:
    """The first row of each digest (per ``by``) that no earlier run has seen. Only digests and order keys are compared."""
    digested = with_digest(df, columns)
    if seen is not None:
        digested = unseen(digested, seen, [*by, "row_digest"])
    return first_of(digested, [*by, "row_digest"], order)


def number_rows(df: DataFrame, order: Sequence[str], name: str = "_n") -> DataFrame:
    """Rows numbered from 0 by a total order, without bringing them into one task.

    Rows are sorted by ranges and written once with their place in their range; the ranges' sizes, one row a partition, give each its start.
    """
    place = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", place), "numbered").df
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_p", F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    joined = ranged.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return joined.withColumn(name, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_start", "_m")


def roll_over(df: DataFrame, size: int, order: Sequence[str], first: int = 1) -> DataFrame:
    """Add ``partition_name``: every ``size`` rows of all models together begin a new one; 0 is no limit."""
    if size <= 0:
        return df.withColumn("partition_name", partition_name(F.lit(first)))
    return number_rows(df, order).withColumn("partition_name", partition_name((F.floor(F.col("_n") / size) + first).cast("int"))).drop("_n")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of several sources by column name; a column that a source lacks is null there."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def top_with_rest(counts: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The ``n`` largest entries (0: all), ties by key, with the others as one row named null if there are any."""
    if n <= 0:
        return counts.select(key, value).orderBy(F.desc(value), key)
    top = counts.select(key, value).orderBy(F.desc(value), key).limit(n)
    rest = counts.join(top, key, "left_anti").agg(F.sum(value).alias(value)).where(F.col(value).isNotNull())
    return top.unionByName(rest.select(F.lit(None).cast(counts.schema[key].dataType).alias(key), value))
