"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Materialized, keep, materialize, shared_dir

__all__ = ["Materialized", "join_groups", "keep", "materialize", "partitions_for", "read_table", "shared_dir"]


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A group with more than this share of all rows is hot; so there are at most as many hot groups as its inverse.
HOT_SHARE, HOT_LEAST = 1e-4, 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows to one row a group, however large single groups are.

    ``size`` is the column of ``groups`` with the group's number of rows and ``total`` the number of all rows. Hot groups
    number 1 / HOT_SHARE at most whatever the input, so they are broadcast and their rows stay where
    they are. Only rows of other groups shuffle. Reads both sides more than once: pass written tables.
    """
    least = max(HOT_LEAST, int(total * HOT_SHARE))
    hot = F.broadcast(groups.where(F.col(size) > least))
    cold = groups.where(F.col(size) <= least)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys))
