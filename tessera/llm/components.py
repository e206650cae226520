"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` of longs to (node, component): the smallest node that can be reached.

    Each round writes its edges to the shared folder, so lineage stays short. A round
    replaces edges by edges to smaller nodes and never adds more than there are; the number of rounds
    grows with the logarithm of the longest path. Nodes without an edge to another node don't appear.
    """
    distinct = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = materialize(distinct, name)
    while not _are_stars(now.df):
        total = now.df.count()
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), name)
        larger = join_groups(both.where("v > u"), least.df, ["u"], "n", 2 * total)
        large = materialize(larger.select(F.col("v").alias("u"), F.col("m").alias("v")), name)
        least.drop()
        now.drop()
        least = materialize(large.df.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), name)
        joined = join_groups(large.df, least.df, ["u"], "n", 2 * total)
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.unionByName(least.df.select("u", F.col("m").alias("v"))).distinct(), name)
        least.drop()
        large.drop()
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour or is only a smaller neighbour of others: then components are done."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()
