"""Samples of a fixed size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stable_sample(df: DataFrame, k: int, by: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """``k`` rows of each group with the smallest MD5 of "seed:key": uniform, and the same whenever and wherever it runs.

    Spark cuts each task's rows to ``k`` a group before the shuffle, so a large group is no load on one task.
    """
    if k < 1:
        raise ValueError("k is 1 or more")
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
