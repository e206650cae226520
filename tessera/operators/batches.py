"""Batches of documents for services with limits on a request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Documents and tokens in a request, by default and at most.
BATCH_SIZE, MOST_BATCH_SIZE = 128, 2048
TOKEN_LIMIT, MOST_TOKENS = 250_000, 300_000


def assign(tokens: list[int], size: int = BATCH_SIZE, limit: int = TOKEN_LIMIT, most: int = MOST_TOKENS) -> list[int | None]:
    """The batch of each document in order, None for one that is too large for any. One over the limit is a batch alone."""
    size = min(size, MOST_BATCH_SIZE)
    out: list[int | None] = []
    batch = docs = total = 0

    def flush() -> None:
        nonlocal batch, docs, total
        if docs:
            batch, docs, total = batch + 1, 0, 0

    for n in tokens:
        if n > most:
            out.append(None)
            continue
        if n > limit or docs >= size or total + n > limit:
            flush()
        out.append(batch)
        docs, total = docs + 1, total + n
        if docs >= size or total >= limit:
            flush()
    return out


def pack_batches(df: DataFrame, order: str, tokens: str = "tokens", by: str = "model_name", lanes: int = 1, **limits) -> DataFrame:
    """Add lane and batch_id to documents; batches are greedy in ``order`` within a model, and in each of its ``lanes`` by hash.

    Packing is sequential, so a model is one stream; lanes split a model that is too large for that. Rows stream through sorted
    partitions, so no task holds a model.
    """
    lane = F.pmod(F.xxhash64(order), F.lit(lanes)).cast("int")
    rows = df.withColumn("lane", lane).repartition(by, "lane").sortWithinPartitions(by, "lane", order)
    names = df.columns

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, list[int]] = {}
        size, limit, most = min(limits.get("size", BATCH_SIZE), MOST_BATCH_SIZE), limits.get("limit", TOKEN_LIMIT), limits.get("most", MOST_TOKENS)
        for frame in frames:
            out = []
            for key, n in zip(zip(frame[by], frame["lane"], strict=True), frame[tokens], strict=True):
                if n > most:
                    out.append(None)
                    continue
                if key not in state:
                    state.clear()  # sorted: the key before is over
                    state[key] = [0, 0, 0]
                now = state[key]
                if now[1] and (n > limit or now[1] >= size or now[2] + n > limit):
                    now[:] = [now[0] + 1, 0, 0]
                out.append(now[0])
                now[1], now[2] = now[1] + 1, now[2] + n
                if now[1] >= size or now[2] >= limit:
                    now[:] = [now[0] + 1, 0, 0]
            frame["batch_id"] = pd.array(out, "Int64")
            yield frame[[*names, "lane", "batch_id"]]

    schema = StructType([*rows.schema.fields, StructField("batch_id", LongType())])
    return rows.mapInPandas(pack, schema)


def batch_totals(packed: DataFrame, tokens: str = "tokens", by: str = "model_name") -> DataFrame:
    return packed.where("batch_id IS NOT NULL").groupBy(by, "lane", "batch_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(tokens).alias("tokens"))
