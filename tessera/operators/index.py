"""The index: Parquet partitioned by collection and model, so that routing prunes directories before anything is read."""

from __future__ import annotations

import time
import traceback
import uuid
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from ..functions.predicates import metadata_column, where
from ..sources import files
from .batches import BATCH_SIZE, TOKEN_LIMIT, assign

LAYOUT = ("collection", "model_name")
#: Fields that are columns of the index, so that filters on them reach the scan.
PROMOTED = {"collection", "model_name", "doc_id", "partition_name", "schema_version", "has_sem"}


class EmbeddingFunction(Protocol):
    """Texts to vectors, called on executors with a batch."""

    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEmbedding:
    """Signed feature hashing of words to unit vectors: no model, no network, the same everywhere."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dim] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class RateLimited(Exception):
    """Raised by a remote embedding function that must wait."""


class Retrying:
    """A remote embedding function that is asked again when it is rate-limited: doubling waits of at most ``most_seconds``."""

    def __init__(self, function: EmbeddingFunction, retries: int = 5, first_seconds: float = 1.0, most_seconds: float = 30.0) -> None:
        self.function, self.retries, self.first, self.most = function, retries, first_seconds, most_seconds

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        for attempt in range(self.retries + 1):
            try:
                return self.function(texts)
            except RateLimited:
                if attempt == self.retries:
                    raise
                time.sleep(min(self.most, self.first * 2**attempt))
        raise AssertionError


def embed_requests(documents: DataFrame, function: EmbeddingFunction, size: int = BATCH_SIZE, limit: int = TOKEN_LIMIT, text: str = "document", tokens: str = "tokens") -> DataFrame:
    """Add ``embedding``, ``request`` and ``failure``, computed in requests of at most ``size`` documents and ``limit`` tokens, as remote services want them.

    A task whose request fails sends no more: the documents of that request have a ``failure`` (type, message, traceback), those after it neither that nor an
    embedding. So a service that is down costs one request a task, and there is one failed request a task at most. Documents too large for any request fail too.
    """
    schema = StructType([*documents.schema.fields, StructField("embedding", ArrayType(FloatType())), StructField("request", StringType()), StructField("failure", StructType([StructField(n, StringType()) for n in ("type", "message", "traceback")]))])
    arrow = to_arrow_schema(schema)

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, stopped = TaskContext.get().partitionId(), 0, False
        for batch in batches:
            texts, counts = batch.column(text).to_pylist(), batch.column(tokens).to_pylist()
            vectors: list = [None] * len(texts)
            names: list = [None] * len(texts)
            failures: list = [None] * len(texts)
            assigned = assign([c or 0 for c in counts], size, limit)
            groups: dict[int, list[int]] = {}
            for k, a in enumerate(assigned):
                if a is None:
                    failures[k] = {"type": "ValueError", "message": f"{counts[k]} tokens are too many for a request", "traceback": ""}
                else:
                    groups.setdefault(a, []).append(k)
            for own in groups.values():
                if stopped:
                    break
                name = f"{task}-{n}"
                n += 1
                try:
                    found = function([texts[k] or "" for k in own])
                    if len(found) != len(own):
                        raise ValueError(f"{len(found)} vectors for {len(own)} texts")
                    for k, v in zip(own, found, strict=True):
                        vectors[k] = [float(x) for x in v]
                        names[k] = name
                except Exception as e:  # whatever a remote service does, its documents go into a report
                    stopped = True
                    failure = {"type": type(e).__name__, "message": str(e), "traceback": "".join(traceback.format_exception(e))}
                    for k in own:
                        names[k], failures[k] = name, failure
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, arrow.field(c).type) for x, c in ((vectors, "embedding"), (names, "request"), (failures, "failure")))], schema=arrow)

    return documents.mapInArrow(requests, schema)


def embed(documents: DataFrame, function: EmbeddingFunction, text: str = "document") -> DataFrame:
    """Add ``embedding``, computed in Arrow batches."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(function(batch.fillna("").tolist()))) if len(batch) else pd.Series([], dtype=object)

    return documents.withColumn("embedding", vectors(F.col(text)))


def open_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The documents of an index, None if it has none yet."""
    if not files.exists(spark, path):
        return None
    held = (d for d in files.listing(spark, path, directories=True) if d.startswith("collection="))
    return spark.read.parquet(path) if any(files.listing(spark, f"{path}/{d}", directories=True) for d in held) else None


def recover(spark: SparkSession, path: str) -> None:
    """Finish what a deletion left that was cut off: a directory that was moved aside comes back if nothing has taken its place. For writers only."""
    if not files.exists(spark, path):
        return
    for name in files.listing(spark, path, directories=True):
        if name.startswith("_old-"):
            for collection in files.listing(spark, f"{path}/{name}", directories=True):
                for model in files.listing(spark, f"{path}/{name}/{collection}", directories=True):
                    if not files.exists(spark, f"{path}/{collection}/{model}"):
                        _move(spark, f"{path}/{name}/{collection}/{model}", f"{path}/{collection}/{model}")
        if name.startswith(("_old-", "_rewrite-")):
            files.delete(spark, f"{path}/{name}")


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = files._fs(spark, target)
    fs.mkdirs(p.getParent())
    if not fs.rename(files._fs(spark, source)[1], p):
        raise OSError(f"could not move {source} to {target}")


def _directory(spark: SparkSession, row: Mapping[str, Any]) -> str:
    """collection=.../model_name=..., as Spark writes the names of directories."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join(escape(c, row[c]) for c in LAYOUT)


def new_documents(documents: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Documents whose (collection, doc_id) the index lacks: the first write of an id wins. Only the ids of collections at hand are read."""
    once = documents.dropDuplicates(["collection", "doc_id"])
    if existing is None:
        return once
    return once.join(existing.select("collection", "doc_id"), ["collection", "doc_id"], "left_anti")


def append(spark: SparkSession, documents: DataFrame, path: str) -> None:
    """Insert documents that are not there yet. Running it again after a failure adds what is missing and nothing twice."""
    recover(spark, path)
    fresh = new_documents(documents, open_index(spark, path))
    fresh.repartition(*LAYOUT, F.pmod(F.xxhash64("doc_id"), F.lit(32))).write.mode("append").partitionBy(*LAYOUT).parquet(path)


def matching(index: DataFrame, filters: Mapping[str, Any]) -> Column:
    promoted = PROMOTED & set(index.columns)
    return where(filters, metadata_column(promoted))


def delete(spark: SparkSession, path: str, filters: Mapping[str, Any], apply: bool = True) -> int:
    """Delete the documents that pass ``filters``; returns how many do. Only directories that hold such documents are written anew.

    What stays is written to a directory with a name of its own, the old one is moved aside, the new one takes its place, and only then
    the old one goes; what is cut off in between, the next writer finishes. One writer at a time.
    """
    if apply:
        recover(spark, path)
    index = open_index(spark, path)
    if index is None:
        return 0
    hit = F.coalesce(matching(index, filters), F.lit(False))
    touched = index.where(hit).groupBy(*LAYOUT).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a directory
    if apply and touched:
        run = uuid.uuid4().hex
        named = F.broadcast(index.where(hit).select(*LAYOUT).distinct())  # one row a directory
        index.join(named, list(LAYOUT), "left_semi").where(~hit).repartition(*LAYOUT, F.pmod(F.xxhash64("doc_id"), F.lit(32))).write.partitionBy(*LAYOUT).parquet(f"{path}/_rewrite-{run}")
        for row in touched:
            directory = _directory(spark, row)
            _move(spark, f"{path}/{directory}", f"{path}/_old-{run}/{directory}")
            if files.exists(spark, f"{path}/_rewrite-{run}/{directory}"):
                _move(spark, f"{path}/_rewrite-{run}/{directory}", f"{path}/{directory}")
            elif not files.listing(spark, f"{path}/{directory}".rpartition("/")[0], directories=True):
                files.delete(spark, f"{path}/{directory}".rpartition("/")[0])
        files.delete(spark, f"{path}/_rewrite-{run}")
        files.delete(spark, f"{path}/_old-{run}")
    return sum(r["n"] for r in touched)


def drop_filter(model: str, partitions: Sequence[str], versions: Sequence[int] = ()) -> dict[str, Any]:
    """The filter of a drop: model and partitions, and schema versions if any are named."""
    parts: list[dict[str, Any]] = [{"model_name": model}, {"partition_name": {"$in": list(partitions)}}]
    if versions:
        parts.append({"schema_version": {"$in": [str(v) for v in versions]}})
    return {"$and": parts}
