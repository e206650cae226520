"""Operator 2: token-id shards with Elias-Fano document boundaries.

A shard concatenates the ids of consecutive documents; where each one ends is kept as an
Elias-Fano sequence with sampled select, about 2 + log2(tokens / documents) bits a document.

Defined cases: a null text is an empty one (its shard entry is the end id alone); a null
``doc_id`` sorts first; rows with equal ids are ordered by the hash of their text, and equal rows
all stay; an empty table writes no shard; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import small_batches
from .common import partitions_for
from .tokens import encoder, load_tokenizer

#: Ids in a shard, unless one document alone has more.
SHARD_TOKENS = 1 << 20
#: Documents encoded together.
ENCODE_ROWS = 256
#: Chunks of text that a worker remembers the ids of.
REMEMBERED = 800_000
#: Set bits between two select samples.
SELECT_EVERY = 256

_SHARD = "bucket int, shard int, start_in_bucket long, n_docs int, n_tokens long, id_bytes int, doc_ids array<long>, ids binary, low_bits int, low binary, high binary, samples binary"


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space with select."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, samples: bytes, n: int) -> None:
        self.low_bits, self.n = low_bits, n
        self.low, self.high, self.samples = low, high, samples
        self._low = np.unpackbits(np.frombuffer(low, np.uint8), bitorder="little")
        self._high = np.unpackbits(np.frombuffer(high, np.uint8), bitorder="little")
        self._samples = np.frombuffer(samples, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(low_bits, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SELECT_EVERY].astype("<u4").tobytes(), n)

    def select(self, i: int | np.ndarray) -> np.ndarray:
        """The values at the given positions: from a position's sample, only the bits up to the next sample are looked at."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(i)
        at = np.empty(len(i), np.int64)
        sample = i // SELECT_EVERY
        for k in np.unique(sample):
            low = int(self._samples[k])
            high = int(self._samples[k + 1]) if k + 1 < len(self._samples) else len(self._high)
            own = sample == k
            at[own] = low + np.flatnonzero(self._high[low:high])[i[own] - k * SELECT_EVERY]
        bits = self._low[i[:, None] * self.low_bits + np.arange(self.low_bits)].astype(np.int64)
        return ((at - i) << self.low_bits) | (bits << np.arange(self.low_bits)).sum(axis=1)

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where documents ``first`` to ``last - 1`` begin, and where the last of them ends."""
        before = self.select(first - 1) if first else np.zeros(1, np.int64)
        return np.concatenate([before, self.select(np.arange(first, last))])


def _shard_row(bucket: int, shard: int, start: int, doc_ids: list, parts: list[bytes], id_bytes: int) -> dict:
    ends = np.cumsum([len(p) // id_bytes for p in parts])
    ef = EliasFano.encode(ends)
    return {
        "bucket": bucket, "shard": shard, "start_in_bucket": start, "n_docs": len(parts), "n_tokens": int(ends[-1]), "id_bytes": id_bytes,
        "doc_ids": doc_ids, "ids": b"".join(parts), "low_bits": ef.low_bits, "low": ef.low, "high": ef.high, "samples": ef.samples,
    }


def _to_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_ARROW = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("start_in_bucket", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs(doc_id, text)`` in ascending ``doc_id`` order and write shards to ``path``.

    The only shuffle deals texts out by ranges of (doc_id, text hash), so a repeated id
    can be split. ``path/shards`` holds the shards, ``path/manifest`` the first id's
    global position for each range: one row a partition, so its size is bounded.
    """
    spark = docs.sparkSession
    id_bytes = 2 if max(load_tokenizer(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_many, bucket = encoder(tokenizer, f"<u{id_bytes}", REMEMBERED).encode_many, TaskContext.get().partitionId()
        end = end_id.to_bytes(id_bytes, "little")
        shard = start = size = 0
        ids: list = []
        parts: list[bytes] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, ENCODE_ROWS):
                some = batch.slice(lo, ENCODE_ROWS)
                for doc_id, part in zip(some.column(0).to_pylist(), encode_many(some.column(1).to_pylist()), strict=True):
                    n = len(part) // id_bytes + 1
                    if parts and size + n > shard_tokens:
                        yield _to_batch([_shard_row(bucket, shard, start, ids, parts, id_bytes)], _ARROW)
                        shard, start, size, ids, parts = shard + 1, start + size, 0, [], []
                    ids.append(doc_id)
                    parts.append(part + end)
                    size += n
        if parts:
            yield _to_batch([_shard_row(bucket, shard, start, ids, parts, id_bytes)], _ARROW)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(2 * partitions_for(spark), *order).sortWithinPartitions(*order)
    with small_batches(spark):
        rows.mapInArrow(shards, _SHARD).write.option("compression", "zstd").parquet(f"{path}/shards")
    sizes = spark.read.schema(_SHARD).parquet(f"{path}/shards").groupBy("bucket").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("bucket", before.alias("bucket_start"), "n_tokens").write.parquet(f"{path}/manifest")


def document_at(shard: Row | dict, k: int) -> np.ndarray:
    """The ids of the document at position ``k`` of a shard: two selects, and no other document is looked at."""
    begin, end = EliasFano(shard["low_bits"], shard["low"], shard["high"], shard["samples"], shard["n_docs"]).bounds(k, k + 1).tolist()
    return np.frombuffer(shard["ids"], f"<u{shard['id_bytes']}", end - begin, begin * shard["id_bytes"])


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """The documents of shards at ``path``: doc_id, start, n_tokens, ids (binary, little-endian u4)."""

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ef = EliasFano(row["low_bits"], row["low"], row["high"], row["samples"], row["n_docs"])
                offsets = ef.bounds(0, row["n_docs"])
                starts, ends = offsets[:-1], offsets[1:]
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4")
                bounds = pa.py_buffer((4 * offsets).astype("<i8"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["start_in_bucket"] + row["bucket_start"], pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.Array.from_buffers(pa.large_binary(), len(ends), [None, bounds, pa.py_buffer(ids)]).cast(pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    shards = spark.read.schema(_SHARD).parquet(f"{path}/shards")
    manifest = spark.read.schema("bucket int, bucket_start long, n_tokens long").parquet(f"{path}/manifest")
    joined = shards.join(F.broadcast(manifest.select("bucket", "bucket_start")), "bucket")
    return joined.mapInArrow(docs, "doc_id long, start long, n_tokens long, ids binary")
