"""A Bloom filter built by segments and broadcast, of a bounded size.

Each hash sets its bits within one segment, and a segment is built by one task from one row, with a count of two at most, for each hash and
Arrow batch that has it: so building shuffles 24 bytes a row at most, and a hot hash is one row a batch. Two-bit counters tell bits
that one row set from those that several did.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions_for

#: Bits for each row, and the largest size in bits: 32 MB are broadcast at most. Beyond that a filter only
#: gets less selective: more rows pass it, and results stay the same. What needs it sharp at any size takes one filter for each of :func:`parts` parts of the hashes.
BITS_PER_ROW, MOST_BITS = 16, 1 << 28
HASHES = 4


def positions(hashes: np.ndarray, segment_bits: int) -> np.ndarray:
    """Bit positions of each hash within its segment, shape (rows, HASHES)."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    at = (h[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, HASHES + 1, dtype=np.uint64) * step[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    return (at % np.uint64(segment_bits)).astype(np.int64)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % segments


def parts(rows: int) -> int:
    """Parts into which ``rows`` hashes are divided so that each has a filter with all its bits."""
    return max(1, -(-rows * BITS_PER_ROW // MOST_BITS))


def build_filter(hashes: DataFrame, rows: int, least: int) -> np.ndarray:
    """Bits that at least ``least`` (1 or 2) of ``rows`` hashes set, shape (segments, segment_bits / 8); ``hashes`` has one column."""
    bits = min(MOST_BITS, max(1 << 13, BITS_PER_ROW * rows))
    segments = min(bits >> 13, 4 * partitions_for(hashes.sparkSession))
    segment_bits = -(-bits // segments // 8) * 8


    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            segment = segment_of(values, segments)
            yield pa.RecordBatch.from_arrays([pa.array(segment), pa.array(values), pa.array(np.minimum(n, 2))], names=["segment", "h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, h, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = positions(h, segment_bits)
            for s in np.unique(segment):
                own = segment == s
                counter = counters.setdefault(int(s), np.zeros(segment_bits, np.uint8))
                for k in range(HASHES):
                    counter[:] = np.minimum(2, counter + np.minimum(2, np.bincount(at[own, k], weights=n[own], minlength=segment_bits)).astype(np.uint8))
        for s, counter in counters.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(counter >= least, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    thinned = hashes.mapInArrow(thin, "segment long, h long, n long")
    found = thinned.repartition(min(segments, partitions_for(hashes.sparkSession)), "segment").mapInArrow(count, "segment long, bits binary").collect()
    kept = np.zeros((segments, segment_bits // 8), np.uint8)
    for row in found:
        kept[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return kept


def may_hold(hashes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """False only for hashes whose bits the filter lacks."""
    segment = segment_of(hashes, len(kept))
    at = positions(hashes, kept.shape[1] * 8)
    return ((kept[segment[:, None], at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
