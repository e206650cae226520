"""Operator 9: packing token sequences by minimum bin slack.

Each task packs what it reads, so nothing shuffles. A document's full windows are sequences of
their own; the rests go to a bounded pool. The longest rest opens a window, a bitset
subset-sum over the pool's lengths finds the multiset that comes closest to filling it,
and counts of each length are backtracked through the stored bitsets. Slack that no
multiset fills is filled by cutting the longest other rest. What is left at the end of a
task is cut into sequences whose lengths are powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; null or repeated ids are
kept as they are; an empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import MEMO_CHUNKS, encoder

#: Rests that wait together for a window, and how many of them wait on for the next pool.
POOL, CARRY = 8192, 1024
ENCODE_ROWS = 256
_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fill_window(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length to take for the sum nearest to ``room``, never over it.

    ``lengths`` are the keys of ``counts`` in descending order. Bit s of a bitset says that
    some multiset sums to s; a length's multiplicity is added by binary splitting.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        most = min(counts[length], room // length) if length <= room else 0
        if not most:
            continue
        steps.append((length, most, reach))
        k = 1
        while most:
            k = min(k, most)
            reach |= (reach << (length * k)) & mask
            most -= k
            k *= 2
        if reach >> room & 1:
            break
    left, taken = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        n = 0
        while not before >> left & 1:
            left -= length
            n += 1
        assert n <= most
        if n:
            taken[length] = n
    return taken


class Packer:
    """Rests of documents to sequences; a rest is (length, start, document)."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.by_length: dict[int, list] = defaultdict(list)
        self.waiting = 0

    def add(self, length: int, start: int, doc) -> None:
        self.by_length[length].append((start, doc))
        self.waiting += 1

    def _take(self, length: int) -> tuple:
        same = self.by_length[length]
        start, doc = same.pop()
        if not same:
            del self.by_length[length]
        self.waiting -= 1
        return length, start, doc

    def sequences(self, carry: int) -> Iterator[list[tuple]]:
        """Full sequences, until about ``carry`` rests wait or no full one can be made."""
        lengths = sorted(self.by_length, reverse=True)
        while self.waiting > carry:
            lengths = [x for x in lengths if x in self.by_length]
            pieces = [self._take(lengths[0])]
            room = self.window - pieces[0][0]
            if room:
                counts = {k: len(v) for k, v in self.by_length.items()}
                for length, n in fill_window(counts, [x for x in lengths if x in counts], room).items():
                    pieces += [self._take(length) for _ in range(n)]
                    room -= n * length
            if room:
                longer = next((x for x in lengths if x in self.by_length and x > room), None)
                if longer is None:  # all that waits is not enough for this window
                    for length, start, doc in pieces:
                        self.add(length, start, doc)
                    return
                length, start, doc = self._take(longer)
                pieces.append((room, start, doc))
                self.add(length - room, start + room, doc)
                lengths = sorted(self.by_length, reverse=True)
            yield pieces

    def rest(self) -> Iterator[list[tuple]]:
        """The last tokens in sequences whose lengths are powers of two."""
        left = [(n, start, doc) for n, items in sorted(self.by_length.items(), reverse=True) for start, doc in items]
        self.by_length.clear()
        self.waiting = 0
        total = sum(n for n, _, _ in left)
        while total:
            size = min(1 << (total.bit_length() - 1), 1 << (self.window.bit_length() - 1))
            total -= size
            pieces = []
            while size:
                n, start, doc = left.pop()
                used = min(n, size)
                pieces.append((used, start, doc))
                if used < n:
                    left.append((n - used, start + used, doc))
                size -= used
            yield pieces


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, pool: int = POOL, remembered: int = MEMO_CHUNKS) -> DataFrame:
    """``docs(doc_id, text)`` to pieces of sequences of at most ``window`` ids.

    ``remembered`` chunks of text keep their ids in a worker's memory. Returns doc_id, start, length, ids (binary, little-endian u4), doc_tokens,
    sequence_id, offset: one row a piece, each id of each document in exactly one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_many, packer = encoder(tokenizer, memo_chunks=remembered).encode_many, Packer(window)
        end, sequence = end_id.to_bytes(4, "little"), TaskContext.get().partitionId() << 40
        out: list[list] = [[] for _ in range(7)]

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for length, start, (doc_id, ids) in pieces:
                for column, value in zip(out, (doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset), strict=True):
                    column.append(value)
                offset += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for lo in range(0, batch.num_rows, ENCODE_ROWS):
                some = batch.slice(lo, ENCODE_ROWS)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode_many(some.column(1).to_pylist()), strict=True):
                    doc = (doc_id, ids + end)
                    n = len(doc[1]) // 4
                    full = n - n % window
                    for start in range(0, full, window):
                        emit([(window, start, doc)])
                    if n > full:
                        packer.add(n - full, full, doc)
                if packer.waiting > pool:
                    for pieces in packer.sequences(CARRY):
                        emit(pieces)
                if len(out[0]) > 1024:
                    yield flush()
        for pieces in packer.sequences(0):
            emit(pieces)
        for pieces in packer.rest():
            emit(pieces)
        if out[0]:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack, _PIECE)
