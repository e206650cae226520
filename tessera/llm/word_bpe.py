"""Operator 5: BPE encoding and decoding through a table of distinct words.

Each task cuts the texts that it reads into blocks of some megabytes, in the order it reads them, and compresses each to one row. A block sends
the distinct words it holds to the buckets of a word table, where each distinct word of the corpus is
encoded once. The answers go back to the blocks that asked, where ids are joined back by the words' positions and pieces are joined to ids through the
vocabulary, the id-to-piece table. So a word crosses the network
once for each block that has it, not for each time it occurs, and no block, bucket or
word holds more than a bounded part of the input, however frequent a word or a row is: blocks are numbered, not dealt by what is in them.

Blocks are shuffled once, compressed: both uses of them are the same exchange. A row for each occurrence of a word, joined by Spark, would shuffle
several times the input, which the README gives figures for. If a block is computed again after an executor is lost and then holds other rows, the answers' checksums
tell, and its words are encoded in place.

Defined cases: a null text counts as empty and gives no id; null and repeated ids stay
as they are; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for
from .tokens import ChunkEncoder, chunks_dropping_space, is_byte_level, load_tokenizer, marked_stem

#: Text in a block, unless one document alone has more, and blocks in a partition on average.
BLOCK_BYTES, BLOCKS_TOGETHER = 8 << 20, 4
#: Of zstd, for words and answers on their way between tasks.
_LEVEL = 6
#: No word holds this: words are cut at line ends.
_SEP = "\n"
_BLOCK = "block long, payload binary"
_ASKED = "bucket long, block long, words binary"
_ANSWERED = "bucket long, block long, crc long, lengths binary, ids binary"


def chunks_and_stems(texts: list[str]) -> tuple[set[str], set[str]]:
    """The distinct chunks of texts, and the words to ask for: chunks without a mark at the end, and the marks."""
    chunks: set[str] = set()
    for text in texts:
        chunks.update(chunks_dropping_space(text))
    marked = {c for c in chunks if marked_stem(c)}
    return marked, (chunks - marked) | {c[:-1] for c in marked} | {c[-1] for c in marked}


def deal(words: set[str], buckets: int) -> dict[int, list[str]]:
    """The words of each bucket of the word table, in an order that asking and reading share."""
    dealt: dict[int, list[str]] = {}
    for word in words:
        dealt.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
    for some in dealt.values():
        some.sort()
    return dealt


def pack_texts(texts: pa.Table) -> bytes:
    """Rows as one compressed value."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, texts.schema) as stream:
        stream.write_table(texts)
    return zstandard.ZstdCompressor(3).compress(out.getvalue())


def unpack_texts(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()


def pieces_of(tok) -> list[str]:
    """The id-to-piece table: as many entries as the vocabulary, whatever the input."""
    return [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]


def encode_decode(docs: DataFrame, tokenizer: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, ids (binary, little-endian u4), decoded (string).

    ``tokenizer`` is a file whose pre-tokenizer drops white space and that has no decoder,
    so that decoded text is the pieces joined by one space.
    """
    tok = load_tokenizer(tokenizer)
    if is_byte_level(tok) or tok.decoder is not None:
        raise ValueError("a tokenizer with separate words and no decoder is needed")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = max(partitions_for(spark), blocks // BLOCKS_TOGETHER)
    buckets = max(partitions_for(spark), blocks // 8)

    packed = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
    asked = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("words", pa.binary())])
    answered = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("crc", pa.int64()), ("lengths", pa.binary()), ("ids", pa.binary())])
    result = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    vocabulary = spark.sparkContext.broadcast(pieces_of(tok))

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block
            row = {"block": block, "payload": pack_texts(pa.Table.from_batches(held))}
            block += 1
            return pa.RecordBatch.from_pylist([row], schema=packed)

        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = lo + int(np.searchsorted(np.cumsum(lengths[lo:]), block_bytes - size, side="right"))
                if hi == lo and held:
                    yield flush()
                    held, size = [], 0
                    continue
                hi = max(hi, lo + 1)
                held.append(batch.slice(lo, hi - lo))
                size += int(lengths[lo:hi].sum())
                lo = hi
        if held:
            yield flush()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(_LEVEL).compress
        for batch in batches:
            for block, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, words = chunks_and_stems(unpack_texts(payload).column("text").to_pylist())
                dealt = deal(words, buckets)
                yield pa.RecordBatch.from_pylist([{"bucket": k, "block": block, "words": pack(_SEP.join(v).encode())} for k, v in dealt.items()], schema=asked)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, now = ChunkEncoder(tokenizer, "<u2"), {}, None
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(_LEVEL).compress
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    now, table = row["bucket"], {}
                raw = unpack(row["words"])
                words = raw.decode().split(_SEP)
                new = [w for w in words if w not in table]
                table.update(zip(new, encoder.encode(new), strict=True))
                ids = [table[w] for w in words]
                lengths = [len(x) // 2 for x in ids]
                yield pa.RecordBatch.from_pylist([{"bucket": now, "block": row["block"], "crc": zlib.crc32(raw), "lengths": pack(np.array(lengths, "u1" if max(lengths) < 256 else "<u4").tobytes()), "ids": pack(b"".join(ids))}], schema=answered)

    def assemble(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        texts = pa.concat_tables([unpack_texts(p) for p in blocks.column("payload").to_pylist()])
        texts_of = texts.column("text").to_pylist()
        marked, words = chunks_and_stems(texts_of)
        dealt = deal(words, buckets)
        pieces = np.array(vocabulary.value, object)
        ids_of: dict[str, bytes] = {}
        decoded_of: dict[str, str] = {}

        def learn(some: list[str], ends: list[int], ids: np.ndarray) -> None:
            raw, found = ids.astype("<u4").tobytes(), pieces[ids].tolist()
            for word, lo, hi in zip(some, [0, *ends], ends, strict=False):
                ids_of[word] = raw[4 * lo : 4 * hi]
                decoded_of[word] = " ".join(found[lo:hi])

        for row in answers.to_pylist():
            some = dealt.get(row["bucket"], [])
            if zlib.crc32(_SEP.join(some).encode()) == row["crc"]:
                lengths = unpack(row["lengths"])
                learn(some, np.cumsum(np.frombuffer(lengths, "u1" if len(lengths) == len(some) else "<u4"), dtype=np.int64).tolist(), np.frombuffer(unpack(row["ids"]), "<u2"))
                del dealt[row["bucket"]]
        if dealt:  # the block isn't what it was when it asked
            rest = [w for some in dealt.values() for w in some]
            found = ChunkEncoder(tokenizer, "<u2").encode(rest)
            learn(rest, np.cumsum([len(x) // 2 for x in found]).tolist(), np.frombuffer(b"".join(found), "<u2"))
        for chunk in marked:
            stem, mark = chunk[:-1], chunk[-1]
            ids_of[chunk] = ids_of[stem] + ids_of[mark]
            decoded_of[chunk] = f"{decoded_of[stem]} {decoded_of[mark]}"
        ids_out, decoded_out = [], []
        for text in texts_of:
            some = chunks_dropping_space(text)
            ids_out.append(b"".join(map(ids_of.__getitem__, some)))
            decoded_out.append(" ".join(filter(None, map(decoded_of.__getitem__, some))))
        return pa.Table.from_arrays([texts.column("doc_id"), pa.array(ids_out, pa.binary()), pa.array(decoded_out, pa.string())], schema=result)

    blocked = rows.mapInArrow(pack_blocks, _BLOCK).repartition(parts, "block")
    answers = blocked.mapInArrow(ask, _ASKED).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, _ANSWERED).repartition(parts, "block")
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, "doc_id long, ids binary, decoded string")
