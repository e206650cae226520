"""Operators 2, 5 and 9 against the library on whole texts."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.packing import Packer, fill_window, pack_documents
from tessera.llm.token_shards import EliasFano, document_at, read_token_shards, write_token_shards
from tessera.llm.tokens import Encoder, load_tokenizer, tokenizer_path
from tessera.llm.word_bpe import encode_decode

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ALPHABET = ["a", "B", "word", " ", "  ", "\n", "\t", "é", "é", "́", "'s", "'LL", "1", "!", ",", ".", "<|endoftext|>", "<|startoftext|>", "\x1c", "　", "\xa0", "Σ", "İ", "ß", "ŉ", "\r", "中", "​"]
TEXTS = [None, "", " ", "one", "The cat, the Cat. THE CAT", "a  b", "x<|endoftext|>y <|endoftext|> ", "Étre à Ænima İİ Σς", "word " * 5000, "end. " * 3 + "\n\n tail", "same", "same"]
ROWS = [(None if k == 3 else k if k != 11 else 10, t, "en", k) for k, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    # further columns, with names that operators use inside
    return spark.createDataFrame(ROWS, "doc_id long, text string, block string, ids long").repartition(3)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_library(path):
    encoder, whole, rnd = Encoder(path, memo_chunks=50), load_tokenizer(path), random.Random(1)
    for _ in range(300):
        texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(14))) for _ in range(10)]
        for text, ids in zip(texts, encoder.encode_many(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(gaps):
    values = np.cumsum(gaps).astype(np.int64) if gaps else np.zeros(0, np.int64)
    ef = EliasFano.encode(values)
    read = EliasFano(ef.low_bits, ef.low, ef.high, ef.samples, ef.n)
    assert read.select(np.arange(ef.n)).tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert read.select(i).tolist() == [values[i]]
        assert read.bounds(i, i + 1).tolist() == [values[i - 1] if i else 0, values[i]]
    some = np.array([i for i in (5, 300, 301, 650, 2) if i < ef.n], np.int64)
    assert read.select(some).tolist() == values[some].tolist()
    assert len(ef.low) + len(ef.high) <= len(values) * (2 + np.log2(max(2, (values[-1] if len(values) else 0) / max(1, len(values))))) / 8 + len(values) / 4 + 16
    with pytest.raises(IndexError):
        read.select(len(values))


def test_shards_round_trip(spark, docs, tmp_path):
    write_token_shards(docs, str(tmp_path / "s"), BYTE, 2, shard_tokens=2000)
    got = sorted((tuple(r) for r in read_token_shards(spark, str(tmp_path / "s")).collect()), key=lambda r: r[1])
    tok, start, expected = load_tokenizer(BYTE), 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, len(ids), ids))
    assert [(d, n, np.frombuffer(i, "<u4").tolist()) for d, _, n, i in got] == expected
    for d, s, n, _ in got:
        assert s == start
        start += n
    shards = spark.read.parquet(str(tmp_path / "s" / "shards")).orderBy("bucket", "shard").collect()
    assert [document_at(s, k).tolist() for s in shards for k in range(s.n_docs)] == [ids for _, _, ids in expected]


def test_shards_of_an_empty_table(spark, docs, tmp_path):
    write_token_shards(docs.limit(0), str(tmp_path / "s"), BYTE, 2)
    assert read_token_shards(spark, str(tmp_path / "s")).count() == 0


@pytest.mark.parametrize("block_bytes", [100, 8 << 20])
def test_word_bpe_round_trip(docs, block_bytes):
    tok = load_tokenizer(WORD)
    expected = []
    for doc_id, text, *_ in ROWS:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, ids, tok.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in encode_decode(docs, WORD, block_bytes).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert encode_decode(docs.limit(0), WORD).count() == 0
    with pytest.raises(ValueError):
        encode_decode(docs, BYTE)


def test_word_bpe_of_a_hot_row(spark):
    """Rows that are all equal fill several blocks, and no block holds them all."""
    df = spark.createDataFrame([(None, "the same words again " * 20)] * 500 + [(1, "é" * 5000), (2, "x " * 60_000)], "doc_id long, text string").repartition(2)
    tok = load_tokenizer(WORD)
    out = encode_decode(df, WORD, 10_000).collect()
    expected = np.array(tok.encode("the same words again " * 20, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(out) == 502 and all(r.ids == expected for r in out if r.doc_id is None)
    assert {len(r.ids) // 4 for r in out if r.doc_id == 2} == {60_000}
    plan = encode_decode(df, WORD, 10_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=12), st.integers(0, 40))
def test_fill_window_is_the_best_subset(lengths, room):
    counts = {x: lengths.count(x) for x in set(lengths)}
    taken = fill_window(counts, sorted(counts, reverse=True), room)
    assert all(0 < n <= counts[x] for x, n in taken.items())
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    assert sum(x * n for x, n in taken.items()) == max(sums)


def test_packer_uses_every_id_once():
    rnd, packer, seen = random.Random(2), Packer(64), {}
    for k in range(500):
        packer.add(rnd.randint(1, 64), 0, k)
        seen[k] = 0
    total, full = packer.waiting, list(packer.sequences(0))
    rest = list(packer.rest())
    assert total == 500 and all(sum(n for n, _, _ in s) == 64 for s in full)
    assert all((n := sum(p[0] for p in s)) & (n - 1) == 0 for s in rest)
    for n, start, doc in sorted((p for s in full + rest for p in s), key=lambda p: (p[2], p[1])):
        assert start == seen[doc]
        seen[doc] += n


def test_packing(docs):
    tok, rows = load_tokenizer(WORD), pack_documents(docs, WORD, 2).collect()
    by_text = {(r[0], r[1]): [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in ROWS}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 and zlib.crc32(r.ids) >= 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    long = sorted((r for r in rows if r.doc_id == 8), key=lambda r: r.start)
    assert b"".join(r.ids for r in long) == np.array(by_text[8, ROWS[8][1]], "<u4").tobytes() and long[0].doc_tokens == len(by_text[8, ROWS[8][1]])
    assert pack_documents(docs.limit(0), WORD, 2).count() == 0


def test_repeated_ids_stay(docs):
    assert pack_documents(docs, WORD, 2).where(F.col("doc_id") == 10).select("length").collect() == [(2,), (2,)]
