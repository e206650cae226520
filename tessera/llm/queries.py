"""Queries over whole tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import read_table, shared_dir
from .embedding_dedup import near_embeddings
from .exact_dedup import exact_duplicates
from .html_text import extract_pages
from .line_dedup import ORACLE_SQL as _OP4
from .line_dedup import dedup_lines
from .near_dedup import ORACLE_SQL as _OP1
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quotations import ORACLE_SQL as _OP8
from .quotations import chat_conversations
from .token_shards import read_token_shards, write_token_shards
from .tokens import tokenizer_path
from .toxicity import score_toxicity
from .word_bpe import encode_decode

BYTE_BPE, WORD_BPE, END_ID = "byte_bpe_50k.json", "word_bpe_49k.json", 2


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tessera-shards-{uuid.uuid4().hex}"
    write_token_shards(read_table(spark, sf_dir, "documents"), path, tokenizer_path(BYTE_BPE), END_ID)
    common.keep(spark, path)
    read = read_token_shards(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(read_table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "n_deleted", F.col("row.text").alias("text"))


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_conversations(read_table(spark, sf_dir, "conversations"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END_ID)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents")).drop("shuffled")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_token_shards, op3_embedding_dedup, op4_line_dedup, op5_word_bpe, op6_html_text, op7_toxicity, op8_chat_quotations, op9_packing, op10_exact_dedup)}


_OP10 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""


_OP3 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), fit AS MATERIALIZED (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.98
), reach AS (
  SELECT DISTINCT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), counts AS (SELECT r, count(*) AS n FROM pairs GROUP BY r), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id IS NOT DISTINCT FROM c AS kept
FROM v LEFT JOIN counts USING (r) LEFT JOIN least ON vec_id = a
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": _OP1, "op3_embedding_dedup": _OP3, "op4_line_dedup": _OP4, "op8_chat_quotations": _OP8, "op10_exact_dedup": _OP10}
