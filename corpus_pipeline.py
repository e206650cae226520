"""Corpus pipeline: toxic documents go, repeated runs of lines go, one of each group of near copies stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, read_table
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.queries import END_ID, WORD_BPE
from tessera.llm.tokens import tokenizer_path
from tessera.llm.toxicity import THRESHOLD, fit_held_in, score_rows


#: Chunks of text whose ids a worker remembers: fewer than by default, as executors have come through three stages.
REMEMBERED = 200_000
#: Documents in an Arrow batch. A stage's result is written by whoever called it, and Spark's 10,000 documents at once would take much of an executor's memory.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """For the whole session, as a stage's frame is computed when it is written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold."""
    _small_batches(spark)
    model = fit_held_in(docs, read_table(spark, sf_dir, "labels"))
    return score_rows(docs, model).where(F.col("score") < THRESHOLD).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; one that loses all its words goes, one that had none stays."""
    _small_batches(spark)
    rows = dedup_lines(docs).where((F.col("n_deleted") == 0) | F.col("row.text").rlike(r"\S")).select("row.*")
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    _small_batches(spark)
    goes = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(goes, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    _small_batches(spark)
    return pack_documents(docs, tokenizer_path(WORD_BPE), END_ID, remembered=REMEMBERED)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Tokenizing, scoring and near-duplicate search can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        written = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
