"""Queries over whole tables, through the library's operators, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text as tf
from ..functions import truncate as tr
from ..functions.predicates import where, where_document
from ..operators import batches, documents, index, rows, sampling, search
from ..operators.index import new_documents
from ..sources import files, metadata
from ..sources.delimited import read_clean, read_rows
from ..spec import SourceConfig, TableSpec
from ..tables import keep, shared_dir
from . import lifecycle, prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PART = TableSpec(
    "Part",
    StructType(
        [StructField("p_partkey", LongType(), False), StructField("p_name", StringType()), StructField("p_brand", StringType()), StructField("p_type", StringType()), StructField("p_size", IntegerType()), StructField("p_retailprice", DoubleType())]
    ),
    ("p_name", "p_type"),
    ("p_partkey", "p_brand"),
)

# Nearest neighbours. The queries are every 50th vector, so their number grows with the table.


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_idx"), F.col("embedding").alias("query"))


def _knn(vectors: DataFrame, asked: DataFrame, n: int, metric: str) -> DataFrame:
    found = search.nearest(vectors.select("vec_id", "embedding"), asked, n, metric, id="vec_id")
    return found.select("query_idx", "rank", "vec_id", F.round("distance", 6).alias("distance"))


_L2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
_COS = "1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


def _knn_sql(distance: str, n: int, condition: str = "true") -> str:
    return f"""
SELECT query_idx, rank, vec_id, round(distance, 6) AS distance FROM (
  SELECT query_idx, vec_id, distance, row_number() OVER (PARTITION BY query_idx ORDER BY distance, vec_id)::INT AS rank
  FROM (SELECT q.vec_id AS query_idx, e.vec_id, {distance} AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND {condition})
) WHERE rank <= {n}"""


@_query(_knn_sql(_L2, 10))
def knn_topk_l2(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "embeddings")
    return _knn(v, _queries(v), 10, "l2")


@_query(_knn_sql(_L2, 10, "e.label IN (1, 2, 3)"))
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "embeddings")
    return _knn(v.where(where({"label": {"$in": [1, 2, 3]}})), _queries(v), 10, "l2")


@_query(_knn_sql(_COS, 10))
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "embeddings")
    return _knn(v, _queries(v), 10, "cosine")


@_query(_knn_sql(_L2, 100))
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "embeddings")
    return _knn(v, _queries(v), 100, "l2")


_MERGE = """
SELECT query_idx, rank, collection, doc_id, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY distance, collection, doc_id)::INT AS rank
  FROM (SELECT q.vec_id AS query_idx, 'partition_' || lpad((e.vec_id % 4)::VARCHAR, 5, '0') AS collection, e.vec_id::VARCHAR AS doc_id, {} AS distance
        FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id % 4 IN (0, 2, 3))
) WHERE rank <= 10""".format(_L2)


def _merged(v: DataFrame, asked: DataFrame) -> DataFrame:
    held = v.select(tf.partition_name((F.col("vec_id") % 4).cast("int")).alias("collection"), F.col("vec_id").cast("string").alias("doc_id"), "embedding")
    routing = search.Routing({"Table": {"collections": ["partition_00000", "partition_00002"]}, "Field": {"collections": ["partition_00002", "partition_00003"]}, "Domain": {"collections": ["partition_00001"]}}, {f"partition_0000{k}": [] for k in range(4)})
    found = search.query(held, asked, 10, ["Table", "Field"], routing, include=["distance"])
    return found.withColumn("distance", F.round("distance", 6))


@_query(_MERGE)
def knn_multi_collection_merge(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "embeddings")
    return _merged(v, _queries(v))


# Row hygiene


@_query("SELECT c_custkey, sha1(concat_ws('␟', coalesce(c_name, ''), coalesce(c_mktsegment, ''), coalesce(c_nationkey::VARCHAR, ''))) AS row_digest FROM customer")
def row_digest(spark: SparkSession, sf: str) -> DataFrame:
    return rows.with_digest(_t(spark, sf, "customer"), ["c_name", "c_mktsegment", "c_nationkey"]).select("c_custkey", "row_digest")


@_query("SELECT doc_id, row_digest FROM (SELECT doc_id, sha1(coalesce(text, '')) AS row_digest, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def digest_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return rows.dedupe_rows(_t(spark, sf, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id", "row_digest")


@_query(
    """
WITH d AS (SELECT doc_id, sha1(coalesce(text, '')) AS row_digest, doc_id % 3 = 0 AS old FROM documents)
SELECT min(doc_id) AS doc_id, row_digest FROM d WHERE NOT old AND row_digest NOT IN (SELECT row_digest FROM d WHERE old) GROUP BY row_digest"""
)
def incremental_append(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", "text")
    seen = rows.with_digest(d.where(F.col("doc_id") % 3 == 0), ["text"]).select("row_digest")
    return rows.dedupe_rows(d.where(F.col("doc_id") % 3 != 0), ["text"], ["doc_id"], seen=seen).select("doc_id", "row_digest")


@_query("SELECT collection, min(doc_id) AS n_first, count(*) AS documents FROM (SELECT 'c' || (doc_id % 5) AS collection, doc_id FROM documents WHERE doc_id % 2 = 1) GROUP BY collection")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select(F.concat(F.lit("c"), (F.col("doc_id") % 5).cast("string")).alias("collection"), "doc_id")
    fresh = new_documents(d, d.where(F.col("doc_id") % 2 == 0))
    return fresh.groupBy("collection").agg(F.min("doc_id").alias("n_first"), F.count(F.lit(1)).alias("documents"))


@_query("SELECT doc_id AS id, lang AS language, NULL::VARCHAR AS missing FROM documents WHERE trim(coalesce(lang, '')) NOT IN ('', 'NA', 'N/A') AND trim(coalesce(source, '')) NOT IN ('', 'NA', 'N/A')")
def dropna_project(spark: SparkSession, sf: str) -> DataFrame:
    d = rows.project(_t(spark, sf, "documents"), {"id": "doc_id", "language": "lang", "origin": "source", "missing": "no_such_column"})
    return rows.drop_missing(d, ["language", "origin"]).drop("origin")


@_query("SELECT doc_id, nullif(trim(lang), '') AS lang, source, source AS origin FROM documents")
def remap_blank_null(spark: SparkSession, sf: str) -> DataFrame:
    d = rows.remap(_t(spark, sf, "documents").select("doc_id", "lang", "source"), {"origin": "source"})
    return rows.blanks_to_null(d)


@_query("SELECT r_regionkey AS id, r_name AS name, 'region' AS kind, NULL::INT AS parent FROM region UNION ALL SELECT n_nationkey, n_name, 'nation', n_regionkey FROM nation")
def multi_source_union(spark: SparkSession, sf: str) -> DataFrame:
    region = rows.project(_t(spark, sf, "region"), {"id": "r_regionkey", "name": "r_name"}).withColumn("kind", F.lit("region"))
    nation = rows.project(_t(spark, sf, "nation"), {"id": "n_nationkey", "name": "n_name", "parent": "n_regionkey"}).withColumn("kind", F.lit("nation"))
    return rows.union_all([region, nation])


@_query("SELECT 'partition_' || lpad((floor(n / 500) + 1)::INT::VARCHAR, 5, '0') AS partition_name, count(*) AS rows, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY 1")
def partition_rollover(spark: SparkSession, sf: str) -> DataFrame:
    rolled = rows.roll_over(_t(spark, sf, "orders").select("o_orderkey"), 500, ["o_orderkey"])
    return rolled.groupBy("partition_name").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("first_key"))


# Documents and text


@_query("SELECT p_partkey, concat_ws(chr(10), nullif(p_name, ''), nullif(p_type, '')) AS document, true AS has_sem, p_brand AS brand FROM part")
def semantic_text(spark: SparkSession, sf: str) -> DataFrame:
    built = documents.build_documents(_t(spark, sf, "part"), PART, carry=["p_partkey"])
    return built.select("p_partkey", "document", "has_sem", F.col("metadata")["p_brand"].alias("brand"))


@_query("SELECT count(*) AS documents, count(DISTINCT (p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)) AS ids FROM part")
def document_ids(spark: SparkSession, sf: str) -> DataFrame:
    built = documents.build_documents(_t(spark, sf, "part"), PART)
    return built.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("doc_id").alias("ids"))


@_query("SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents WHERE octet_length(encode(text)) > 16384")
def doc_bytes_over_limit(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", tf.byte_length(F.col("text")).cast("long").alias("bytes"))
    return d.where(F.col("bytes") > documents.MOST_BYTES)


@_query("SELECT source, sum(n)::BIGINT AS tokens, count(*) AS documents, max(n)::BIGINT AS most FROM (SELECT source, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) GROUP BY source")
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("source", tf.token_count(F.col("text")).cast("long").alias("n"))
    return d.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("n").alias("most"))


@_query("SELECT doc_id, CASE WHEN source = 'src1' OR contains(substr(lower(text), 1, 200), 'table') THEN 'end' ELSE 'sentences' END AS strategy FROM documents")
def truncation_strategy(spark: SparkSession, sf: str) -> DataFrame:
    model = F.when(F.col("source") == "src1", "Table").otherwise("Other")
    return _t(spark, sf, "documents").select("doc_id", tf.suggest_strategy(F.col("text"), model, ["description"]).alias("strategy"))


@_query("SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13)) <> '')) AS sentences FROM documents")
def sentence_count(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.size(tf.sentences(F.col("text"))).cast("long").alias("sentences"))


@_query(
    "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\\S+')) > 50 THEN regexp_extract(text, '^(?:\\s*\\S+){47}\\s*') || chr(10) || chr(10) || '[... truncated ...]' ELSE text END AS text FROM documents"
)
def truncate_end_words(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", tr.truncate_end_words(F.col("text"), 50).alias("text"))


@_query(
    "SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::INT AS original_tokens, CASE WHEN len(regexp_extract_all(text, '\\S+')) > 50 THEN '[... truncated ...]' || chr(10) || chr(10) || regexp_extract(text, '\\s*(?:\\S+\\s*){47}$') ELSE text END AS text FROM documents"
)
def truncate_start_words(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("document"), F.col("source").alias("model_name"))
    return documents.limit_tokens(d, 50, "start").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("original_tokens").cast("int").alias("original_tokens"), F.col("document").alias("text"))


@_query()
def truncate_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("document"), F.col("source").alias("model_name"))
    return documents.limit_tokens(d, 200, "auto", ["description"])


@_query(
    """
SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 1000 THEN text ELSE regexp_replace(
  left(text, list_max(list_filter(range(0, 1001), lambda k: octet_length(encode(left(text, k))) <= 1000))::INT), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '') END AS text FROM documents"""
)
def byte_trim(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", tf.byte_trim(F.col("text"), 1000).alias("text"))


@_query(
    """
WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS bytes, regexp_replace(regexp_replace(text, 'RESET\\s*N\\d+|NEW-PAGE(?:\\s+\\w+)?|\\*{5,}', '', 'g'), '\\s{2,}', ' ', 'g') AS short FROM documents),
c AS (
  SELECT doc_id, bytes, bytes > 16384 AS over, text, CASE WHEN octet_length(encode(short)) <= 16384 THEN short ELSE regexp_replace(
    left(short, list_max(list_filter(range(4096, 16385), lambda k: octet_length(encode(left(short, k))) <= 16384))::INT), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '') END AS cut,
    octet_length(encode(short)) > 16384 AS long FROM d
)
SELECT doc_id, CASE WHEN over THEN cut ELSE text END AS document, CASE WHEN over THEN bytes END::INT AS original_bytes, coalesce(over AND long, false) AS compaction_fallback,
       coalesce(over, false) AS compacted, CASE WHEN over THEN octet_length(encode(cut)) END::INT AS compacted_bytes FROM c"""
)
def compact_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents.compact(_t(spark, sf, "documents").select("doc_id", F.col("text").alias("document")))


@_query("SELECT DISTINCT source, regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') AS slug, regexp_replace(source || '/x y', '[^0-9A-Za-z_.-]', '_', 'g') AS file FROM documents")
def names(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("source", tf.slug(F.col("source")).alias("slug"), tf.safe_filename(F.concat("source", F.lit("/x y"))).alias("file")).distinct()


# Filters, lookups, counts


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")


_LABELLED = "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE "


@_query(_LABELLED + "(lang = 'en' AND quality = 1) OR (lang = 'de' AND toxic = 0)")
def where_and_or(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).where(where({"$or": [{"$and": [{"lang": "en"}, {"quality": 1}]}, {"lang": "de", "toxic": {"$eq": 0}}]})).select("doc_id")


@_query(_LABELLED + "lang IN ('en', 'fr') AND (source IS NULL OR source NOT IN ('src1', 'src2'))")
def where_in_nin(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).where(where({"lang": {"$in": ["en", "fr"]}, "source": {"$nin": ["src1", "src2"]}})).select("doc_id")


@_query(_LABELLED + "n_chars >= 500 AND n_chars < 20000 AND n_chars > 600 AND n_chars <= 2000")
def where_range(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).where(where({"$and": [{"n_chars": {"$gte": 500, "$lt": 20000}}, {"n_chars": {"$gt": 600, "$lte": 2000}}]})).select("doc_id")


@_query(_LABELLED + "quality IS DISTINCT FROM 1")
def where_ne_null(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).where(where({"quality": {"$ne": 1}})).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE contains(text, 'the') AND NOT contains(text, 'der')")
def where_document_contains(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").where(where_document({"$and": [{"$contains": "the"}, {"$not_contains": "der"}]}, F.col("text"))).select("doc_id")


@_query("SELECT item_id, text FROM benchmark WHERE item_id IN (1, 3, 5, 7)")
def get_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    return search.get(_t(spark, sf, "benchmark"), [1, 3, 5, 7], include=["text"], id="item_id")


@_query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20 OFFSET 10")
def get_page(spark: SparkSession, sf: str) -> DataFrame:
    return search.get(_t(spark, sf, "documents"), limit=20, offset=10, include=["lang"])


@_query("SELECT collection, doc_id FROM (SELECT source AS collection, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n > 2 AND n <= 5")
def get_page_per_collection(spark: SparkSession, sf: str) -> DataFrame:
    return search.get(_t(spark, sf, "documents").withColumnRenamed("source", "collection"), limit=3, offset=2, include=[], per_collection=True)


@_query("SELECT nullif(source, '') AS model_name, count(*) AS documents FROM documents GROUP BY 1")
def count_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return search.model_stats(_t(spark, sf, "documents").withColumnRenamed("source", "model_name"))


@_query("SELECT count(*) AS documents FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def count_routed(spark: SparkSession, sf: str) -> DataFrame:
    routing = search.Routing({"Table": {"collections": ["src1", "src2"]}}, {"src1": [], "src2": [], "src3": []})
    return search.count(_t(spark, sf, "documents").withColumnRenamed("source", "collection"), ["Table"], routing, {"lang": "en"})


@_query(
    """
WITH c AS (SELECT source, count(*) AS documents FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY documents DESC, source) AS n FROM c)
SELECT source, documents FROM r WHERE n <= 5 UNION ALL SELECT NULL, sum(documents)::BIGINT FROM r WHERE n > 5 HAVING count(*) > 0"""
)
def top_models_with_rest(spark: SparkSession, sf: str) -> DataFrame:
    counts = _t(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return rows.top_with_rest(counts, "source", "documents", 5)


# Routing, lifecycle: states and manifests derived from the tables


def _states(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    collection = F.concat(F.lit("collection_"), (F.col("doc_id") % 5).cast("string"))
    return d.groupBy(collection.alias("collection"), F.col("source").alias("model")).agg(F.count(F.lit(1)).alias("collection_count")).select("collection", F.col("collection").alias("partition"), "model", F.lit(True).alias("started"), "collection_count")


@_query("SELECT source AS model, list_sort(list(DISTINCT 'collection_' || (doc_id % 5))) AS collections, count(*) AS total_documents FROM documents GROUP BY source")
def routing_model_to_collections(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.model_routing(_states(spark, sf)).select("model", "collections", "total_documents")


@_query("SELECT 'collection_' || (doc_id % 5) AS collection, list_sort(list(DISTINCT source)) AS models FROM documents GROUP BY 1")
def routing_collection_to_models(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.collection_routing(_states(spark, sf))


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("model")).agg(F.count(F.lit(1)).alias("rows")).select(
        F.concat(F.lit("partition_"), F.col("month")).alias("partition"), F.concat("month", F.lit("-01T00:00:00")).alias("created_at"), "model", "rows", F.lit(1).alias("schema_version"), F.lit(False).alias("deleted")
    )


@_query(
    """
SELECT o_orderpriority AS model, list_sort(list(DISTINCT 'partition_' || strftime(o_orderdate, '%Y-%m'))) AS partitions, [1] AS schema_versions, count(*) AS rows
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND strftime(o_orderdate, '%Y-%m') < '1996-01' AND strftime(o_orderdate, '%Y-%m') >= '1994-06' GROUP BY 1"""
)
def plan_drop(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.planned(lifecycle.droppable(_manifest(spark, sf), ["1-URGENT", "2-HIGH"], "1996-01-01", "1994-06-01"))


@_query("SELECT o_orderpriority AS model, count(*) AS rows, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS partitions FROM orders GROUP BY 1")
def drop_impact(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.drop_impact(_manifest(spark, sf))


@_query("SELECT lang, count(*) AS documents FROM documents WHERE NOT (lang = 'en' AND source IN ('src1', 'src2', 'src3')) GROUP BY lang")
def apply_drop_delete(spark: SparkSession, sf: str) -> DataFrame:
    hit = where({"$and": [{"lang": "en"}, {"source": {"$in": ["src1", "src2", "src3"]}}]})
    return _t(spark, sf, "documents").where(~hit).groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))


_STATUS = """
WITH s AS (SELECT 'p' || (doc_id % 40) AS partition, source AS model, bool_and(n_chars < 9000) AS complete, true AS started, max(doc_id) AS row_idx FROM documents GROUP BY 1, 2),
e AS (SELECT 'p' || (doc_id % 40) AS partition, source AS model, max(doc_id) AS worst FROM documents WHERE n_chars > 12000 GROUP BY 1, 2),
p AS (SELECT DISTINCT 'p' || (doc_id % 40) AS partition FROM documents UNION SELECT 'p_none'),
done AS (SELECT partition, bool_and(complete) AS done FROM s GROUP BY 1),
past AS (SELECT e.partition, bool_and(coalesce(s.row_idx > e.worst, false)) AS past FROM e LEFT JOIN s USING (partition, model) GROUP BY 1)
SELECT partition, CASE WHEN done THEN 'finished' WHEN past IS NOT NULL THEN CASE WHEN past THEN 'started' ELSE 'errored' END WHEN done IS NOT NULL THEN 'started' ELSE 'not_started' END AS status
FROM p LEFT JOIN done USING (partition) LEFT JOIN past USING (partition)"""


@_query(_STATUS)
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select(F.concat(F.lit("p"), (F.col("doc_id") % 40).cast("string")).alias("partition"), F.col("source").alias("model"), "doc_id", "n_chars")
    states = d.groupBy("partition", "model").agg(F.bool_and(F.col("n_chars") < 9000).alias("complete"), F.lit(True).alias("started"), F.max("doc_id").alias("row_index"))
    errors = d.where("n_chars > 12000").select("partition", "model", F.col("doc_id").alias("max_row"))
    partitions = d.select("partition").distinct().unionByName(spark.createDataFrame([("p_none",)], "partition string"))
    return lifecycle.status(states, errors, d.select("partition", "model").distinct(), partitions)


@_query("SELECT event_type AS partition, user_id::VARCHAR AS model, max(event_id) AS max_row FROM events GROUP BY ALL")
def error_max_row(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select(F.col("event_type").alias("partition"), F.col("user_id").cast("string").alias("model"), F.col("event_id").alias("max_row"))
    return lifecycle.max_failing_row(e)


@_query("SELECT 'partition_new' AS partition_name, source AS model_name, count(*) AS rows FROM documents WHERE source <> 'src1' AND doc_id % 4 = 0 GROUP BY ALL UNION ALL SELECT 'partition_' || (doc_id % 4), source, count(*) FROM documents WHERE doc_id % 4 <> 0 GROUP BY ALL")
def stale_carryover(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select(F.concat(F.lit("partition_"), (F.col("doc_id") % 4).cast("string")).alias("partition_name"), F.col("source").alias("model_name"))
    stale = F.col("partition_name") == "partition_0"
    carried = d.where(stale & (F.col("model_name") != "src1")).withColumn("partition_name", F.lit("partition_new"))
    return rows.count_by(rows.union_all([carried, d.where(~stale)]), "partition_name", "model_name")


@_query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 5")
def stable_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stable_sample(_t(spark, sf, "documents").select("source", "doc_id"), 5, ["source"], "doc_id", 42)


@_query(
    """
WITH RECURSIVE d AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS x FROM documents
), s(lang, n, x, row_batch, b, docs, total) AS (
  SELECT DISTINCT lang, 0::BIGINT, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM d
  UNION ALL
  SELECT lang, n, x, b2, CASE WHEN full2 THEN b2 + 1 ELSE b2 END, CASE WHEN full2 THEN 0 ELSE docs2 END, CASE WHEN full2 THEN 0 ELSE total2 END FROM (
    SELECT *, docs2 >= 128 OR total2 >= 20000 AS full2 FROM (
      SELECT lang, n, x, CASE WHEN flush THEN b + 1 ELSE b END AS b2, CASE WHEN flush THEN 1 ELSE docs + 1 END AS docs2, CASE WHEN flush THEN x ELSE total + x END AS total2 FROM (
        SELECT s.lang, d.n, d.x, s.b, s.docs, s.total, s.docs > 0 AND (d.x > 20000 OR s.docs >= 128 OR s.total + d.x > 20000) AS flush FROM s JOIN d ON d.lang = s.lang AND d.n = s.n + 1)))
)
SELECT lang AS model_name, 0 AS lane, row_batch AS batch_id, count(*) AS documents, sum(x)::BIGINT AS tokens FROM s WHERE n > 0 GROUP BY lang, row_batch"""
)
def batch_packing(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", F.col("lang").alias("model_name"), tf.token_count(F.col("text")).alias("tokens"))
    return batches.batch_totals(batches.pack_batches(d, "doc_id", limit=20_000))


# Files: what is read was written from the tables, into the shared folder.


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    keep(spark, path)
    return path


def _lines(spark: SparkSession, lines: DataFrame, header: str, name: str) -> str:
    """Lines (n, value) as files with one header before all, and the template of their names."""
    path = _folder(spark, name)
    first = spark.createDataFrame([(-1, header)], "n long, value string")
    first.unionByName(lines.select("n", "value")).repartitionByRange(8, "n").sortWithinPartitions("n").select("value").write.text(path)
    parts = [f for f in files.listing(spark, path) if f.startswith("part-")]
    return f"{path}/part-<int>{re.sub('^part-[0-9]+', '', parts[0])}"


@_query("SELECT c_custkey::VARCHAR AS id, c_name || ',' || c_name AS name, c_mktsegment AS segment FROM customer")
def rows_with_surplus_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("n"), F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_name", "c_mktsegment").alias("value"))
    return read_rows(spark, SourceConfig(_lines(spark, c, "id,name,segment", "surplus"), malformed_column=2, header_row="first-only"))[0].select("id", "name", "segment")


@_query("SELECT s_suppkey::VARCHAR AS id, s_name || chr(10) || 'goes on' AS name, s_nationkey::VARCHAR AS nation FROM supplier")
def rows_over_two_lines(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("n"), F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name").alias("a"), F.concat(F.lit("goes on,"), F.col("s_nationkey").cast("string")).alias("b"))
    lines = s.select("n", F.concat("a", F.lit("\n"), "b").alias("value"))
    # One file a supplier range: a row and what goes on are in one file.
    return read_rows(spark, SourceConfig(_lines(spark, lines, "id,name,nation", "stitched"), malformed_column=2, header_row="first-only"))[0].select("id", "name", "nation")


@_query("SELECT p_size % 7 = 0 AS rejected, count(*) AS rows, sum(p_partkey)::BIGINT AS keys FROM part GROUP BY 1")
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), "p_name", F.lit(', ""x"""'))
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.when(F.col("p_size") % 7 == 0, F.concat_ws(",", F.col("p_partkey").cast("string"), quoted, "p_brand", F.lit("more"))).otherwise(F.concat_ws(",", F.col("p_partkey").cast("string"), quoted, "p_brand")).alias("value"))
    good, bad = read_rows(spark, SourceConfig(_lines(spark, p, "id,name,brand", "rejects"), header_row="first-only"))
    kept = good.where(F.col("name").endswith(', "x"')).select(F.lit(False).alias("rejected"), F.col("id").cast("long").alias("k"))
    both = kept.unionByName(bad.select(F.lit(True).alias("rejected"), F.col("_cells")[0].cast("long").alias("k")))
    return both.groupBy("rejected").agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("keys"))


@_query("SELECT s_suppkey::VARCHAR AS id, s_name AS name FROM supplier")
def clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "clean")
    _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("name")).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_clean(spark, path)


@_query("SELECT o_orderpriority AS model, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS partitions, count(*) AS rows FROM orders GROUP BY 1")
def manifest_models(spark: SparkSession, sf: str) -> DataFrame:
    path, entries = f"{_folder(spark, 'manifest')}/manifest.json", {}
    for r in _manifest(spark, sf).collect():  # one row a month and priority
        entries.setdefault(r["partition"], {"name": r["partition"], "created_at": r["created_at"], "models": {}})["models"][r["model"]] = {"rows": r["rows"], "schema_version": 1}
    files.write_json(spark, path, {"version": 1, "partitions": list(entries.values())})
    return lifecycle.drop_impact(metadata.manifest_models(spark, metadata.load_manifest(spark, path)))


def _written_states(spark: SparkSession, sf: str) -> str:
    path, by = _folder(spark, "states"), {}
    for r in _states(spark, sf).collect():  # one row a collection and source
        by.setdefault(r["collection"], {})[r["model"]] = {"started": True, "complete": True, "collection_count": r["collection_count"], "documents_indexed": r["collection_count"], "row_index": r["collection_count"]}
    for collection, states in by.items():
        prepare.write_state(spark, path, collection, collection, states)
    return path


@_query("SELECT 'collection_' || (doc_id % 5) AS collection, source AS model, count(*) AS documents FROM documents GROUP BY ALL")
def state_files(spark: SparkSession, sf: str) -> DataFrame:
    states = metadata.model_states(metadata.state_files(spark, _written_states(spark, sf)))
    return states.where("complete AND started").select("collection", "model", F.col("collection_count").alias("documents"))


@_query("SELECT 5 AS total_collections, count(DISTINCT source) AS total_models, count(*) AS documents FROM documents")
def routing_totals(spark: SparkSession, sf: str) -> DataFrame:
    out = lifecycle.routing(spark, _written_states(spark, sf))
    rows = [(out["metadata"]["total_collections"], out["metadata"]["total_models"], sum(m["total_documents"] for m in out["model_to_collections"].values()))]
    return spark.createDataFrame(rows, "total_collections int, total_models long, documents long")


@_query("SELECT lang AS partition, 'M' AS model, 'ValueError' AS exception_type, max(doc_id) AS max_row FROM documents WHERE n_chars > 5000 GROUP BY lang")
def error_reports(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "errors")
    worst = _t(spark, sf, "documents").where("n_chars > 5000").groupBy("lang").agg(F.max("doc_id").alias("row"))
    for r in worst.collect():  # one row a language
        prepare.write_error_report(spark, path, r["lang"], "M", "too long", [{"row_index": r["row"]}], ValueError("too long"))
    return metadata.error_reports(spark, path).select("partition", "model", "exception_type", "max_row")


CUSTOMER = TableSpec.of_strings("Customer", ["id", "name"], ["segment"], semantic_fields=("name", "segment"), keyword_fields=("segment",))


def _prepared(spark: SparkSession, sf: str, name: str) -> str:
    """Customers as delimited files, some of them twice, prepared into partitions of 400 rows."""
    root = _folder(spark, name)
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("n"), F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_custkey") % 10 == 0, "NA").otherwise(F.col("c_mktsegment"))).alias("value"))
    lines = c.unionByName(c.where("n % 3 = 0").withColumn("n", F.col("n") + (1 << 40)))
    config = SourceConfig(_lines(spark, lines, "key,name,segment", f"{name}-lines"), {"id": "key", "name": "name", "segment": "segment"}, header_row="first-only", drop_na_columns=("segment",))
    prepare.run(spark, {"Customer": config}, {"Customer": CUSTOMER}, root, 400)
    return root


@_query("SELECT 'partition_' || lpad((floor(n / 400) + 1)::INT::VARCHAR, 5, '0') AS partition_name, count(*) AS rows, min(k)::VARCHAR AS first FROM (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer WHERE c_custkey % 10 <> 0) GROUP BY 1")
def prepared_partitions(spark: SparkSession, sf: str) -> DataFrame:
    held = spark.read.parquet(f"{_prepared(spark, sf, 'prepared')}/{prepare.DATA}")
    return held.groupBy("partition_name").agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("id").cast("long")).cast("string").alias("first"))


@_query("SELECT 'pre_partition_' || lpad((floor(n / 400) + 1)::INT::VARCHAR, 5, '0') AS collection, 'Customer' AS model_name, count(*) AS documents FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS n, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0) WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def indexed_and_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared, indexed, and without the documents of one segment, which were deleted."""
    root, at = _prepared(spark, sf, "to-index"), _folder(spark, "index")
    prepare.index_partitions(spark, f"{root}/manifest.json", root, {"Customer": CUSTOMER}, at, prefix="pre")
    index.delete(spark, at, {"segment": "BUILDING"})
    return prepare.index_counts(spark, at)


@_query("SELECT doc_id, format('{:,}', n_chars) AS chars, left(text, 200) AS preview FROM documents")
def formats(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", tf.thousands(F.col("n_chars")).alias("chars"), tf.preview(F.col("text")).alias("preview"))


@_query("SELECT item_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)")
def get_by_listed_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = _t(spark, sf, "documents").select(F.col("doc_id").alias("i"))
    return search.get(_t(spark, sf, "benchmark"), ids, include=[], id="item_id")


@_query("SELECT o_orderkey, try_cast(o_orderpriority[1] AS BIGINT) AS level FROM orders")
def whole_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").select("o_orderkey", tf.int_or_null(F.substring("o_orderpriority", 1, 1)).alias("level"))
