"""The JSON that describes partitions: manifest, resume states, error reports, configurations, as frames."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collection_of_state_file, int_or_null
from . import files

STATE = "struct<started: string, complete: string, collection_count: string, documents_indexed: string, indexed_at: string, row_index: string>"
ERROR = "struct<timestamp: string, model: string, rows: array<struct<row_index: string>>, resume_state: struct<row_index: string>, exception: struct<type: string, message: string>>"


def load_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    """A manifest, or an empty one where there is no file; its version is 1 or not given."""
    if not files.exists(spark, path):
        return {"version": 1, "partitions": [], "runs": [], "model_schemas": {}, "drops": []}
    found = files.read_json(spark, path)
    if not isinstance(found, dict) or found.get("version", 1) not in (1, None):
        raise ValueError(f"{path} is not a manifest of version 1")
    for key, empty in (("partitions", []), ("runs", []), ("model_schemas", {}), ("drops", [])):
        found.setdefault(key, empty)
    return found


def manifest_models(spark: SparkSession, manifest: Mapping[str, Any]) -> DataFrame:
    """One row a partition and model: place, partition, path, config, created_at, stale, model, rows, schema_version, deleted."""
    rows = [
        (k, p["name"], p.get("path"), p.get("config"), p.get("created_at"), bool(p.get("stale")), bool(p.get("deleted")), model, m.get("path"), m.get("rows"), m.get("schema_version"), bool(m.get("deleted")))
        for k, p in enumerate(manifest["partitions"])
        if isinstance(p, Mapping) and p.get("name")
        for model, m in (p.get("models") or {}).items()
        if isinstance(m, Mapping)
    ]
    schema = "place int, partition string, path string, config string, created_at string, stale boolean, partition_deleted boolean, model string, model_path string, rows long, schema_version int, deleted boolean"
    return spark.createDataFrame(rows, schema)


def live_partitions(manifest: Mapping[str, Any], base: str) -> list[tuple[str, str, str | None]]:
    """(name, directory, config) in the manifest's order; relative paths start at ``base``. Stale and deleted ones are left out."""
    at = lambda p: p if p is None or "://" in p or p.startswith("/") else f"{base}/{p}"
    return [(p["name"], at(p.get("path") or p["name"]), at(p.get("config"))) for p in manifest["partitions"] if p.get("name") and not p.get("stale") and not p.get("deleted")]


def partition_directories(spark: SparkSession, path: str) -> list[str]:
    return files.listing(spark, path, directories=True)


def _json_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Path and content of files that match; none is an empty frame."""
    fs, p = files._fs(spark, pattern)
    found = fs.globStatus(p)
    if not found:
        return spark.createDataFrame([], "path string, value string")
    return spark.read.text([s.getPath().toString() for s in found], wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def state_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """partition, collection, states (a map of JSON by model): one row for each state file that holds an object."""
    rows = _json_files(spark, f"{out_dir}/*/*_resume_state.json")
    parsed = rows.withColumn("states", F.from_json("value", "map<string, string>", {"mode": "PERMISSIVE"}))
    is_object = F.col("value").rlike(r"^\s*\{") & F.expr("try_parse_json(value) IS NOT NULL")
    return parsed.where(is_object).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("partition"), collection_of_state_file(F.col("path")).alias("collection"), "states")


def model_states(states: DataFrame) -> DataFrame:
    """One row a partition, collection and model whose state is an object, with typed fields."""
    rows = states.select("partition", "collection", F.explode("states").alias("model", "json")).where(F.col("json").rlike(r"^\s*\{"))
    s = rows.withColumn("s", F.from_json("json", STATE))
    whole = lambda c: F.when(F.col(c).rlike(r"^-?\d+$"), F.col(c).try_cast("long"))
    return s.select(
        "partition", "collection", "model",
        F.coalesce(F.col("s.started") == "true", F.lit(False)).alias("started"),
        F.coalesce(F.col("s.complete") == "true", F.lit(False)).alias("complete"),
        whole("s.collection_count").alias("collection_count"),
        whole("s.documents_indexed").alias("documents_indexed"),
        F.col("s.indexed_at").alias("indexed_at"),
        int_or_null(F.col("s.row_index")).alias("row_index"),
    )


def error_reports(spark: SparkSession, out_dir: str) -> DataFrame:
    """partition, file, timestamp, model, exception_type, exception_message, max_row: one row an error report."""
    rows = _json_files(spark, f"{out_dir}/*/errors/*.json").withColumn("e", F.from_json("value", ERROR)).where("e IS NOT NULL")
    from_rows = F.array_max(F.transform(F.col("e.rows"), lambda r: int_or_null(r["row_index"])))
    return rows.select(
        F.regexp_extract("path", r"([^/]+)/errors/[^/]+$", 1).alias("partition"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        F.col("e.timestamp").alias("timestamp"),
        F.nullif(F.col("e.model"), F.lit("")).alias("model"),
        F.col("e.exception.type").alias("exception_type"),
        F.substring("e.exception.message", 1, 100).alias("exception_message"),
        F.greatest(from_rows, int_or_null(F.col("e.resume_state.row_index"))).alias("max_row"),
    )
