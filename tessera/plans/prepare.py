"""Preparation: dirty delimited files to partitions and a manifest, and from partitions to the index."""

from __future__ import annotations

import logging
import re
import traceback
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collection_name
from ..functions.truncate import Counter, count_words, token_budget
from ..operators import documents as doc_ops
from ..operators import index as index_ops
from ..operators import rows as row_ops
from ..operators.batches import BATCH_SIZE, TOKEN_LIMIT
from ..sources import files, metadata
from ..sources.delimited import FILE, ROW, read_rows
from ..spec import IndexConfig, SourceConfig, TableSpec, active
from ..tables import materialize
from . import lifecycle

log = logging.getLogger("tessera")

#: Where a run's rows are, below the output root: Parquet by partition and model.
DATA = "data"


def cleaned(spark: SparkSession, config: SourceConfig) -> DataFrame:
    """Rows of a source, projected, without those that lack a value that is needed."""
    rows, _ = read_rows(spark, config)
    projected = row_ops.project(rows, config.columns, keep=[FILE, ROW])
    return row_ops.drop_missing(projected, config.drop_na_columns)


def _data(spark: SparkSession, root: str) -> DataFrame | None:
    path = f"{root}/{DATA}"
    return spark.read.option("mergeSchema", True).parquet(path) if files.exists(spark, path) and files.listing(spark, path, directories=True) else None


def run(spark: SparkSession, configs: Mapping[str, SourceConfig], registry: Mapping[str, TableSpec], root: str, directory_size: int = 0, manifest_path: str | None = None) -> dict[str, Any]:
    """One run: new rows of all sources go to new partitions of ``root``, and the manifest learns of them.

    A row counts as seen if its digest is in a live partition of its model. A model whose fields have changed must have a source: it is
    read anew, the partitions that held it become stale, and rows of other models in them are carried over to new partitions.
    Returns the new manifest.
    """
    manifest_path = manifest_path or f"{root}/manifest.json"
    manifest = metadata.load_manifest(spark, manifest_path)
    schemas, changed = lifecycle.schema_versions(manifest, {m: registry[m] for m in registry if m in configs or m in manifest["model_schemas"]})
    if missing := [m for m in changed if m not in active(configs)]:
        raise ValueError(f"fields have changed, but there is no source for {missing}")
    stale = [p["name"] for p in lifecycle.impacted(manifest, changed)]
    held = _data(spark, root)
    live = [p["name"] for p in manifest["partitions"] if not p.get("stale") and not p.get("deleted") and p["name"] not in stale]
    seen = None if held is None else held.where(F.col("partition_name").isin(live + stale) & ~(F.col("model_name").isin(changed))).select("model_name", "row_digest")
    frames = []
    for order, model in enumerate(active(configs)):
        c = configs[model]
        rows = cleaned(spark, c).withColumn("model_name", F.lit(model)).withColumn("_model", F.lit(order)).withColumn("_replaces", F.lit(None).cast("string"))
        columns = list(c.columns) or [x for x in rows.columns if x not in (FILE, ROW, "model_name", "_model", "_replaces")]
        frames.append(row_ops.dedupe_rows(rows, columns, [FILE, ROW], by=["model_name", "_model"], seen=None if seen is None else seen.where(F.col("model_name") == model).withColumn("_model", F.lit(order))))
    if stale:
        carried = held.drop("_replaces").where(F.col("partition_name").isin(stale) & ~F.col("model_name").isin(changed))
        known = {m: k for k, m in enumerate(active(configs))}
        order = F.coalesce(*[F.when(F.col("model_name") == m, F.lit(k)) for m, k in known.items()], F.lit(len(known)))
        frames.append(carried.withColumn("_model", order).withColumn(FILE, F.lit(-1)).withColumn(ROW, F.xxhash64("row_digest")).withColumnRenamed("partition_name", "_replaces"))
    if not frames:
        return manifest
    first = 1 + max((int(p["name"].rpartition("_")[2]) for p in manifest["partitions"] if p["name"].rpartition("_")[2].isdigit()), default=0)
    rolled = row_ops.roll_over(row_ops.union_all(frames), directory_size, ["_model", FILE, ROW, "row_digest"], first)
    run_id, staging = uuid.uuid4().hex, f"{root}/_staging-{uuid.uuid4().hex}"
    rolled.drop("_model", FILE, ROW).write.partitionBy("partition_name", "model_name").parquet(staging)
    written = spark.read.option("mergeSchema", True).parquet(staging) if files.listing(spark, staging, directories=True) else None
    created = lifecycle.now()
    counts = [] if written is None else written.groupBy("partition_name", "model_name").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set("_replaces")).alias("replaces")).collect()
    entries: dict[str, dict[str, Any]] = {}
    for r in sorted(counts, key=lambda r: (r["partition_name"], r["model_name"])):  # one row a partition and model
        name, model = r["partition_name"], r["model_name"]
        entry = entries.setdefault(name, {"name": name, "path": f"{DATA}/partition_name={name}", "rows": 0, "created_at": created, "run_id": run_id, "models": {}})
        entry["rows"] += r["rows"]
        entry["models"][model] = {"path": f"{entry['path']}/model_name={model}", "rows": r["rows"], "schema_signature": schemas[model]["signature"], "schema_version": schemas[model]["version"]}
        if r["replaces"]:
            entry["replaces"] = sorted({*entry.get("replaces", []), *r["replaces"]})
    if not entries and not changed:
        files.delete(spark, staging)
        return manifest
    for name, entry in entries.items():
        fs, p = files._fs(spark, f"{root}/{DATA}/partition_name={name}")
        fs.mkdirs(p.getParent())
        if not fs.rename(files._fs(spark, f"{staging}/partition_name={name}")[1], p):
            raise OSError(f"could not move {name} into place")
        files.write_json(spark, f"{root}/{name}/index_config.json", {m: {"path": f"{root}/{e['path']}", "columns": {}} for m, e in entry["models"].items()})
    files.delete(spark, staging)
    manifest["partitions"] += entries.values()
    manifest["runs"].append({"id": run_id, "created_at": created, "partitions": list(entries)})
    manifest["model_schemas"] |= schemas
    lifecycle.mark_stale(manifest, stale, {old: [n for n, e in entries.items() if old in e.get("replaces", [])] for old in stale})
    files.write_json(spark, manifest_path, manifest)
    return manifest


def index_partitions(
    spark: SparkSession,
    manifest_path: str,
    root: str,
    registry: Mapping[str, TableSpec],
    index_path: str,
    configs: Mapping[str, IndexConfig] | None = None,
    prefix: str | None = None,
    collection: str | None = None,
    embedding: index_ops.EmbeddingFunction | None = None,
    strict: bool = False,
    strategy: str | None = "auto",
    embedding_tokens: int = 8191,
    count: Counter = count_words,
    batch_size: int = BATCH_SIZE,
    token_limit: int = TOKEN_LIMIT,
    states_dir: str | None = None,
    resume: bool = False,
) -> DataFrame:
    """Index the live partitions of a manifest: one plan a model, appended where ids are new. Returns the counts by collection and model.

    The collection is one for each partition, or ``collection`` for all. Only new documents are embedded, in requests of at most ``batch_size`` documents and
    ``token_limit`` tokens, which are asked again when they are rate-limited. With ``states_dir``, states are written there, and a report for each request that failed; what was embedded
    is kept, and the model's state in these partitions is not complete. ``resume`` passes over partitions whose state is complete and whose files are as they were then.
    Without ``states_dir`` a failed request is an error, raised after what was embedded has been kept.
    """
    manifest = metadata.load_manifest(spark, manifest_path)
    target_of = lambda partition: collection or (f"{prefix}_{partition}" if prefix else partition)
    models: dict[str, list[dict[str, Any]]] = {}
    for p in manifest["partitions"]:
        if not p.get("stale") and not p.get("deleted"):
            for m, e in (p.get("models") or {}).items():
                if e.get("deleted"):
                    continue
                part = {"partition": p["name"], "path": f"{root}/{e['path']}", "schema_version": e.get("schema_version"), "signature": files.signature(spark, f"{root}/{e['path']}")}
                if resume and states_dir and lifecycle.unchanged(read_state(spark, states_dir, p["name"], target_of(p["name"])).get(m), part["signature"]):
                    continue
                models.setdefault(m, []).append(part)
    asked = embedding or index_ops.HashingEmbedding()
    asked = asked if isinstance(asked, index_ops.Retrying) else index_ops.Retrying(asked)
    failed: list[str] = []
    for model, parts in models.items():
        spec, config = registry[model], (configs or {}).get(model) or IndexConfig()
        documents = []
        for version in sorted({p["schema_version"] for p in parts}, key=str):
            paths = [p["path"] for p in parts if p["schema_version"] == version]
            rows = spark.read.option("basePath", f"{root}/{DATA}").parquet(*paths)
            built = doc_ops.build_documents(rows.drop("model_name"), spec, config.columns, {"schema_version": version}, source_path=f"{root}/{DATA}", strict=strict, carry=["partition_name"])
            documents.append(built.withColumn("schema_version", F.lit(str(version))))
        target = F.lit(collection) if collection else collection_name(F.col("partition_name"), prefix)
        fresh = index_ops.new_documents(row_ops.union_all(documents).withColumn("collection", target), index_ops.open_index(spark, index_path))
        built = doc_ops.limit_tokens(doc_ops.compact(fresh), token_budget(embedding_tokens), config.truncation_strategy or strategy, spec.semantic_fields, count)
        done = materialize(index_ops.embed_requests(built, asked, batch_size, token_limit), "embedded")
        index_ops.append(spark, done.df.where("embedding IS NOT NULL").drop("request", "failure"), index_path)
        missing = {r["partition_name"]: r["n"] for r in done.df.where("embedding IS NULL").groupBy("partition_name").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
        if missing and not states_dir:
            first = done.df.where("failure IS NOT NULL").select("failure").first()
            raise RuntimeError(f"{model}: {sum(missing.values())} documents have no embedding: {first['failure']['type']}: {first['failure']['message']}")
        if states_dir:
            _write_reports(spark, states_dir, model, done.df)
            _write_model_state(spark, states_dir, index_path, model, parts, target_of, missing)
        failed += [f"{model} in {p}" for p in missing]
        done.drop()
    if failed:
        log.error("not all documents have an embedding: %s", ", ".join(failed))
    return index_counts(spark, index_path)


def index_counts(spark: SparkSession, index_path: str) -> DataFrame:
    found = index_ops.open_index(spark, index_path)
    return spark.createDataFrame([], "collection string, model_name string, documents long") if found is None else found.groupBy("collection", "model_name").agg(F.count(F.lit(1)).alias("documents"))


def _write_reports(spark: SparkSession, out_dir: str, model: str, embedded: DataFrame) -> None:
    """One report for each request that failed and partition in it; a task has one such request, and documents that no request can hold are reported alone."""
    bad = embedded.where("failure IS NOT NULL").select("partition_name", F.coalesce("request", "doc_id").alias("request"), "doc_id", "document", "metadata", "tokens", "failure")
    reports = bad.groupBy("partition_name", "request").agg(F.first("failure").alias("failure"), F.collect_list(F.struct(F.col("doc_id").alias("id"), "document", "metadata", F.col("tokens").alias("token_count"))).alias("rows"))
    for r in reports.toLocalIterator():
        rows = [{"row_index": k, **x.asDict()} for k, x in enumerate(r["rows"])]
        _write_report(spark, out_dir, r["partition_name"], model, "embedding-request", rows, r["failure"].asDict(), {"row_index": 0}, sum(x["token_count"] or 0 for x in rows))


def _write_model_state(spark: SparkSession, out_dir: str, index_path: str, model: str, parts: Sequence[Mapping[str, Any]], target_of: Callable[[str], str], missing: Mapping[str, int]) -> None:
    """The model's part of the states of the partitions at hand; other models' parts stay."""
    index = index_ops.open_index(spark, index_path)
    counts = {} if index is None else {r["partition_name"]: r["n"] for r in index.where((F.col("model_name") == model) & F.col("partition_name").isin([p["partition"] for p in parts])).groupBy("partition_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    for p in parts:
        name, n = p["partition"], counts.get(p["partition"], 0)
        states = read_state(spark, out_dir, name, target_of(name))
        states[model] = {"started": True, "complete": name not in missing, "collection_count": n, "documents_indexed": n, "indexed_at": lifecycle.now(), "source_signature": p["signature"]}
        write_state(spark, out_dir, name, target_of(name), states)


def read_state(spark: SparkSession, out_dir: str, partition: str, collection: str) -> dict[str, Any]:
    """The states of a collection's models, none where there is no file."""
    path = f"{out_dir}/{partition}/{collection}_resume_state.json"
    found = files.read_json(spark, path) if files.exists(spark, path) else {}
    return dict(found) if isinstance(found, Mapping) else {}


def write_error_report(spark: SparkSession, out_dir: str, partition: str, model: str, reason: str, rows: Sequence[Mapping[str, Any]], exception: Exception, resume_state: Mapping[str, Any] | None = None) -> str:
    """An error report of a failed batch as JSON; its name begins with the time."""
    failure = {"type": type(exception).__name__, "message": str(exception), "traceback": "".join(traceback.format_exception(exception))}
    return _write_report(spark, out_dir, partition, model, reason, rows, failure, resume_state)


def _write_report(spark: SparkSession, out_dir: str, partition: str, model: str, reason: str, rows: Sequence[Mapping[str, Any]], failure: Mapping[str, str], resume_state: Mapping[str, Any] | None, tokens: int | None = None) -> str:
    stamp = lifecycle.now()
    path = f"{out_dir}/{partition}/errors/{stamp.replace(':', '').replace('-', '')}_{re.sub('[^0-9A-Za-z_.-]', '_', model)}_{uuid.uuid4().hex[:6]}.json"
    report = {"timestamp": stamp, "model": model, "partition_name": partition, "reason": reason, "batch": {"size": len(rows), "token_total": tokens}, "resume_state": dict(resume_state or {}), "rows": [dict(r) for r in rows], "exception": dict(failure)}
    files.write_json(spark, path, report)
    return path


def write_state(spark: SparkSession, out_dir: str, partition: str, collection: str, states: Mapping[str, Mapping[str, Any]]) -> str:
    """The state of a collection's models, for status and routing."""
    path = f"{out_dir}/{partition}/{collection}_resume_state.json"
    files.write_json(spark, path, {m: dict(s) for m, s in states.items()})
    return path


def write_states(spark: SparkSession, index_path: str, out_dir: str) -> int:
    """States of all that an index holds, from its counts by partition, collection and model."""
    index = index_ops.open_index(spark, index_path)
    if index is None:
        return 0
    by: dict[tuple[str, str], dict[str, Any]] = {}
    for r in index.groupBy("partition_name", "collection", "model_name").agg(F.count(F.lit(1)).alias("n")).collect():
        by.setdefault((r["partition_name"], r["collection"]), {})[r["model_name"]] = {"started": True, "complete": True, "collection_count": r["n"], "documents_indexed": r["n"], "indexed_at": lifecycle.now()}
    for (partition, collection), states in by.items():
        write_state(spark, out_dir, partition, collection, states)
    return len(by)
