"""Manifest and state: schema changes, drops, progress, routing. Small documents, queried as frames or on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import date_or_null
from ..operators import index as index_ops
from ..sources import files, metadata
from ..spec import TableSpec, parse_drop_config


def now() -> str:
    """UTC without a zone, to the second."""
    return datetime.now(UTC).replace(tzinfo=None).isoformat(timespec="seconds")


# Schemas


def schema_versions(manifest: Mapping[str, Any], registry: Mapping[str, TableSpec]) -> tuple[dict[str, dict[str, Any]], list[str]]:
    """({model: signature and version}, models whose fields have changed): a changed signature is the next version, an unseen model version 1."""
    known, out, changed = manifest.get("model_schemas") or {}, {}, []
    for name, spec in registry.items():
        before, signature = known.get(name), spec.signature()
        if not before:
            out[name] = {"signature": signature, "version": 1}
        elif before.get("signature") == signature:
            out[name] = dict(before)
        else:
            out[name] = {"signature": signature, "version": int(before.get("version", 1)) + 1}
            changed.append(name)
    return out, changed


def impacted(manifest: Mapping[str, Any], changed: Sequence[str]) -> list[dict[str, Any]]:
    """Live partitions that hold rows of a changed model."""
    return [p for p in manifest["partitions"] if not p.get("stale") and not p.get("deleted") and any(m in changed and not e.get("deleted") for m, e in (p.get("models") or {}).items())]


def mark_stale(manifest: dict[str, Any], names: Sequence[str], replaced_by: Mapping[str, Sequence[str]], reason: str = "schema-change") -> None:
    for p in manifest["partitions"]:
        if p["name"] in names:
            p.update(stale=True, stale_reason=reason, stale_at=now(), replaced_by=list(replaced_by.get(p["name"], ())))


# Drops


def droppable(entries: DataFrame, models: Sequence[str], before: str | None = None, after: str | None = None) -> DataFrame:
    """Entries of a manifest (see ``manifest_models``) of these models that were created in [after, before). An unknown date passes, a bad limit is none."""
    created = date_or_null(F.col("created_at"))
    rows = entries.where(F.col("model").isin(list(models)) & ~F.col("deleted"))
    for limit, keep in ((before, lambda c, at: c < at), (after, lambda c, at: c >= at)):
        if limit:
            at = date_or_null(F.lit(limit))
            rows = rows.where(created.isNull() | at.isNull() | keep(created, at))
    return rows


def planned(entries: DataFrame) -> DataFrame:
    """One row a model: sorted partitions, sorted schema versions, rows."""
    return entries.groupBy("model").agg(F.sort_array(F.collect_set("partition")).alias("partitions"), F.sort_array(F.collect_set("schema_version")).alias("schema_versions"), F.sum("rows").alias("rows"))


def plan_drop(spark: SparkSession, manifest_path: str, models: Sequence[str], before: str | None = None, after: str | None = None, reason: str | None = None) -> dict[str, Any]:
    """A drop configuration for review; nothing is changed."""
    entries = metadata.manifest_models(spark, metadata.load_manifest(spark, manifest_path))
    plan = {}
    for r in planned(droppable(entries, models, before, after)).collect():  # one row a model
        plan[r["model"]] = {"partitions": r["partitions"]} | ({"schema_versions": r["schema_versions"]} if r["schema_versions"] else {}) | ({"reason": reason} if reason else {})
    limits = {k: v for k, v in (("before", before), ("after", after)) if v}
    return {"generated_at": now(), "source_manifest": manifest_path, "models": {m: plan[m] for m in models if m in plan}} | limits


def apply_drop(spark: SparkSession, config: Mapping[str, Any], manifest_path: str, apply: bool = False, performed_by: str | None = None) -> list[dict[str, Any]]:
    """Mark a configuration's entries as deleted in the manifest, or only tell which if not ``apply``. Schema versions are recorded, not compared."""
    manifest, drops, out = metadata.load_manifest(spark, manifest_path), parse_drop_config(config), []
    by_name = {p["name"]: p for p in manifest["partitions"]}
    for model, drop in drops.items():
        for name in drop["partitions"]:
            entry = (by_name.get(name, {}).get("models") or {}).get(model)
            if entry is None or entry.get("deleted"):
                continue
            out.append({"model": model, "partition": name, "rows": entry.get("rows", 0), "reason": drop["reason"]})
            if apply:
                entry.update(deleted=True, deleted_at=now(), drop_reason=drop["reason"], drop_schema_versions=drop["schema_versions"])
    if apply and out:
        manifest["drops"].append({"config": dict(config), "performed_at": now(), "performed_by": performed_by})
        files.write_json(spark, manifest_path, manifest)
    return out


def undo_drop(spark: SparkSession, manifest_path: str, model: str, partitions: Sequence[str]) -> int:
    """Take back the marks of a drop; returns how many there were."""
    manifest, n = metadata.load_manifest(spark, manifest_path), 0
    for p in manifest["partitions"]:
        entry = (p.get("models") or {}).get(model)
        if p["name"] in partitions and entry and entry.pop("deleted", None):
            n += 1
            for key in ("deleted_at", "drop_reason", "drop_schema_versions"):
                entry.pop(key, None)
    files.write_json(spark, manifest_path, manifest)
    return n


def apply_drop_to_index(spark: SparkSession, config: Mapping[str, Any], index_path: str, apply: bool = False) -> dict[str, int]:
    """Documents of the index that a drop configuration names, by model; deleted if ``apply``."""
    drops = parse_drop_config(config)
    return {m: index_ops.delete(spark, index_path, index_ops.drop_filter(m, d["partitions"], d["schema_versions"]), apply) for m, d in drops.items()}


def delete_stale(spark: SparkSession, manifest_path: str, index_path: str) -> list[str]:
    """Remove the documents of stale partitions from the index, in whatever collections they are, and mark the partitions as deleted."""
    manifest, out = metadata.load_manifest(spark, manifest_path), []
    for p in manifest["partitions"]:
        if p.get("stale") and not p.get("deleted"):
            index_ops.delete(spark, index_path, {"partition_name": p["name"]})
            p.update(deleted=True, deleted_at=now())
            out.append(p["name"])
    if out:
        files.write_json(spark, manifest_path, manifest)
    return out


def drop_impact(entries: DataFrame) -> DataFrame:
    """Rows and partitions by model."""
    return entries.groupBy("model").agg(F.sum("rows").alias("rows"), F.count_distinct("partition").alias("partitions"))


# Progress


def status(states: DataFrame, errors: DataFrame, configured: DataFrame, partitions: DataFrame) -> DataFrame:
    """partition, status for each of ``partitions``.

    ``states`` are model states, ``errors`` error reports (partition, model, max_row) and ``configured`` (partition, model).
    finished: all models complete, and all that are configured there. Else, with errors: started if every failing model has got past
    its last failing row (or the partition has, where no report names a model), errored if not. Else started or not by the states.
    """
    per_model = states.groupBy("partition", "model").agg(F.bool_and("complete").alias("complete"), F.bool_or("started").alias("started"), F.max("row_index").alias("row"))
    per_error = errors.where("max_row IS NOT NULL").groupBy("partition", "model").agg(F.max("max_row").alias("max_row"))
    named = per_error.where("model IS NOT NULL").join(per_model, ["partition", "model"], "left")
    passed = named.groupBy("partition").agg(F.bool_and(F.coalesce(F.col("row") > F.col("max_row"), F.lit(False))).alias("passed"))
    overall = per_error.groupBy("partition").agg(F.max("max_row").alias("worst"))
    n_errors = errors.groupBy("partition").agg(F.count(F.lit(1)).alias("errors"))
    wanted = configured.withColumn("configured", F.lit(True)).join(per_model, ["partition", "model"], "full_outer")
    rolled = wanted.groupBy("partition").agg(
        F.bool_and(F.coalesce("complete", F.lit(False))).alias("all_complete"),
        F.count("complete").alias("models"),
        F.bool_or(F.col("configured")).alias("has_config"),
        F.bool_or(F.coalesce("started", F.lit(False)) & F.coalesce("configured", F.lit(False))).alias("configured_started"),
        F.bool_or(F.coalesce("started", F.lit(False))).alias("any_started"),
        F.max("row").alias("progress"),
    )
    every = partitions.select("partition").distinct()
    for more in (rolled, passed, overall, n_errors):
        every = every.join(more, "partition", "left")
    past = F.when(F.col("passed").isNotNull(), F.col("passed")).otherwise(F.coalesce(F.col("progress") > F.col("worst"), F.lit(False)))
    started = F.when(F.coalesce("has_config", F.lit(False)), F.col("configured_started")).otherwise(F.col("any_started"))
    found = F.when((F.col("models") > 0) & F.col("all_complete"), "finished").when(F.col("errors") > 0, F.when(past, "started").otherwise("errored")).when((F.col("models") > 0) & started, "started").otherwise("not_started")
    return every.select("partition", found.alias("status"))


def newest_errors(errors: DataFrame, n: int = 5) -> DataFrame:
    """The last reports by file name."""
    return errors.orderBy(F.desc("file")).limit(n)


def max_failing_row(errors: DataFrame) -> DataFrame:
    return errors.groupBy("partition", "model").agg(F.max("max_row").alias("max_row"))


def partition_status(spark: SparkSession, out_dir: str, config_dir: str | None = None, config_name: str = "index_config.json") -> DataFrame:
    """The status of the partition directories below ``out_dir``."""
    names = metadata.partition_directories(spark, out_dir)
    configured = []
    for name in names:
        path = f"{config_dir or out_dir}/{name}/{config_name}"
        if files.exists(spark, path):
            found = files.read_json(spark, path)
            configured += [(name, m) for m, c in found.items() if isinstance(c, Mapping) and c.get("path")] if isinstance(found, Mapping) else []
    partitions = spark.createDataFrame([(n,) for n in names], "partition string")
    states = metadata.model_states(metadata.state_files(spark, out_dir))
    return status(states, metadata.error_reports(spark, out_dir), spark.createDataFrame(configured, "partition string, model string"), partitions)


def unchanged(state: Mapping[str, Any] | None, signature: Mapping[str, int] | None) -> bool:
    """Whether a model needs no new run: it is complete and its source has the same time and size."""
    return bool(state and state.get("complete") and signature and state.get("source_signature") == signature)


# Routing


def model_routing(states: DataFrame) -> DataFrame:
    """model, collections, total_documents, partitions of models that were started and hold documents."""
    held = states.where("started AND collection_count > 0")
    return held.groupBy("model").agg(F.sort_array(F.collect_set("collection")).alias("collections"), F.sum("collection_count").alias("total_documents"), F.sort_array(F.collect_set("partition")).alias("partitions"))


def collection_routing(states: DataFrame) -> DataFrame:
    return states.where("started AND collection_count > 0").groupBy("collection").agg(F.sort_array(F.collect_set("model")).alias("models"))


def routing(spark: SparkSession, out_dir: str, output: str | None = None, prefix: str | None = None) -> dict[str, Any]:
    """The routing of a directory of partitions; its totals count the collections of all readable state files, and the models that are routed."""
    if not files.exists(spark, out_dir):
        raise ValueError(f"{out_dir} is not a directory")
    found = metadata.state_files(spark, out_dir)
    states = metadata.model_states(found)
    models = {r["model"]: {"collections": r["collections"], "total_documents": r["total_documents"], "partitions": r["partitions"]} for r in model_routing(states).collect()}
    by_collection = {r["collection"]: r["models"] for r in collection_routing(states).collect()}
    about = {"total_collections": found.select("collection").distinct().count(), "total_models": len(models), "generated_at": now(), "partition_out_dir": out_dir} | ({"collection_prefix": prefix} if prefix else {})
    out = {"model_to_collections": models, "collection_to_models": by_collection, "metadata": about}
    if output:
        files.write_json(spark, output, out)
    return out
