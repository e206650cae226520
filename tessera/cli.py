"""Commands: prepare, new-config, plan-drop, apply-drop, index, display, status, routing, query."""

from __future__ import annotations

import argparse
import json
import logging
import logging.handlers
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .functions.text import human_bytes
from .operators import index as index_ops
from .operators import search
from .operators.batches import BATCH_SIZE, TOKEN_LIMIT
from .operators.rows import top_with_rest
from .plans import lifecycle, prepare
from .sources import files
from .spec import IndexConfig, SourceConfig, index_stub, load_attribute, load_registry, parse_configs, source_stub

log = logging.getLogger("tessera")


def session() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def set_up_logging(level: str = "INFO", file: str | None = None, max_bytes: int = 100 << 20, backups: int = 10, console: bool = True) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()] if console else []
    if file:
        handlers.append(logging.handlers.RotatingFileHandler(file, maxBytes=max_bytes, backupCount=backups))
        log.debug("log files of %s", human_bytes(max_bytes))
    logging.basicConfig(level=level.upper(), handlers=handlers or [logging.NullHandler()], format="%(asctime)s %(levelname)s %(message)s", force=True)


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--model", help="registry, as module:attribute")
    common.add_argument("--log-level", default="INFO")
    common.add_argument("--log-file")
    common.add_argument("--log-max-bytes", type=int, default=100 << 20)
    common.add_argument("--log-backup-count", type=int, default=10)
    common.add_argument("--log-no-console", action="store_true")
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)
    add = lambda name: commands.add_parser(name, parents=[common])
    p = add("prepare")
    p.add_argument("--config", required=True)
    p.add_argument("--output-root", required=True)
    p.add_argument("--directory-size", type=int, default=0)
    p.add_argument("--manifest")
    p = add("new-config")
    p.add_argument("output")
    p.add_argument("--models", nargs="*")
    p.add_argument("--kind", choices=("source", "index"), default="source")
    p.add_argument("--force", action="store_true")
    p = add("plan-drop")
    p.add_argument("--manifest", required=True)
    p.add_argument("--models", nargs="+", required=True)
    p.add_argument("--before")
    p.add_argument("--after")
    p.add_argument("--reason")
    p.add_argument("--output")
    p = add("apply-drop")
    p.add_argument("--config", required=True)
    p.add_argument("--manifest")
    p.add_argument("--index")
    p.add_argument("--apply", action="store_true")
    p.add_argument("--performed-by")
    p = add("index")
    p.add_argument("--partition-manifest", required=True)
    p.add_argument("--output-root", required=True)
    p.add_argument("--index", required=True)
    p.add_argument("--config")
    p.add_argument("--collection")
    p.add_argument("--collection-prefix")
    p.add_argument("--truncation-strategy", default="auto", choices=("auto", "end", "start", "middle_out", "sentences"))
    p.add_argument("--embedding-token-limit", type=int, default=8191)
    p.add_argument("--skip-validation", action="store_true")
    p.add_argument("--partition-out-dir", help="directory for states and error reports")
    p.add_argument("--resume", action="store_true", help="pass over partitions that are complete and unchanged, by the states in --partition-out-dir")
    p.add_argument("--embedding", help="embedding function, as module:attribute; the default hashes words")
    p.add_argument("--batch-size", type=int, default=BATCH_SIZE, help="documents in a request")
    p.add_argument("--token-limit", type=int, default=TOKEN_LIMIT, help="tokens in a request")
    p.add_argument("--delete-stale", action="store_true")
    p.add_argument("--e2e-sample-size", type=int, help="write a sample of documents to --e2e-output")
    p.add_argument("--e2e-output")
    p.add_argument("--e2e-random-seed", type=int, default=0)
    p = add("display")
    p.add_argument("--index", required=True)
    p.add_argument("--top", type=int, default=20)
    p = add("status")
    p.add_argument("--partition-out-dir", required=True)
    p.add_argument("--partition-dir")
    p.add_argument("--partition-config-name", default="index_config.json")
    p = add("generate-query-config")
    p.add_argument("--partition-out-dir", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--collection-prefix")
    p = add("query")
    p.add_argument("text", nargs="+")
    p.add_argument("--index", required=True)
    p.add_argument("--routing")
    p.add_argument("--models", nargs="*")
    p.add_argument("--n-results", type=int, default=10)
    return top


def _registry(args):
    if not args.model:
        raise ValueError("--model is needed")
    return load_registry(args.model)


def execute(args: argparse.Namespace, spark: SparkSession) -> object:
    """What a command returns, to be printed as JSON."""
    if args.command == "prepare":
        registry = _registry(args)
        manifest = prepare.run(spark, parse_configs(files.read_json(spark, args.config), registry, SourceConfig), registry, args.output_root, args.directory_size, args.manifest)
        return {"partitions": [p["name"] for p in manifest["partitions"]], "rows": sum(p["rows"] for p in manifest["partitions"])}
    if args.command == "new-config":
        if files.exists(spark, args.output) and not args.force:
            raise FileExistsError(args.output)
        registry = _registry(args)
        files.write_json(spark, args.output, source_stub(registry, args.models) if args.kind == "source" else index_stub(registry))
        return {"written": args.output}
    if args.command == "plan-drop":
        plan = lifecycle.plan_drop(spark, args.manifest, args.models, args.before, args.after, args.reason)
        if args.output:
            files.write_json(spark, args.output, plan)
        return plan
    if args.command == "apply-drop":
        config = files.read_json(spark, args.config)
        out: dict[str, object] = {"applied": args.apply}
        if args.index:
            out["documents"] = lifecycle.apply_drop_to_index(spark, config, args.index, args.apply)
        if args.manifest:
            out["entries"] = lifecycle.apply_drop(spark, config, args.manifest, args.apply, args.performed_by)
        return out
    if args.command == "index":
        registry = _registry(args)
        configs = parse_configs(files.read_json(spark, args.config), registry, IndexConfig) if args.config else None
        if args.resume and not args.partition_out_dir:
            raise ValueError("--resume needs --partition-out-dir")
        prepare.index_partitions(
            spark, args.partition_manifest, args.output_root, registry, args.index, configs, args.collection_prefix, args.collection, strict=not args.skip_validation, strategy=args.truncation_strategy, embedding_tokens=args.embedding_token_limit,
            embedding=load_attribute(args.embedding) if args.embedding else None, batch_size=args.batch_size, token_limit=args.token_limit, states_dir=args.partition_out_dir, resume=args.resume,
        )
        if args.delete_stale:
            lifecycle.delete_stale(spark, args.partition_manifest, args.index)
        if args.e2e_sample_size and index_ops.open_index(spark, args.index) is not None:
            from .operators.documents import audit_sample

            audit_sample(index_ops.open_index(spark, args.index), args.e2e_sample_size, seed=args.e2e_random_seed).write.mode("overwrite").json(args.e2e_output)
        return [r.asDict() for r in prepare.index_counts(spark, args.index).orderBy("collection", "model_name").collect()]
    if args.command == "display":
        index = index_ops.open_index(spark, args.index)
        return [] if index is None else [r.asDict() for r in top_with_rest(search.model_stats(index), "model_name", "documents", args.top).collect()]
    if args.command == "status":
        return {r["partition"]: r["status"] for r in lifecycle.partition_status(spark, args.partition_out_dir, args.partition_dir, args.partition_config_name).orderBy("partition").collect()}
    if args.command == "generate-query-config":
        return lifecycle.routing(spark, args.partition_out_dir, args.output, args.collection_prefix)
    with search.Client(spark, args.index, files.read_json(spark, args.routing) if args.routing else None, index_ops.HashingEmbedding()) as client:
        return client.query(args.text, n_results=args.n_results, models=args.models)


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    set_up_logging(args.log_level, args.log_file, args.log_max_bytes, args.log_backup_count, not args.log_no_console)
    try:
        print(json.dumps(execute(args, session()), indent=2, ensure_ascii=False, default=str))
    except (ValueError, TypeError, OSError, RuntimeError) as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
