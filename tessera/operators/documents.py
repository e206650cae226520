"""Documents from rows: identifier, text and metadata, kept within byte and token budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import blank_to_null, byte_length, byte_trim, doc_id, join_filled, sorted_struct, suggest_strategy, token_count
from ..functions.truncate import Counter, count_words, truncate
from ..spec import TableSpec
from .rows import remap

#: Bytes that a document may have before it is compacted.
MOST_BYTES = 16_384
# Fixed value: marks of layout that compaction removes.
_MARKS = r"RESET\s*N\d+|NEW-PAGE(?:\s+\w+)?|\*{5,}"


def typed(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows: blank strings are null, each field is cast to its declared type, a value that can't be cast or a null in a required field is invalid."""
    plain = {f.name: blank_to_null(F.col(f"`{f.name}`").cast("string")) if f.name in df.columns else F.lit(None).cast("string") for f in spec.schema.fields}
    cast = {f.name: plain[f.name] if f.dataType.typeName() == "string" else plain[f.name].try_cast(f.dataType) for f in spec.schema.fields}
    bad = F.lit(False)
    for f in spec.schema.fields:
        wrong = plain[f.name].isNotNull() & cast[f.name].isNull()
        bad = bad | wrong | (cast[f.name].isNull() if not f.nullable else F.lit(False))
    checked = df.withColumns({**cast, "_bad": bad})
    return checked.where("NOT _bad").drop("_bad"), checked.where("_bad").drop("_bad")


def checked(df: DataFrame, check: Callable[[dict[str, Any]], Mapping[str, Any] | None], schema: StructType, fields: Sequence[str] | None = None) -> DataFrame:
    """Rows as a Python validator makes them, for rules that a cast can't express. It returns the fields, or None or a ValueError or TypeError for an invalid row.

    Columns other than ``fields`` (default: all) stay as they are.
    """
    own = set(schema.fieldNames() if fields is None else fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    found = check(row)
                except (ValueError, TypeError):
                    continue
                if found is not None:
                    out.append({name: found.get(name, row.get(name) if name not in own else None) for name in schema.fieldNames()})
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(schema))

    return df.mapInArrow(rows, schema)


def require_valid(df: DataFrame, spec: TableSpec) -> None:
    """Fail on the first invalid row."""
    found = typed(df, spec)[1].select(*[c for c in spec.fields if c in df.columns]).head(1)
    if found:
        raise ValueError(f"{spec.name}: invalid row {found[0].asDict()}")


def semantic_text(spec: TableSpec) -> tuple[Column, Column]:
    """(text, whether it is made of semantic fields): these joined by line ends in declared order, else the whole record as JSON."""
    text = F.nullif(join_filled("\n", *[F.col(f"`{f}`") for f in spec.semantic_fields]), F.lit("")) if spec.semantic_fields else F.lit(None).cast("string")
    return F.coalesce(text, F.to_json(sorted_struct(spec.fields), {"ignoreNullFields": "false"})), text.isNotNull()


def build_documents(rows: DataFrame, spec: TableSpec, columns: Mapping[str, str] | None = None, extra: Mapping[str, str | int] | None = None, source_path: str | None = None, strict: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Rows to doc_id, document, model_name, has_sem, metadata (a map of strings).

    Keyword fields that are not empty are metadata; ``extra`` (such as partition_name and schema_version) overrides them.
    Invalid rows are left out, or fail the run if ``strict``. ``carry`` names columns to keep, which are metadata too.
    """
    mapped = remap(rows, columns or {})
    if strict:
        require_valid(mapped, spec)
    valid, _ = typed(mapped, spec)
    if spec.check is not None:
        valid = checked(valid, spec.check, valid.schema, spec.fields)
    text, has_sem = semantic_text(spec)
    entries: dict[str, Column] = {"model_name": F.lit(spec.name)}
    if source_path is not None:
        entries["source_path"] = F.lit(source_path)
    entries |= {k: F.nullif(F.col(f"`{k}`").cast("string"), F.lit("")) for k in spec.keyword_fields}
    entries |= {k: F.lit(str(v)) for k, v in (extra or {}).items()}
    entries |= {k: F.col(f"`{k}`").cast("string") for k in carry}
    entries["has_sem"] = has_sem.cast("string")
    metadata = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*entries.values())), lambda _, v: v.isNotNull())
    return valid.select(doc_id(spec.name, sorted_struct(spec.fields)).alias("doc_id"), text.alias("document"), F.lit(spec.name).alias("model_name"), has_sem.alias("has_sem"), metadata.alias("metadata"), *[F.col(f"`{c}`") for c in carry])


def first_documents(documents: DataFrame) -> DataFrame:
    """One document an id; equal ids have equal records, so any will do."""
    return documents.dropDuplicates(["doc_id"])


class Compactor(Protocol):
    """Shortens a text; a remote one would be an Arrow-batched UDF."""

    def __call__(self, text: Column) -> Column: ...


def compact_rules(text: Column) -> Column:
    """The default: page and reset marks and runs of stars go, and white space becomes single spaces."""
    return F.regexp_replace(F.regexp_replace(text, _MARKS, ""), r"\s{2,}", " ")


def compact(documents: DataFrame, limit: int = MOST_BYTES, compactor: Compactor = compact_rules) -> DataFrame:
    """Documents of over ``limit`` bytes are compacted, and cut if that isn't enough: adds original_bytes, compacted, compacted_bytes, compaction_fallback."""
    size = byte_length(F.col("document"))
    over = size > limit
    shorter = F.when(over, compactor(F.col("document")))
    out = documents.withColumn("original_bytes", F.when(over, size)).withColumn("_short", shorter)
    failed = over & (byte_length(F.col("_short")) > limit)
    out = out.withColumn("compaction_fallback", F.coalesce(failed, F.lit(False))).withColumn("compacted", F.coalesce(over, F.lit(False)))
    out = out.withColumn("document", F.when(F.col("_short").isNull(), F.col("document")).otherwise(byte_trim(F.col("_short"), limit)))
    return out.withColumn("compacted_bytes", F.when(F.col("compacted"), byte_length(F.col("document")))).drop("_short")


def limit_tokens(documents: DataFrame, budget: int, strategy: str | None = None, semantic_fields: Sequence[str] = (), count: Counter = count_words) -> DataFrame:
    """Documents over the budget are truncated: adds tokens, truncated, original_tokens, truncation_strategy.

    With the default counter, only documents over the budget go through Python.
    """
    chosen = F.lit(strategy) if strategy and strategy != "auto" else suggest_strategy(F.col("document"), F.col("model_name"), semantic_fields)
    columns = [F.col(f"`{c}`") for c in documents.columns if c != "document"]
    if count is count_words:
        n = token_count(F.col("document"))
        short = documents.where(n <= budget).select(*columns, "document", n.alias("tokens"), F.lit(False).alias("truncated"), n.alias("original_tokens"), F.lit(None).cast("string").alias("truncation_strategy"))
        over = documents.where(n > budget)
    else:
        short, over = None, documents
    cut = over.withColumn("truncation_strategy", chosen).withColumn("_t", truncate(F.col("document"), budget, F.col("truncation_strategy"), count))
    cut = cut.select(*columns, F.col("_t.text").alias("document"), F.col("_t.tokens").alias("tokens"), F.col("_t.truncated").alias("truncated"), F.col("_t.original_tokens").alias("original_tokens"), F.when(F.col("_t.truncated"), F.col("truncation_strategy")).alias("truncation_strategy"))
    return cut if short is None else short.unionByName(cut)


def audit_sample(documents: DataFrame, k: int, by: str = "model_name", seed: int = 0) -> DataFrame:
    """``k`` documents of each source, uniform and the same for the same seed, with a preview of 200 characters."""
    from .sampling import stable_sample

    return stable_sample(documents, k, [by], "doc_id", seed).select(by, "doc_id", F.substring("document", 1, 200).alias("preview"), "metadata")
