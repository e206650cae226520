"""Scalar text functions as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Joins the values of a row before it is hashed: U+241F.
UNIT_SEPARATOR = "␟"
# White space as Unicode has it, and the four separators U+001C to U+001F.
_SPACE = r"[\s\x{1c}-\x{1f}]+"
_LEFT, _RIGHT = f"(?U)^{_SPACE}", f"(?U){_SPACE}$"


def strip(c: Column) -> Column:
    """Without white space at either end; trim() would only take U+0020."""
    return F.regexp_replace(F.regexp_replace(c, _LEFT, ""), _RIGHT, "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, _RIGHT, "")


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def row_digest(*columns: Column) -> Column:
    """SHA-1 of the values in order; a null is an empty value, which concat_ws alone would leave out."""
    return F.sha1(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def doc_id(model: Column | str, record: Column) -> Column:
    """``model:`` and the SHA-1 of a struct's JSON with its fields in alphabetical order, nulls included.

    ``record`` must be a struct with sorted fields, see :func:`sorted_struct`. The JSON is Spark's own, so ids
    agree among themselves; for those of Python's json.dumps use :func:`doc_id_python`.
    """
    name = F.lit(model) if isinstance(model, str) else model
    return F.concat(name, F.lit(":"), F.sha1(F.to_json(record, {"ignoreNullFields": "false"})))


def sorted_struct(names: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{n}`") for n in sorted(names)])


def doc_id_python(model: str, record: dict) -> str:
    """The id whose hash is over json.dumps(record, sort_keys=True, default=str)."""
    return f"{model}:{hashlib.sha1(json.dumps(record, sort_keys=True, default=str).encode()).hexdigest()}"


def join_filled(separator: str, *columns: Column) -> Column:
    """The values that are neither null nor empty, in order."""
    return F.concat_ws(separator, *[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def byte_trim(c: Column, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8, without a character that was cut and white space at the end."""
    cut = F.make_valid_utf8(F.substring(c.cast("binary"), 1, limit).cast("string"))
    return F.when(F.octet_length(c) <= limit, c).otherwise(rstrip(F.regexp_replace(cut, r"\x{FFFD}+$", "")))


def token_count(c: Column) -> Column:
    """Words between white space; null and empty text have none. For another count see :mod:`tessera.functions.truncate`."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def sentences(c: Column) -> Column:
    """Split after . ! or ? before white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def slug(c: Column, default: str = "config") -> Column:
    found = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z_.-]", "_")


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def preview(c: Column, n: int = 200) -> Column:
    return F.substring(c, 1, n)


def date_or_null(c: Column) -> Column:
    """A date or an ISO date and time, null if it is neither."""
    return F.try_to_timestamp(c)


def int_or_null(c: Column) -> Column:
    """A whole number from a number or a numeric string, null for anything else."""
    return F.when(c.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), strip(c.cast("string")).try_cast("long"))


def partition_name(number: Column) -> Column:
    return F.format_string("partition_%05d", number)


def collection_name(partition: Column, prefix: str | None = None) -> Column:
    return F.concat(F.lit(f"{prefix}_"), partition) if prefix else partition


def collection_of_state_file(path: Column) -> Column:
    """The collection whose state a file holds, null for another file name."""
    return F.nullif(F.regexp_extract(path, r"([^/]+)_resume_state\.json$", 1), F.lit(""))


def reduction_percent(before: Column, after: Column) -> Column:
    return (before - after) / before * 100


def human_bytes(n: float) -> str:
    """A size for people, on the driver."""
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if abs(n) < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} PB"


def suggest_strategy(text: Column, model: Column | str, semantic_fields: Sequence[str]) -> Column:
    """The truncation that suits a document: its beginning for tables, whole sentences for prose fields, else both ends."""
    name = F.lit(model) if isinstance(model, str) else model
    table = (name == "Table") | F.contains(F.substring(F.lower(text), 1, 200), F.lit("table"))
    prose = bool({"documentation", "help_text", "description"} & set(semantic_fields))
    return F.when(table, "end").otherwise("sentences" if prose else "middle_out")
