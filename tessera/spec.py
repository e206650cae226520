"""Declared tables, their registry, and the configurations that name their sources."""

from __future__ import annotations

import hashlib
import importlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql.types import StringType, StructField, StructType

TRUNCATIONS = (None, "end", "start", "middle_out", "sentences")


@dataclass(frozen=True)
class TableSpec:
    """One logical table: its fields, those that are searched by meaning (in order), and those kept as metadata."""

    name: str
    schema: StructType
    semantic_fields: tuple[str, ...] = ()
    keyword_fields: tuple[str, ...] = ()
    #: A validator of rows after casting, for rules that types can't express: it returns the fields, or None or a ValueError or TypeError for an invalid row.
    check: Callable[[dict[str, Any]], Mapping[str, Any] | None] | None = field(default=None, compare=False)

    @classmethod
    def of_strings(cls, name: str, required: Sequence[str], optional: Sequence[str] = (), **kwargs) -> TableSpec:
        fields = [StructField(f, StringType(), False) for f in required] + [StructField(f, StringType(), True) for f in optional]
        return cls(name, StructType(fields), **kwargs)

    @property
    def fields(self) -> list[str]:
        return self.schema.fieldNames()

    def signature(self) -> str:
        """SHA-1 of the fields by name: it changes if and only if a field, its type or whether it is required does."""
        fields = [{"name": f.name, "type": f.dataType.simpleString(), "required": not f.nullable} for f in sorted(self.schema.fields, key=lambda f: f.name)]
        return hashlib.sha1(json.dumps({"model": self.name, "fields": fields}, sort_keys=True).encode()).hexdigest()


def load_registry(target: str) -> dict[str, TableSpec]:
    """The registry at ``module:attribute[.attribute]``: a mapping from names to specs that isn't empty."""
    found = load_attribute(target)
    if not isinstance(found, Mapping) or not found:
        raise TypeError(f"{target} is not a mapping with entries")
    for name, spec in found.items():
        if not isinstance(name, str) or not isinstance(spec, TableSpec):
            raise TypeError(f"{target}: {name!r} is not a name with a TableSpec")
    return dict(found)


def load_attribute(target: str) -> Any:
    """What ``module:attribute[.attribute]`` names."""
    module, sep, path = target.partition(":")
    if not module or not sep or not path:
        raise ValueError(f"{target!r} is not of the form module:attribute")
    found: Any = importlib.import_module(module)
    for part in path.split("."):
        found = getattr(found, part)
    return found


def _columns(name: str, raw: Any) -> dict[str, str]:
    if raw is None:
        return {}
    if not isinstance(raw, Mapping) or not all(isinstance(k, str) and isinstance(v, str) for k, v in raw.items()):
        raise ValueError(f"{name}: columns must map names to names")
    return dict(raw)


@dataclass(frozen=True)
class SourceConfig:
    """Where a table's rows come from and how its files are read. No path: the table is skipped."""

    path: str = ""
    columns: Mapping[str, str] = field(default_factory=dict)
    character_encoding: str = "utf-8"
    delimiter: str = ","
    malformed_column: int | None = None
    header_row: str = "all"
    drop_na_columns: tuple[str, ...] = ()

    @classmethod
    def parse(cls, name: str, raw: Any) -> SourceConfig:
        """From a null, a path, or an object; each field is checked."""
        if raw is None or raw == "":
            return cls()
        if isinstance(raw, str):
            return cls(path=raw)
        if not isinstance(raw, Mapping):
            raise ValueError(f"{name}: an entry is null, a path or an object")
        c = cls(
            path=raw.get("path") or "",
            columns=_columns(name, raw.get("columns")),
            character_encoding=raw.get("character_encoding") or "utf-8",
            delimiter=raw.get("delimiter", ","),
            malformed_column=raw.get("malformed_column"),
            header_row=raw.get("header_row") or "all",
            drop_na_columns=tuple(raw.get("drop_na_columns") or ()),
        )
        if not isinstance(c.path, str) or not isinstance(c.character_encoding, str):
            raise ValueError(f"{name}: path and character_encoding are strings")
        if not isinstance(c.delimiter, str) or not c.delimiter:
            raise ValueError(f"{name}: delimiter is a string that isn't empty")
        if c.malformed_column is not None and (isinstance(c.malformed_column, bool) or not isinstance(c.malformed_column, int) or c.malformed_column < 1):
            raise ValueError(f"{name}: malformed_column counts from 1")
        if c.header_row not in ("all", "first-only"):
            raise ValueError(f"{name}: header_row is all or first-only")
        if not all(isinstance(x, str) for x in c.drop_na_columns):
            raise ValueError(f"{name}: drop_na_columns is a list of names")
        return c


@dataclass(frozen=True)
class IndexConfig:
    """A table's rows for the index: where they are, how columns are mapped, how long texts are cut."""

    path: str = ""
    columns: Mapping[str, str] = field(default_factory=dict)
    truncation_strategy: str | None = None

    @classmethod
    def parse(cls, name: str, raw: Any) -> IndexConfig:
        if raw is None or raw == "":
            return cls()
        if isinstance(raw, str):
            return cls(path=raw)
        if not isinstance(raw, Mapping):
            raise ValueError(f"{name}: an entry is null, a path or an object")
        if raw.get("truncation_strategy") not in TRUNCATIONS:
            raise ValueError(f"{name}: truncation_strategy is one of {TRUNCATIONS}")
        return cls(raw.get("path") or "", _columns(name, raw.get("columns")), raw.get("truncation_strategy"))


def parse_configs(raw: Any, registry: Mapping[str, TableSpec], kind: type = SourceConfig) -> dict[str, Any]:
    """Configurations of the registry's tables, in its order; a name that the registry lacks is an error."""
    if not isinstance(raw, Mapping):
        raise ValueError("a configuration is an object of entries by table")
    if unknown := set(raw) - set(registry):
        raise ValueError(f"not in the registry: {sorted(unknown)}")
    return {name: kind.parse(name, raw[name]) for name in registry if name in raw}


def parse_drop_config(raw: Any) -> dict[str, dict]:
    """The models of a drop configuration: {model: {partitions, schema_versions?, reason?}}."""
    if not isinstance(raw, Mapping) or not isinstance(raw.get("models"), Mapping):
        raise ValueError("a drop configuration has an object models")
    out = {}
    for model, entry in raw["models"].items():
        if not isinstance(entry, Mapping):
            raise ValueError(f"{model}: an entry is an object")
        partitions, versions, reason = entry.get("partitions"), entry.get("schema_versions") or [], entry.get("reason")
        if not isinstance(partitions, list) or not partitions or not all(isinstance(p, str) for p in partitions):
            raise ValueError(f"{model}: partitions is a list of names that isn't empty")
        if not isinstance(versions, list) or not all(isinstance(v, int) and not isinstance(v, bool) for v in versions):
            raise ValueError(f"{model}: schema_versions is a list of integers")
        if reason is not None and not isinstance(reason, str):
            raise ValueError(f"{model}: reason is a string")
        out[model] = {"partitions": partitions, "schema_versions": versions, "reason": reason}
    return out


def source_stub(registry: Mapping[str, TableSpec], models: Sequence[str] | None = None) -> dict[str, dict]:
    """An empty source configuration to fill in."""
    return {
        name: {"path": "", "columns": {f: f for f in spec.fields}, "character_encoding": "utf-8", "delimiter": ",", "malformed_column": None, "header_row": "all", "drop_na_columns": []}
        for name, spec in registry.items()
        if not models or name in models
    }


def index_stub(registry: Mapping[str, TableSpec]) -> dict[str, dict]:
    return {name: {"path": "", "columns": {f: f for f in spec.fields}, "truncation_strategy": None} for name, spec in registry.items()}


def active(configs: Mapping[str, Any]) -> list[str]:
    """The tables that have a path."""
    return [name for name, c in configs.items() if c.path]
