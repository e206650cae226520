"""Filters given as dictionaries, compiled to Column expressions that Catalyst can push down.

``where`` on metadata: ``{"field": value}`` means equality; operators are $eq $ne $gt $gte $lt $lte $in $nin; $and and $or take lists;
several keys are all needed. A row without the field passes $ne and $nin only.
``where_document`` on text: $contains, $not_contains, $regex, $and, $or.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: c.isNull() | ~c.isin(list(v)),
}
_CONTENT: dict[str, Callable[[Column, Any], Column]] = {
    "$contains": lambda c, v: F.contains(c, F.lit(v)),
    "$not_contains": lambda c, v: ~F.contains(c, F.lit(v)),
    "$regex": lambda c, v: c.rlike(v),
}


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _joined(key: str, value: Any, one: Callable[[Any], Column]) -> Column:
    if not isinstance(value, list) or not value:
        raise ValueError(f"{key} takes a list that isn't empty")
    return (_all if key == "$and" else _any)([one(v) for v in value])


def where(filters: Mapping[str, Any], column: Callable[[str], Column] = lambda k: F.col(f"`{k}`")) -> Column:
    """The expression for a metadata filter; ``column`` finds the column of a field."""
    if not filters:
        return F.lit(True)
    parts = []
    for key, value in filters.items():
        if key in ("$and", "$or"):
            parts.append(_joined(key, value, lambda v: where(v, column)))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, Mapping):
            if unknown := set(value) - set(_COMPARE):
                raise ValueError(f"unknown operators {sorted(unknown)}")
            parts += [_COMPARE[op](column(key), v) for op, v in value.items()]
        else:
            parts.append(column(key) == value)
    return _all(parts)


def where_document(filters: Mapping[str, Any], document: Column | None = None) -> Column:
    """The expression for a filter on the document's text."""
    text = F.col("document") if document is None else document
    parts = []
    for key, value in filters.items():
        if key in ("$and", "$or"):
            parts.append(_joined(key, value, lambda v: where_document(v, text)))
        elif key in _CONTENT:
            parts.append(_CONTENT[key](text, value))
        else:
            raise ValueError(f"unknown operator {key}")
    return _all(parts) if parts else F.lit(True)


def metadata_column(promoted: set[str], metadata: str = "metadata") -> Callable[[str], Column]:
    """Fields that are columns of their own, and others from a map of strings."""
    return lambda key: F.col(f"`{key}`") if key in promoted else F.col(metadata)[key]
