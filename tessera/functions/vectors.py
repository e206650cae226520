"""Distances between array columns by higher-order functions, in double precision and element order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def inner_product_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


#: Smaller is nearer in each.
METRICS = {"l2": squared_l2, "cosine": cosine_distance, "ip": inner_product_distance}
