"""Vectors as arrays of doubles, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero if a vector is missing or has no length."""
    product = norm(a) * norm(b)
    return F.coalesce(F.when(product > 0, dot(a, b) / product), F.lit(0.0))


def unit(a: Column) -> Column:
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)
