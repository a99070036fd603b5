"""Vector expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """0 if a norm is 0; ``eps`` is added to the denominator."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / (size + eps)).otherwise(F.lit(0.0))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column) -> Column:
    """Null where the norm is 0 or not a number."""
    n = norm(a)
    return F.when((n > 0) & ~F.isnan(n), F.transform(a, lambda x: x / n))
