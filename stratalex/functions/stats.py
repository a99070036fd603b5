"""Association measures over columns of counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ratio that stands in for one without a denominator.
LEAST = 1e-9


def pmi(both: Column, a: Column, b: Column, total: Column) -> Column:
    """log2 of observed over expected co-occurrence."""
    product = a.cast("double") * b
    return F.log2(F.when(product > 0, both * total / product).otherwise(F.lit(LEAST)))


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def log_likelihood(both: Column, a: Column, b: Column, total: Column) -> Column:
    """Dunning's G2 of the 2 x 2 table of a and b."""
    k11, k12, k21 = both.cast("double"), (a - both).cast("double"), (b - both).cast("double")
    k22 = (total - a - b + both).cast("double")
    rows = xlogx(k11 + k12) + xlogx(k21 + k22)
    cols = xlogx(k11 + k21) + xlogx(k12 + k22)
    cells = xlogx(k11) + xlogx(k12) + xlogx(k21) + xlogx(k22)
    return 2 * (cells - rows - cols + xlogx(k11 + k12 + k21 + k22))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return safe_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def smoothed(count: Column, total: Column, inventory: Column, k: float = 0.5) -> Column:
    """Add-k conditional probability."""
    return (count + k) / (total + k * inventory)


def cohesion_floor(members: Column, gram: Column) -> Column:
    """Least cohesion asked of a cluster by its size and its n-gram's length. Fixed values."""
    base = F.when(members <= 0, 0.23).when(members <= 3, 0.30).when(members <= 5, 0.27).when(members <= 10, 0.23).otherwise(0.18)
    return clamp(base + F.when(gram <= 2, -0.05).when(gram >= 5, 0.05).otherwise(0.0), 0.05, 0.95)


def specificity(definitions: Column) -> Column:
    return F.when(definitions <= 0, 0.5).otherwise(1 / (1 + F.log1p(F.greatest(definitions - 1, F.lit(0)))))


def ambiguity(definitions: Column) -> Column:
    return F.when(definitions <= 1, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(definitions - 1) / F.log1p(F.lit(8.0))))
