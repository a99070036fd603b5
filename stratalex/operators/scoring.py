"""Transparent weighted scores and filters within groups of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the decomposition score; they sum to 1.1 and are divided by that.
WEIGHTS = {"beam": 0.20, "quality": 0.20, "coverage": 0.20, "acceptance": 0.15, "specificity": 0.15, "ambiguity": -0.10, "coherence": 0.10}


def weighted(weights: dict[str, float] = WEIGHTS) -> Column:
    total = sum(abs(w) for w in weights.values())
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(w / total) * F.coalesce(F.col(name), F.lit(0.0))
    return out


def min_max(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``value`` scaled to 0..1 within the group; 1 if all are equal."""
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn(out, F.when(high == low, F.lit(1.0)).otherwise((F.col(value) - low) / (high - low)))


def best_covering(rows: DataFrame, key: str) -> DataFrame:
    """Three filters: supported, of the group's greatest coverage, and of positive specificity."""
    supported = rows.where("support > 0")
    top = supported.withColumn("__top", F.max("coverage").over(Window.partitionBy(key))).where("coverage = __top").drop("__top")
    return top.where("specificity > 0")


def triage(cohesion: Column, floor: Column, members: Column, incompatible: Column, scattered: Column, dropped: Column) -> Column:
    """Whether and why a cluster is skipped; null if it is kept. Fixed values."""
    strikes = (cohesion < floor - 0.10).cast("int") + ((dropped == 0) & (members >= 5)).cast("int") + (incompatible >= 0.18).cast("int") + (scattered >= 0.33).cast("int")
    return (
        F.when(scattered >= 0.45, F.lit("extreme_scatter"))
        .when(incompatible >= 0.45, F.lit("extreme_incompatible"))
        .when((members <= 3) & (cohesion < floor - 0.10) & ((incompatible >= 0.18) | (scattered >= 0.33)), F.lit("small_and_loose"))
        .when((members >= 4) & (cohesion < floor) & ((incompatible >= 0.18) | (scattered >= 0.33)), F.lit("loose"))
        .when((members > 3) & (strikes >= 2), F.lit("two_strikes"))
    )


def running_prefix(rows: DataFrame, key: str, order: list, weight: str, budget: int) -> DataFrame:
    """Rows in order until the running sum of ``weight`` would pass ``budget``; the first that does ends it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(weight).over(w)).where(F.col("running") <= budget)
