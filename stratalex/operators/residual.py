"""String subtraction and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences


def subtract(rows: DataFrame) -> DataFrame:
    """host, root, nth, start, end, residual, removed_all: a row for each occurrence of root in host.

    Matching ignores case, residuals keep it; overlapping occurrences are removed together.
    """
    at = occurrences(F.lower("host"), F.lower("root"))
    out = rows.select("host", "root", at.alias("at")).where(F.size("at") > 0)
    n = F.char_length("root")
    chars = F.transform(F.sequence(F.lit(0), F.char_length("host") - 1), lambda i: F.when(~F.exists("at", lambda s: (i >= s) & (i < s + n)), F.substring("host", i + 1, F.lit(1))))
    out = out.withColumn("removed_all", F.array_join(F.filter(chars, lambda c: c.isNotNull()), "")).select("host", "root", "removed_all", F.posexplode("at").alias("nth", "start"))
    return out.select("host", "root", "nth", "start", (F.col("start") + n).alias("end"), F.concat(F.substring("host", F.lit(1), F.col("start")), F.substring("host", F.col("start") + n + 1, F.char_length("host"))).alias("residual"), "removed_all")


def covered(length: Column, spans: Column) -> Column:
    """How many of ``length`` places the half-open spans (s, e) cover; sorted spans are merged."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), F.least(x["e"], length) - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], F.least(x["e"], length)).alias("to"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda a: a["n"])


def gaps(length: Column, spans: Column) -> Column:
    """The uncovered half-open ranges, in order."""
    ends = F.concat(F.array_sort(spans), F.array(F.struct(length.alias("s"), length.alias("e"))))
    step = lambda a, x: F.struct(F.greatest(a["to"], x["e"]).alias("to"), F.when(x["s"] > a["to"], F.concat(a["out"], F.array(F.struct(a["to"].alias("s"), x["s"].alias("e"))))).otherwise(a["out"]).alias("out"))
    return F.aggregate(ends, F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<s:int,e:int>>").alias("out")), step, lambda a: a["out"])


def weighted_coverage(rows: DataFrame, key: list[str], coverage: str, weight: str) -> DataFrame:
    """coverage = sum(coverage * weight) / sum(weight), residual = 1 - coverage."""
    out = rows.groupBy(*key).agg((F.sum(F.col(coverage) * F.col(weight)) / F.sum(weight)).alias("coverage"))
    return out.withColumn("residual", 1 - F.col("coverage"))


def top_fragments(rows: DataFrame, k: int) -> DataFrame:
    """fragment, freq, total_len of the ``k`` most frequent (then longest in sum, then first) fragments."""
    return rows.groupBy("fragment").agg(F.count(F.lit(1)).alias("freq"), F.sum(F.char_length("fragment")).alias("total_len")).orderBy(F.desc("freq"), F.desc("total_len"), "fragment").limit(k)
