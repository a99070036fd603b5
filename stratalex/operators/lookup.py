"""Fuzzy lookup by edit ratio: 100 * 2 * (longest common subsequence) / (sum of lengths).

Two strings with that ratio share as many letters, counted with repeats. Ordered by one rule, the first few letters
of both then have one in common, so a join on those letters finds every pair; the ratio itself confirms it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    free = every = (1 << len(a)) - 1
    for c in b:
        hit = free & at.get(c, 0)
        free = ((free + hit) | (free - hit)) & every
    return len(a) - free.bit_count()


@F.pandas_udf(T.IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(x, y) for x, y in zip(a, b)], dtype="int32")


def _keys(text: Column, least: int) -> Column:
    """The letters, numbered by occurrence, one of which any string of that ratio has among its own."""
    size = F.char_length(text)
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    numbered = F.transform(letters, lambda c, i: F.struct(F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).alias("n"), c.alias("c")))
    shared = F.floor((size * least + 199 - least) / (200 - least)).cast("int")
    return F.slice(F.sort_array(numbered, asc=False), 1, size - shared + 1)


def fuzzy(needles: DataFrame, known: DataFrame, least: int = 70, most: int = 10) -> DataFrame:
    """needle, word, ratio, rank: for each ``needle`` the ``most`` known words of a ratio of ``least`` (1 to 100) or more; ties by word.

    Null and empty strings match nothing; repeated rows are one.
    """
    a = needles.select("needle").where("needle <> ''").distinct()
    b = known.select("word").where("word <> ''").distinct()
    keyed = lambda rows, c: rows.select(c, F.char_length(c).alias(f"{c}_n"), F.explode(_keys(F.col(c), least)).alias("key"))
    near = 200 * F.least("needle_n", "word_n") >= least * (F.col("needle_n") + F.col("word_n"))
    pairs = keyed(a, "needle").join(keyed(b, "word"), "key").where(near).select("needle", "word", "needle_n", "word_n").distinct()
    found = pairs.withColumn("common", _common("needle", "word")).withColumn("size", F.col("needle_n") + F.col("word_n"))
    found = found.where(200 * F.col("common") >= least * F.col("size")).withColumn("ratio", 200 * F.col("common") / F.col("size"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("needle").orderBy(F.desc("ratio"), "word")))
    return ranked.where(F.col("rank") <= most).select("needle", "word", "ratio", F.col("rank").cast("long").alias("rank"))
