"""Merge semantics over immutable tables: every function returns the table's new content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``source`` replace those of ``target`` with their key."""
    return target.join(source.select(*key), key, "left_anti").unionByName(source, allowMissingColumns=True)


def insert_or_ignore(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    return target.unionByName(source.join(target.select(*key), key, "left_anti"), allowMissingColumns=True)


def coalesce_upsert(target: DataFrame, source: DataFrame, key: list[str], replace: tuple = ()) -> DataFrame:
    """New values where they aren't null, the old ones elsewhere; columns in ``replace`` always take the new row's."""
    t, s = target.withColumn("__in_t", F.lit(True)).alias("t"), source.withColumn("__in_s", F.lit(True)).alias("s")
    both = t.join(s, key, "full_outer")
    value = lambda c: F.when(F.col("__in_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")) if c in replace else F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}"))
    return both.select(*key, *[value(c).alias(c) for c in target.columns if c not in key])


def increment(target: DataFrame, source: DataFrame, key: str, count: str) -> DataFrame:
    """Adds 1 to ``count`` for each row of ``source``; new keys begin at that."""
    more = source.groupBy(key).agg(F.count(F.lit(1)).alias("__more"))
    return target.join(more, key, "full_outer").select(key, (F.coalesce(F.col(count), F.lit(0)) + F.coalesce(F.col("__more"), F.lit(0))).alias(count))


def newest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the first in ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def replace_partition(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Delete, then insert: all of a key's rows go if ``source`` has the key."""
    return target.join(source.select(*key).distinct(), key, "left_anti").unionByName(source, allowMissingColumns=True)


def common_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """Copy between tables of different shape: the columns that both have."""
    return source.select(*[c for c in target.columns if c in source.columns])


def replace_table(rows: DataFrame, path: str) -> None:
    """Put ``rows`` in the place of a table of files: written beside it first, then swapped, so readers meet the old table or the new one, and a failed write leaves the old."""
    import uuid

    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(new)
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(at)
    if there and not fs.rename(at, hadoop.Path(old)):
        raise OSError(f"can't move {path}")
    if not fs.rename(hadoop.Path(new), at):
        if there:
            fs.rename(hadoop.Path(old), at)
        raise OSError(f"can't put the new table at {path}")
    if there:
        fs.delete(hadoop.Path(old), True)


def memoised(prompts: DataFrame, memo: DataFrame, key: str = "prompt_hash") -> DataFrame:
    """Prompts beside the answer that the memo has for their key, and whether it has one; a key answered twice counts by its first answer."""
    known = newest(memo, [key], [F.col("created_at"), F.col("response")]).select(key, "response")
    return prompts.join(known, key, "left").withColumn("known", F.col("response").isNotNull())
