"""Intermediate tables in the folder that all executors share, and joins whose hot keys are dealt into parts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that no one has claimed by ``owned``.
_unowned: list[str] = []
_owner: list[list[str]] = []
#: Rows of one key that a task should meet in ``split_join``.
PART_ROWS = 4096
#: Estimated bytes of a table that one task writes at least.
TASK_BYTES = 32 << 20
#: How Parquet files of wide rows are written: row groups of 16 MB, sizes looked at after every few rows.
WIDE = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "16", "parquet.block.size.row.check.min": "4", "parquet.block.size.row.check.max": "16"}
#: Spark's setting by which a query's shuffles are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it then uses the machine's temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/stratalex-checkpoints"


def _tasks(df: DataFrame) -> int:
    """How many tasks write a table: one for each ``TASK_BYTES`` of its estimated size, and one for each core at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // TASK_BYTES), 2**31 - 1))


def stored(df: DataFrame, tag: str, narrow: bool = False, apart: bool = False, wide: bool = False, spent: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts its lineage, survives lost executors.

    No more tasks write it than its size asks for, so small tables don't become thousands of small files. A narrow table, whose rows are a few
    numbers, is written by an eighth of the shuffle's partitions at most, or by one task for each core if that is more. With ``apart`` its rows are shuffled to
    these tasks, so that what makes them, which is work, keeps its own partitions. A ``wide`` table has rows of hundreds of kilobytes: it keeps its partitions, and
    its pages and row groups are closed after a few rows, as writers and readers hold whole ones in memory. With ``spent`` the shuffles that made
    the table are deleted once it is written, and don't wait for the driver's garbage collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalex/{tag}-{uuid.uuid4().hex}"
    few, writer = _tasks(df), df.write
    if wide:
        few = None
    elif narrow:
        few = min(few, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    if few:
        writer = (df.repartition(few) if apart else df.coalesce(few)).write
    before = spark.conf.get(CLEANUP, None)
    if spent:
        spark.conf.set(CLEANUP, "true")
    try:
        writer.options(**WIDE if wide else {}).parquet(path)
    finally:
        if spent:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    (_owner[-1] if _owner else _unowned).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned(tables: list[str]) -> Iterator[list[str]]:
    """Paths of what ``stored`` writes inside go to ``tables``, whose owner drops them."""
    _owner.append(tables)
    try:
        yield tables
    finally:
        _owner.pop()


def drop(spark: SparkSession, tables: list[str]) -> None:
    """Delete tables that ``owned`` has listed; frames built on them end."""
    while tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all tables without an owner, those of queries run alone; to be called when their frames are done with."""
    drop(spark, _unowned)


def split_join(many: DataFrame, one: DataFrame, key: str, per: int = PART_ROWS, counted: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``many`` with ``one``, a row for each key, on ``key``.

    Rows of a key that has more than ``per`` of them are dealt into parts by a hash of their other columns, and its row of ``one``
    is copied for each part, so no task meets more of one key. ``counted`` has a row with ``key`` for each row of ``many``; ``counts``, if
    they are known, have (key, n).
    """
    if counts is None:
        counts = (many if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col(key).alias("__sx_hot"), F.col("n").alias("__sx_n"))
    hot = stored(counts.where(F.col("__sx_n") > per).select("__sx_hot", F.ceil(F.col("__sx_n") / per).cast("int").alias("__sx_parts")), "hot", narrow=True)
    others = [F.col(c) for c in many.columns if c != key]
    part: Column = F.coalesce(F.pmod(F.xxhash64(*others), F.col("__sx_parts")).cast("int"), F.lit(0))
    left = many.join(hot, F.col(key) == F.col("__sx_hot"), "left").select(*many.columns, part.alias("__sx_part"))
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__sx_parts"), F.lit(1)) - 1))
    right = one.join(hot, F.col(key) == F.col("__sx_hot"), "left").select(*one.columns, parts.alias("__sx_part"))
    return left.join(right.hint("merge"), [key, "__sx_part"]).drop("__sx_part")
