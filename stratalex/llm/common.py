"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import drop, owned, release, shared_dir, split_join, stored

#: Rows and bytes of an Arrow batch: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that Python workers stay small whatever a text's length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pieces(batch: pa.RecordBatch, text: int | str, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes in the column ``text``, one longer text at least, and ``rows`` rows at most."""
    lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
    first, held = 0, 0
    for k, n in enumerate(lengths):
        if k > first and (held + (n or 0) > size or k - first >= rows):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n or 0
    if first < len(lengths):
        yield batch.slice(first)


__all__ = ["BATCH_BYTES", "BATCH_ROWS", "drop", "owned", "pieces", "release", "shared_dir", "small_batches", "split_join", "stored", "table"]
