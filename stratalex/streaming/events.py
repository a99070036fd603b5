"""Event-time windows and a running lexicon over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of each tumbling window; the same code runs on a batch or a stream."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def running_lexicon(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The lexicon (token, conf, n) after a batch of (token, conf): conf = (old * n + sum) / (n + k)."""
    new = batch.groupBy("token").agg(F.sum("conf").alias("s"), F.count(F.lit(1)).alias("k"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return state.join(new, "token", "full_outer").select("token", ((zero("conf") * zero("n") + zero("s")) / (zero("n") + zero("k"))).alias("conf"), (zero("n") + zero("k")).alias("n"))
