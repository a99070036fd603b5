"""Collocations: how strongly neighbouring items attract each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import log_likelihood, pmi
from .tables import stored


def collocations(pairs: DataFrame, min_count: int = 2) -> DataFrame:
    """l, r, count_ab, count_a, count_b, pmi, llr, asymmetry of the pairs (l, r, n) of ``min_count`` and over.

    Marginals count a pair for both of its members, and the total is that of all pairs, so that the marginals'
    sum is twice the total.
    """
    counted = stored(pairs.groupBy("l", "r").agg(F.sum("n").alias("count_ab")).where(F.col("count_ab") >= min_count), "pairs", narrow=True)  # marginals, total and both joins read it
    marginal = counted.select(F.explode(F.array("l", "r")).alias("item"), "count_ab").groupBy("item").agg(F.sum("count_ab").alias("n"))
    total = counted.agg(F.sum("count_ab").alias("total"))  # one row
    side = lambda c: marginal.select(F.col("item").alias(c), F.col("n").alias(f"count_{'a' if c == 'l' else 'b'}"))
    out = counted.join(side("l"), "l").join(side("r"), "r").join(F.broadcast(total))
    ab, a, b, n = (F.col(c) for c in ("count_ab", "count_a", "count_b", "total"))
    return out.select("l", "r", "count_ab", "count_a", "count_b", pmi(ab, a, b, n).alias("pmi"), log_likelihood(ab, a, b, n).alias("llr"), (ab / a - ab / b).alias("asymmetry"))
