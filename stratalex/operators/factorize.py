"""Ridge factorization of token vectors into item vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items up to which the normal equations, items x items, are solved on the driver.
MOST_ITEMS = 4096


def ridge(counts: DataFrame, targets: DataFrame, alpha: float = 0.05) -> DataFrame:
    """item, vec: the vectors B with the least |X B - Y|^2 + alpha |B|^2, no intercept.

    counts: (token, item, n), X in long form; targets: (token, vec). X'X and X'Y are summed by Spark; only
    they, whose size is that of the item inventory, come to the driver.
    """
    items = [r[0] for r in counts.select("item").distinct().orderBy("item").limit(MOST_ITEMS + 1).collect()]
    if len(items) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items: keep the frequent ones")
    at = {x: k for k, x in enumerate(items)}
    x = counts.select("token", "item", F.col("n").cast("double").alias("n"))
    gram = x.join(x.select("token", F.col("item").alias("other"), F.col("n").alias("m")), "token").groupBy("item", "other").agg(F.sum(F.col("n") * F.col("m")).alias("v")).collect()
    places = targets.select("token", F.posexplode("vec").alias("i", "y"))
    right = x.join(places, "token").groupBy("item", "i").agg(F.sum(F.col("n") * F.col("y").cast("double")).alias("v")).collect()
    a, b = np.eye(len(items)) * alpha, np.zeros((len(items), 1 + max((r["i"] for r in right), default=0)))
    for r in gram:
        a[at[r["item"]], at[r["other"]]] += r["v"]
    for r in right:
        b[at[r["item"]], r["i"]] = r["v"]
    found = np.linalg.solve(a, b) if items else b
    return counts.sparkSession.createDataFrame([(k, [float(v) for v in row]) for k, row in zip(items, found)], f"item {counts.schema['item'].dataType.simpleString()}, vec array<double>")
