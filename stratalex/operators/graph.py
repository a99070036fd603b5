"""Connected components by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def connect(links: DataFrame) -> DataFrame:
    """node, component (its least reachable node) of every node in ``links`` (a, b).

    Labels spread along links and then jump to their own label's label, so long chains shrink by halves; every round is written
    to the shared folder. Rows are two or three numbers; a hub's rows that still outgrow a task are split by the adaptive skew join.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links", narrow=True)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", narrow=True)
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        near = labels.join(spread, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        of = near.select(F.col("node").alias("to"), F.col("component").alias("far"))
        new = stored(near.join(of, F.col("component") == F.col("to")).select("node", "old", F.least("component", "far").alias("component")), "labels", narrow=True)
        labels = new.select("node", "component")
        if new.where("old <> component").limit(1).count() == 0:
            return labels
