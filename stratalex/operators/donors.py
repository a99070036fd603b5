"""Donor resolution: known roots are taken out of a host, level by level, until the target is left.

A node is a string that still holds the target. Its candidates are the roots in it, taken out once or
everywhere, if the target survives in what is left. The best few go on to the next level, which is one join
for all nodes of all hosts. A string shrinks at each step, and a node's own path is kept beside it, so no
branch comes back to a state of its own while siblings stay free.

Defined results: hosts and targets are compared in lower case; null or empty ones end at once with a reason;
a host that is its own target has no rows; repeated rows are one; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_ngrams
from .residual import subtract
from .tables import stored

DEPTH, BRANCHES = 4, 3
#: The order in which sources are trusted; any other comes last.
SOURCES = ("dictionary", "sqlite")
TRACE = ("host", "target", "depth", "token", "donor", "source", "residual", "variant", "reason")


def _trust(source: Column) -> Column:
    out = F.lit(len(SOURCES))
    for k, name in reversed(list(enumerate(SOURCES))):
        out = F.when(source == name, k).otherwise(out)
    return out


def _steps(nodes: DataFrame, roots: DataFrame, longest: int, branches: int) -> DataFrame:
    """The steps that each node takes: donor, source, residual, variant."""
    parts = nodes.select("token").distinct().select("token", F.explode(F.array_distinct(F.transform(char_ngrams(F.col("token"), 1, longest), lambda x: x["gram"]))).alias("donor")).where("donor <> token")
    known = parts.join(roots, "donor")
    taken = subtract(known.select(F.col("token").alias("host"), F.col("donor").alias("root")))
    both = F.array(F.struct(F.lit("single_occurrence").alias("variant"), "residual", "nth"), F.struct(F.lit("remove_all_occurrences").alias("variant"), F.col("removed_all").alias("residual"), "nth"))
    several = F.max("nth").over(Window.partitionBy("host", "root")) > 0
    taken = taken.withColumn("both", F.when(several, both).otherwise(F.slice(both, 1, 1)))
    taken = taken.select(F.col("host").alias("token"), F.col("root").alias("donor"), F.explode("both").alias("x")).select("token", "donor", "x.variant", "x.residual", "x.nth")
    taken = taken.groupBy("token", "donor", "variant", "residual").agg(F.min("nth").alias("nth"))
    rows = nodes.join(taken.join(known, ["token", "donor"]), "token").where("residual <> '' and contains(residual, target)")
    node = Window.partitionBy("host", "target", "path")
    long = F.max(F.char_length("donor")).over(node)
    order = [F.when(F.col("residual") == F.col("target"), 0).otherwise(1), "trust", -F.char_length("donor"), "donor", F.char_length("residual"), "nth", F.desc("variant")]
    rows = rows.withColumn("long", long).where((F.col("long") < 2) | (F.char_length("donor") > 1))
    return rows.withColumn("rank", F.row_number().over(node.orderBy(*order))).where(F.col("rank") <= branches)


def resolve(hosts: DataFrame, roots: DataFrame, depth: int = DEPTH, branches: int = BRANCHES) -> DataFrame:
    """A row (``TRACE``) for each step of the ``hosts`` (host, target) through ``roots`` (donor, source), and for each dead end."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    known = roots.select(low("donor").alias("donor"), "source", _trust(F.col("source")).alias("trust")).where("donor <> ''")
    known = stored(known.groupBy("donor").agg(F.min_by("source", F.struct("trust", "source")).alias("source"), F.min("trust").alias("trust")), "roots")
    longest = known.agg(F.max(F.char_length("donor"))).first()[0] or 1
    nodes = hosts.select(low("host").alias("host"), low("target").alias("target")).distinct()
    nodes = nodes.select("host", "target", F.col("host").alias("token"), F.array().cast("array<string>").alias("path"))
    nothing, traces = F.lit(None).cast("string"), []
    for level in range(depth + 2):
        nodes = stored(nodes.where("token <> target or token = ''"), "nodes")
        ended = F.when(F.col("token") == "", "empty_token").when(F.col("target") == "", "empty_target").when(F.lit(level > depth), "max_depth_reached")
        nodes = nodes.withColumn("reason", ended)
        end = lambda rows: rows.select("host", "target", F.lit(level).alias("depth"), "token", nothing.alias("donor"), nothing.alias("source"), nothing.alias("residual"), nothing.alias("variant"), "reason")  # noqa: B023, E731
        traces.append(end(nodes.where("reason is not null")))
        if level > depth:
            break
        open_ = nodes.where("reason is null").drop("reason")
        steps = stored(_steps(open_, known, longest, branches), "steps")
        dead = open_.join(steps.select("host", "target", "path").distinct(), ["host", "target", "path"], "left_anti")
        traces.append(end(dead.withColumn("reason", F.lit("no_viable_donor"))))
        source = F.lit("host_subtraction") if level == 0 else F.col("source")
        reason = F.when(F.col("residual") == F.col("target"), "resolved").otherwise("residual_extracted")
        traces.append(steps.select("host", "target", F.lit(level).alias("depth"), "token", "donor", source.alias("source"), "residual", "variant", reason.alias("reason")))
        nodes = steps.where("residual <> target").select("host", "target", F.col("residual").alias("token"), F.concat("path", F.array(F.concat_ws(":", "token", "donor", "variant", "nth"))).alias("path"))
    return reduce(DataFrame.unionByName, traces).select(*TRACE)
