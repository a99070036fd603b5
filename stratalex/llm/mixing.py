"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the words of all sources are shared by weight; a target stops at ``most`` times its source's own
words and the excess goes to the others by weight, until none is above. Each source is then taken in
complete epochs (floor(target / words) copies of every document) and a fractional one: documents get the
key -ln(u) / quality, an exponential variable, u drawn from a digest of the row, and are taken in the order of their
keys until the rest of the target is reached. The document that crosses it is taken if its middle lies
below it, so a source misses its target by half a document at most.

No source's rows are sorted in one place. Keys fall into bins of equal ratio, floor(log2(key) * ``COARSE``), each of which
holds less than a two-hundredth of the keys of rows of one quality, whatever that is; bins' sums are
prefix-summed per source, bins wholly below the rest are taken, and the one bin that crosses is cut into ``FINE`` times finer ones, of which the same
is done. Only the documents of the one fine bin that crosses, some hundred-thousandths of a source, are put in order.

Defined results: a null or empty text has size 0 and takes nothing; a very long text is one document like any other, taken whole or not; the null source is a
source, the last one; a null doc_id is a value like any other; documents of equal keys are put in order by doc_id, size and a hash of the columns kept, so only rows that agree in all of
them are interchangeable; a source without words takes nothing; further columns play no part unless they are named in ``keep``, and then get the prefix ``in_`` where their
names clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
#: Bins of keys for each doubling of the key, and finer bins of the one that crosses.
COARSE, FINE = 64, 256
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Quality weight: the share of letters among the characters that aren't white space, 0.1 at least."""
    bare = F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    rest = F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D\p{L}]+", ""))
    return F.greatest(F.lit(0.1), F.coalesce((bare - rest) / F.nullif(bare, F.lit(0)), F.lit(0.1)))


def draw(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    digest = F.md5(F.concat_ws("\x01", *parts))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target for a frame of (source, source_size), a row for each source.

    With sources in the order of cap / weight, source k is at its cap if the level of those from k on,
    (all - caps before k) / (weights from k on), is at least its own cap / weight. The level depends on all sources, so
    their rows, of two numbers each, are put in order in one task.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    levels = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level of the first source that isn't at its cap holds for all after it
    shared = levels.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("x")))).over(every)["x"])
    return shared.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _crossing(bins: DataFrame, goal: DataFrame) -> DataFrame:
    """m_source, cross, below: the first bin of each source whose end reaches what is left of the target, and the sizes before it.

    bins: source, bin, b_size; goal: m_source, rest (what is left of the target where these bins begin). No row where the bins don't reach it.
    """
    upto = F.sum("b_size").over(Window.partitionBy("source").orderBy("bin"))
    at = bins.withColumn("upto", upto).join(goal, F.col("source").eqNullSafe(F.col("m_source"))).where(F.col("upto") >= F.col("rest"))
    return at.groupBy("m_source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("b_size")).alias("below"))).alias("x")).select("m_source", F.col("x.bin").alias("cross"), F.col("x.below").alias("below"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = 3, quality=letter_share, seed: int = 0, coarse: int = COARSE, fine: int = FINE, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``, and the columns in ``keep``."""
    size, text = F.col("__sx_size"), F.coalesce(F.col("text"), F.lit(""))
    u = draw(F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("source"), F.md5(text))
    rows = (
        docs.withColumn("__sx_size", n_words(F.col("text")))
        .withColumn("__sx_key", -F.log(u) / quality(text))
        .select("doc_id", "source", "__sx_size", "__sx_key", *[F.col(c).alias(f"__sx_col_{c}") for c in keep or []])
        .withColumn("__sx_fine", F.floor(F.log2("__sx_key") * (coarse * fine)))
    )
    rows = stored(rows, "mixing")  # texts are read and counted once
    bin_of = F.floor(F.col("__sx_fine") / fine)
    per_bin = stored(rows.groupBy("source", bin_of.alias("bin")).agg(F.sum(size).alias("b_size")), "bins", narrow=True)
    goal = targets(per_bin.groupBy("source").agg(F.sum("b_size").alias("source_size")), weights, most).withColumnRenamed("source", "m_source")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = stored(goal, "goal", narrow=True)
    first = stored(_crossing(per_bin, goal).withColumnRenamed("m_source", "source"), "first", narrow=True)
    # the one bin that crosses, in finer bins; what lies before it is taken off the rest
    inner = rows.withColumn("bin", bin_of).join(first.select(F.col("source").alias("f_source"), F.col("cross")), F.col("source").eqNullSafe(F.col("f_source")) & (F.col("bin") == F.col("cross")))
    inner = inner.groupBy("source", F.col("__sx_fine").alias("bin")).agg(F.sum(size).alias("b_size"))
    rest = goal.join(first, F.col("m_source").eqNullSafe(F.col("source"))).select("m_source", (F.col("rest") - F.col("below")).alias("rest"))
    second = _crossing(inner, rest).select(F.col("m_source").alias("s_source"), F.col("cross").alias("__sx_cross"), F.col("below").alias("more"))
    crossed = first.join(second, F.col("source").eqNullSafe(F.col("s_source"))).select("source", "__sx_cross", (F.col("below") + F.col("more")).alias("below"))
    plan = goal.join(crossed, F.col("m_source").eqNullSafe(F.col("source")), "left").select("m_source", "source_size", "target", "epochs", "rest", "__sx_cross", "below")
    at = rows.join(stored(plan, "plan", narrow=True), F.col("source").eqNullSafe(F.col("m_source"))).drop("m_source")
    # a source without a crossing bin takes everything once more: its rest lies beyond its last bin by a rounding error at most
    decided = at.where(F.coalesce(F.col("__sx_fine") != F.col("__sx_cross"), F.lit(True))).withColumn("taken", size * (F.col("epochs") + F.coalesce(F.col("__sx_fine") < F.col("__sx_cross"), F.lit(True)).cast("long")))
    ordered = Window.partitionBy("source").orderBy("__sx_key", "doc_id", size, *([F.xxhash64(*[F.col(f"__sx_col_{c}") for c in keep])] if keep else []))
    start = F.col("below") + F.sum(size).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - size
    opened = at.where(F.col("__sx_fine") == F.col("__sx_cross")).withColumn("taken", size * (F.col("epochs") + (start + size / 2 <= F.col("rest")).cast("long")))
    out = decided.unionByName(opened)
    return out.select("doc_id", size.alias("size"), "source_size", "target", "taken", *[F.col(f"__sx_col_{c}").alias(c if c not in ("doc_id", "size", "source_size", "target", "taken") else f"in_{c}") for c in keep or []])
