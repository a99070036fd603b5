"""Decisions between readings: evidence groups, contradictions, votes, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of evidence groups.
GROUPS = {"attachment": 0.35, "effect": 0.45, "exceptions": 0.25, "low": 0.65, "stable": 0.78, "stable_packets": 2, "stable_divergence": 0.25, "single": 0.85, "merge": 0.78, "strong_merge": 0.86}
#: Weights of the evidence that a decision adds to its base score.
DECISION = {"semantic": 0.22, "attestation": 0.14, "fnp": 0.08, "profile": 0.05, "singleton": -0.08, "grouped": 0.06}


def decision_score(weights: dict[str, float] = DECISION) -> Column:
    """``base`` and its weighted evidence; a null counts as none."""
    out = F.coalesce(F.col("base"), F.lit(0.0))
    for name, w in weights.items():
        out = out + F.lit(w) * F.coalesce(F.col(name), F.lit(0.0))
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets; 0 if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(F.lit(0.0))


def merge_verdict(similarity: Column, conflicts: Column) -> Column:
    """Whether a pair of evidence rows is one group: strong conflicts ask for more likeness."""
    return F.when(similarity < GROUPS["merge"], F.lit("apart")).when((F.size(conflicts) > 0) & (similarity < GROUPS["strong_merge"]), F.lit("rejected")).otherwise(F.lit("merged"))


def group_status(packets: Column, confidence: Column, exceptions: Column, risks: Column, consistency: Column, split: Column, mixed: Column, clean_single: Column) -> Column:
    """State of an evidence group of ``packets`` rows with these means and flags."""
    review = (exceptions >= GROUPS["exceptions"]) | (risks >= GROUPS["exceptions"]) | mixed | (confidence < GROUPS["low"])
    alone = F.when((confidence >= GROUPS["single"]) & clean_single, F.lit("stable"))
    many = F.when((packets >= GROUPS["stable_packets"]) & (confidence >= GROUPS["stable"]) & (consistency >= 1 - GROUPS["stable_divergence"]), F.lit("stable"))
    return F.when(split, F.lit("split_recommended")).when(review, F.lit("needs_review")).otherwise(F.coalesce(F.when(packets == 1, alone).otherwise(many), F.lit("provisional")))


def contradiction(text: Column, pairs: list[tuple[str, str]], each: float = 0.20, most: float = 0.50, compat_zero: bool = False) -> Column:
    """Penalty for pairs of words that both stand in ``text``, no letter or digit of any script beside them; ``compat_zero`` gives 0 for all."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda w: low.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_])\Q{w.lower()}\E(?:[^\p{{L}}\p{{N}}_]|$)")
    n = F.lit(0)
    for a, b in [] if compat_zero else pairs:
        n = n + (has(a) & has(b)).cast("int")
    return F.least(F.lit(most), n * F.lit(each))


def votes(rows: DataFrame, item: str) -> DataFrame:
    """item, label, votes: the label of most votes; on a tie one with a citation, then the one seen first.

    Takes (item, label, votes, cited, at).
    """
    sums = rows.where("label is not null").groupBy(item, "label").agg(F.sum("votes").alias("votes"), F.bool_or("cited").alias("cited"), F.min("at").alias("at"))
    best = F.max_by(F.struct("label", "votes"), F.struct("votes", "cited", -F.col("at")))
    return sums.groupBy(item).agg(best.alias("b")).select(item, "b.*")


def provenance(rows: DataFrame, item: str, order: list[str]) -> DataFrame:
    """item, source: the first of ``order`` that the item has."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("source"))
    return rows.select(item, "source", rank.alias("rank")).where("rank > 0").groupBy(item).agg(F.min_by("source", "rank").alias("source"))


def labelled_union(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str, str]) -> DataFrame:
    """key, source: where a key was found, ``names`` for both, left only, right only."""
    both = left.select(key).distinct().withColumn("l", F.lit(True)).join(right.select(key).distinct().withColumn("r", F.lit(True)), key, "full_outer")
    return both.select(key, F.when(F.col("l") & F.col("r"), F.lit(names[0])).when(F.col("l"), F.lit(names[1])).otherwise(F.lit(names[2])).alias("source"))


def distinct_groups(rows: DataFrame, group: str, member: str) -> DataFrame:
    """group, n: of groups with the same members the least; digests stand for the sorted members."""
    sets = rows.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("m")).select(group, F.sha2(F.to_json("m"), 256).alias("digest"), F.size("m").cast("long").alias("n"))
    return sets.groupBy("digest").agg(F.min(group).alias(group), F.first("n").alias("n")).select(group, "n")


def shared_prefixes(rows: DataFrame, group: str, text: str, size: int = 3) -> DataFrame:
    """prefix, groups: beginnings that several groups have."""
    own = rows.where(F.char_length(text) >= size).select(F.substring(text, 1, size).alias("prefix"), group)
    return own.groupBy("prefix").agg(F.countDistinct(group).alias("groups")).where("groups > 1")


def first_mode(rows: DataFrame, group: str, value: str, at: str) -> DataFrame:
    """group, value: the most frequent value, the one seen first on a tie."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("at"))
    return seen.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("at"))).alias(value))


def top_with_ties(rows: DataFrame, key: str, signature: str, score: str, k: int, gap: float = 0.05) -> DataFrame:
    """The ``k`` best rows of a key, one for each signature, with ``rank`` and whether the next one is near (``tie``)."""
    best = rows.groupBy(key, signature).agg(F.max(score).alias(score))
    w = Window.partitionBy(key).orderBy(F.desc(score), signature)
    ranked = best.withColumn("rank", F.row_number().over(w)).withColumn("below", F.lead(score).over(w)).where(F.col("rank") <= k)
    return ranked.select(key, signature, score, F.col("rank").cast("long").alias("rank"), F.coalesce(F.col(score) - F.col("below") < gap, F.lit(False)).alias("tie"))
