"""Groups of evidence: conflicts between two rows of it, and which group a part of a word belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decision import GROUPS, jaccard

#: Weights of an alignment and what a group's state takes off it.
ALIGNMENT = {"cluster": 0.45, "word": 0.25, "attachment": 0.15, "overlap": 0.10, "rank": 0.05}
PENALTIES = {"needs_review": 0.08, "split_recommended": 0.12, "provisional": 0.02}
AXES = ("prefix", "suffix", "free")


def dominant_axis(of: Column) -> Column:
    """struct<axis, value>: the likeliest attachment of a struct, or the most observed one as a share; null if it has neither. The first axis wins a tie."""
    total = sum((F.coalesce(of[f"observed_{a}"], F.lit(0)) for a in AXES), F.lit(0))
    share = {a: F.when(total > 0, F.coalesce(of[f"observed_{a}"], F.lit(0)) / total) for a in AXES}
    likely = F.coalesce(*[of[a] for a in AXES]).isNotNull()
    best = lambda v: F.filter(F.array(*[F.struct(F.lit(a).alias("axis"), v[a].alias("value")) for a in AXES]), lambda x: x["value"] == F.greatest(*[v[a] for a in AXES]))
    return F.get(F.when(likely, best({a: of[a] for a in AXES})).otherwise(best(share)), F.lit(0))


def divergence(left: Column, right: Column) -> Column:
    """How far two attachments are apart: the difference of their dominant values if their axes differ, else 0."""
    a, b = dominant_axis(left), dominant_axis(right)
    return F.coalesce(F.when(a["axis"] != b["axis"], F.abs(a["value"] - b["value"])), F.lit(0.0))


def conflicts(left: Column, right: Column) -> Column:
    """Sorted names of the conflicts between two rows: structs of attachment, positive, contrast, effects (the terms of each), roles (arrays; null: empty).

    Effects diverge if their mean likeness is low and the rows have no positive term in common.
    """
    has = lambda s, f, kind="array<string>": F.coalesce(s[f], F.array().cast(kind))
    apart = divergence(left["attachment"], right["attachment"]) >= GROUPS["attachment"]
    against = F.arrays_overlap(has(left, "positive"), has(right, "contrast")) | F.arrays_overlap(has(right, "positive"), has(left, "contrast"))
    a, b = (has(s, "effects", "array<array<string>>") for s in (left, right))
    alike = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: jaccard(x, y))))
    mean = F.aggregate(alike, F.lit(0.0), lambda total, x: total + x) / F.nullif(F.size(alike), F.lit(0))
    effects = (mean < GROUPS["effect"]) & ~F.arrays_overlap(has(left, "positive"), has(right, "positive"))
    a, b = has(left, "roles"), has(right, "roles")
    roles = F.array_union(a, b)
    mixed = (F.size(a) > 0) & (F.size(b) > 0) & F.array_contains(roles, "prefix") & F.array_contains(roles, "suffix")
    flags = (("attachment_divergence", apart), ("effect_domain_divergence", effects), ("mixed_role_evidence", mixed), ("negative_contrast_conflict", against))
    return F.array_compact(F.array(*[F.when(F.coalesce(f, F.lit(False)), F.lit(n)) for n, f in flags]))


def attachment_match(profile: Column, role: Column) -> Column:
    """How well a role suits a group's attachment: its likelihood, else its observed share, else 0."""
    axes = (*AXES, "infix")
    total = sum((F.coalesce(profile[f"observed_{a}"], F.lit(0)) for a in axes), F.lit(0))
    out = F.lit(0.0)
    for a in axes:
        seen = F.when(total > 0, F.coalesce(profile[f"observed_{a}"], F.lit(0)) / total)
        out = F.when(F.lower(F.trim(role)) == a, F.coalesce(F.when(profile[a].isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), profile[a]))), seen, F.lit(0.0))).otherwise(out)
    return out


def align(parts: DataFrame, groups: DataFrame, item: str, alternates: int = 2) -> DataFrame:
    """item, group_id, score, rank: the group that each part of a word belongs to, and its ``alternates``; ties by label, then id.

    ``parts``: item, morph, role, clusters, word, terms. ``groups``: morph, group_id, label, clusters, words, examples, attachment,
    terms, rank_score, status. Null counts as nothing; a part without groups has no row. A group that nothing speaks for scores 0.
    """
    g = groups.select("morph", "group_id", "label", F.struct(*[c for c in groups.columns if c not in ("morph", "group_id", "label")]).alias("g"))
    both = parts.join(g, "morph")
    word, none = F.nullif(F.upper(F.trim("word")), F.lit("")), F.array().cast("array<string>")
    named = F.exists(F.coalesce("g.words", none), lambda w: F.upper(F.trim(w)) == word) | F.exists(F.coalesce("g.examples", none), lambda e: F.contains(F.upper(e), word))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    terms = F.coalesce("terms", none)
    worth = {
        "cluster": yes(F.arrays_overlap("clusters", "g.clusters")), "word": yes(named), "attachment": attachment_match(F.col("g.attachment"), F.col("role")),
        "overlap": F.when(F.size(terms) > 0, jaccard(terms, F.coalesce("g.terms", none))).otherwise(0.0), "rank": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("g.rank_score", F.lit(0.0)))),
    }
    score = sum((F.lit(ALIGNMENT[k]) * v for k, v in worth.items()), F.lit(0.0))
    for status, less in PENALTIES.items():
        score = score - F.when(F.col("g.status") == status, less).otherwise(0.0)
    rows = both.select(item, "group_id", "label", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("score"))
    w = Window.partitionBy(item).orderBy(F.desc("score"), F.coalesce("label", F.lit("")), "group_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= 1 + alternates).drop("label")


def role_profile(rows: DataFrame, key: str, role: str) -> DataFrame:
    """key, counts (role, n of every role, by name), profile: the role that a key has most often, or mixed."""
    each = rows.groupBy(key, F.col(role).alias("role")).agg(F.count(F.lit(1)).alias("n"))
    out = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("role", "n"))).alias("counts"), F.max("n").alias("most"))
    top = F.filter("counts", lambda x: x["n"] == F.col("most"))
    return out.select(key, "counts", F.when(F.size(top) == 1, F.get(top, F.lit(0))["role"]).otherwise("mixed").alias("profile"))
