"""Phrases: relations of neighbouring tokens, clause drafts and their composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, the first that fits wins: profiles and roles of the left and right token (None: any), relation, direction, score.
RELATIONS = (
    (("conjunction",), None, None, None, "coordination/apposition", "left_to_right", 0.9),
    (None, ("relative", "locative", "within_self", "feminine_locative_possessive"), None, None, "relational_attachment", "left_to_right", 1.3),
    (("imperative_existential",), None, None, None, "predicate-argument", "left_to_right", 1.4),
    (None, None, ("relational",), None, "relational_attachment", "left_to_right", 1.2),
    (None, None, None, ("relational",), "relational_attachment", "right_to_left", 1.2),
    (None, None, ("modifier",), ("noun", "verb"), "head-modifier", "left_to_right", 0.9),
    (None, None, ("verb",), ("noun", "unknown"), "predicate-argument", "left_to_right", 1.1),
    (None, None, ("noun", "unknown"), ("verb",), "predicate-argument", "right_to_left", 0.8),
    (None, None, ("noun",), ("noun",), "coordination/apposition", "left_to_right", 0.4),
    (None, None, None, None, "coordination/apposition", "left_to_right", 0.1),
)
#: Function words that aren't said twice in a row, and heads that swallow the next chunk's possessive.
SINGLE, POSSESSIVE_HEADS = ("and", "that", "in", "her"), ("her", "in her")


def relation(left_profile: Column, right_profile: Column, left_role: Column, right_role: Column, rules: tuple = RELATIONS) -> Column:
    """struct<relation, direction, score> between two neighbouring tokens."""
    fits = []
    for *allowed, kind, direction, score in rules:
        tests = [F.coalesce(c.isin(*a), F.lit(False)) for c, a in zip((left_profile, right_profile, left_role, right_role), allowed) if a]
        hit = F.lit(True)
        for t in tests:
            hit = hit & t
        fits.append(F.when(hit, F.struct(F.lit(kind).alias("relation"), F.lit(direction).alias("direction"), F.lit(score).alias("score"))))
    return F.coalesce(*fits)


def relations(tokens: DataFrame, phrase: str, at: str) -> DataFrame:
    """A row for each token (phrase, at, profile, role) but the phrase's last: its relation to the next one."""
    w = Window.partitionBy(phrase).orderBy(at)
    both = tokens.select(phrase, at, "profile", "role", F.lead("profile").over(w).alias("np"), F.lead("role").over(w).alias("nr"), F.lead(at).over(w).alias("next"))
    found = relation(F.col("profile"), F.col("np"), F.col("role"), F.col("nr"))
    return both.where("next is not null").select(phrase, at, "next", found.alias("r")).select(phrase, at, "next", "r.*")


def skeleton(chunks: Column) -> Column:
    """A clause draft of an array of chunks: empty ones go, and so do repeated function words and possessives."""

    def say(said: Column, chunk: Column) -> Column:
        last = F.coalesce(F.element_at(said, -1), F.lit(""))
        short = F.when(last.isin(*POSSESSIVE_HEADS) & chunk.startswith("her "), F.trim(F.substring(chunk, 5, 1 << 30))).otherwise(chunk)
        silent = F.coalesce(short == "", F.lit(True)) | ((short == last) & short.isin(*SINGLE))
        return F.when(silent, said).otherwise(F.concat(said, F.array(short)))

    said = F.aggregate(chunks, F.array().cast("array<string>"), lambda a, c: F.when(F.size(a) == 0, F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(a)).otherwise(say(a, c)))
    return F.array_join(said, " ")


def compose(clauses: DataFrame, phrase: str, at: str) -> DataFrame:
    """phrase, confidence (mean over its clauses), text (clauses in order, joined by ``; ``), n."""
    rows = clauses.groupBy(phrase).agg(F.avg("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct(at, "text"))).alias("parts"))
    return rows.select(phrase, "confidence", F.array_join(F.transform("parts", lambda p: p["text"]), "; ").alias("text"), F.size("parts").cast("long").alias("n"))
