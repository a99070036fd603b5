"""A word's translations: what a dictionary has for the whole word, and the covers of the word by the dictionary's pieces, scored and put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import glosses as G
from ..functions.stats import ambiguity, specificity
from . import composition, enrichment, scoring
from .segment import attested_covers


def translations(words: DataFrame, senses: DataFrame, strategy: str = "prefer-balance", whole_words: bool = True, top: int = 5) -> DataFrame:
    """word, rank, analysis, pieces, reading, score: the ``top`` translations of each word, the best first (the feature's own limit).

    words: word; senses: normalized, sense_id, definition, a row for each sense of a dictionary's entry. A cover's score is made of its coverage, which is
    complete, of how specific its pieces are and how many senses they have, weighted by their lengths, of the strategy's bonus and of a penalty for pieces that
    name a number; a reading joins each piece's first plain definition. Without ``whole_words`` a word isn't its own piece. Words are compared in capitals; repeated
    words are one; a word that nothing covers has no row.
    """
    own = words.select(F.upper(F.trim("word")).alias("word")).where("word <> ''").distinct()
    named = senses.where("trim(coalesce(definition, '')) <> ''").select(F.upper(F.trim("normalized")).alias("piece"), "sense_id", "definition")
    plain = F.struct(G.is_placeholder(F.col("definition")) | G.is_meta(F.col("definition")), F.col("sense_id"), F.col("definition"))
    pieces = named.groupBy("piece").agg(F.count(F.lit(1)).alias("senses"), F.min(plain)["definition"].alias("definition"), F.max(G.digit_count(F.col("definition"))).alias("digits"))
    covers = attested_covers(own, pieces).select("word", F.col("rank").alias("cover"), F.col("pieces").alias("morphs"))
    if not whole_words:
        covers = covers.where(F.size("morphs") > 1)
    parts = covers.select("word", "cover", F.posexplode("morphs").alias("at", "piece")).join(pieces, "piece")
    size = F.char_length("piece")
    gathered = parts.groupBy("word", "cover").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece", "definition", "senses", "digits"))).alias("p"),
        (F.sum(specificity(F.col("senses")) * size) / F.sum(size)).alias("specificity"), (F.sum(ambiguity(F.col("senses")) * size) / F.sum(size)).alias("ambiguity"),
    )
    weights = {k: scoring.WEIGHTS[k] for k in ("coverage", "specificity", "ambiguity")}
    morphs = F.transform("p", lambda x: x["piece"])
    bonus = composition.strategy_bonus(F.lit(strategy), morphs, F.transform("p", lambda x: x["senses"]))
    score = scoring.weighted(weights) + bonus - composition.numeric_penalty(F.col("word"), morphs, F.transform("p", lambda x: x["digits"]))
    rows = gathered.withColumn("coverage", F.lit(1.0)).select("word", F.lit("cover").alias("analysis"), F.array_join(morphs, "+").alias("pieces"), F.array_join(F.transform("p", lambda x: x["definition"]), "; ").alias("reading"), score.alias("score"))
    whole = pieces.select(F.col("piece").alias("word"), F.lit("dictionary").alias("kind"), "definition", F.lit(0.0).alias("quality")).join(own, "word")
    exact = enrichment.exact_candidates(whole, whole_words).where("not suppressed").select("word", "analysis", F.col("word").alias("pieces"), F.col("definition").alias("reading"), "score")
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc(F.round("score", 9)), F.size(F.split("pieces", r"\+")), "pieces", "analysis"))
    return rows.unionByName(exact).withColumn("rank", place).where(F.col("rank") <= top).select("word", "rank", "analysis", "pieces", "reading", F.round("score", 6).alias("score"))
