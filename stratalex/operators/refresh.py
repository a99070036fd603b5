"""Residual refresh: coverage after a root is taken out, choice of breakdowns, summaries and guidance for what stays unexplained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .residual import covered, gaps

#: Words of a guidance block, and fragments of it: the report's own limits.
WORDS, FRAGMENTS = 10, 6


def _held(segments: Column, size: Column) -> Column:
    """Spans (s, e) of segments, held inside the word; empty ones are left out."""
    inside = F.transform(segments, lambda x: F.struct(F.greatest(F.lit(0), F.least(x["s"], size)).cast("int").alias("s"), F.greatest(F.lit(0), F.least(x["e"], size)).cast("int").alias("e")))
    return F.filter(inside, lambda x: x["s"] < x["e"])


def breakdown(target: Column, segments: Column) -> Column:
    """struct(coverage, residual, uncovered) of a word with segments (s, e, canonical); spans that overlap or touch count once."""
    size = F.char_length(target)
    spans = _held(segments, size)
    share = F.when(size > 0, covered(size, spans) / size).otherwise(0.0)
    return F.struct(share.alias("coverage"), F.greatest(F.lit(0.0), 1 - share).alias("residual"), F.transform(gaps(size, spans), lambda g: F.substring(target, g["s"] + 1, g["e"] - g["s"])).alias("uncovered"))


def without_root(segments: Column, root: Column) -> Column:
    return F.filter(segments, lambda x: F.lower(x["canonical"]) != F.lower(root))


def refreshed(target: Column, root: Column, segments: Column) -> Column:
    """The breakdown once more for the root's analysis.

    The root's own segments are taken out. Where the rest still covers all of a word that begins with the root, the word's match with itself goes too,
    and the root's place counts as explained, so that what follows it shows.
    """
    rest = without_root(segments, root)
    full = covered(F.char_length(target), _held(rest, F.char_length(target))) >= F.char_length(target)
    prefix = F.lower(target).startswith(F.lower(root)) & (F.char_length(root) > 0)
    others = F.filter(rest, lambda x: F.lower(x["canonical"]) != F.lower(target))
    place = F.array(F.struct(F.lit(0).alias("s"), F.char_length(root).alias("e"), root.alias("canonical")))
    return F.when(full & prefix & (F.char_length(target) > 0), breakdown(target, F.concat(place, others))).otherwise(breakdown(target, rest))


def is_self_composite(target: Column, segments: Column) -> Column:
    """Whether a word's only segment is the word itself."""
    return (F.size(segments) == 1) & (F.lower(F.get(segments, F.lit(0))["canonical"]) == F.lower(target))


def preferred(rows: DataFrame, word: str = "word", segments: str = "segments", score: str = "score") -> DataFrame:
    """One breakdown for each word: of several segments rather than of one, then by score; words that only match themselves are dropped."""
    place = F.row_number().over(Window.partitionBy(word).orderBy((F.size(segments) > 1).desc(), F.desc(score), F.size(segments)))
    best = rows.withColumn("__n", place).where("__n = 1").drop("__n")
    return best.where(~is_self_composite(F.col(word), F.col(segments)))


def summary(rows: DataFrame) -> DataFrame:
    """root, n_words, avg_len, avg_coverage, avg_residual, headline: of the words of each root; rows: root, word, coverage, residual, confidence, uncovered."""
    size = F.char_length("word")
    worst = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("residual")).alias("r"), F.coalesce("confidence", F.lit(0.0)).alias("c"), "word"))), 1, 3)
    out = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n_words"), F.avg(size).alias("avg_len"), (F.sum(F.col("coverage") * size) / F.sum(size)).alias("avg_coverage"), worst.alias("worst"))
    headline = F.array_join(F.transform("worst", lambda x: F.concat(x["word"], F.lit(":"), F.format_number(-x["r"], 2))), ", ")
    return out.select("root", "n_words", "avg_len", "avg_coverage", F.greatest(F.lit(0.0), 1 - F.col("avg_coverage")).alias("avg_residual"), headline.alias("headline"))


def guidance(rows: DataFrame, words: int = WORDS, fragments: int = FRAGMENTS) -> DataFrame:
    """root, top_fragments, hot_words: what a reader should look at first; rows as of ``summary``."""
    parts = rows.select("root", F.explode("uncovered").alias("f")).groupBy("root", F.upper("f").alias("f")).agg(F.count(F.lit(1)).alias("freq"), F.sum(F.char_length("f")).alias("total"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("freq"), F.desc("total"), "f"))
    top = parts.withColumn("n", rank).where(F.col("n") <= fragments).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("n", "f", "freq"))).alias("t"))
    top = top.select("root", F.array_join(F.transform("t", lambda x: F.concat(x["f"], F.lit("x"), x["freq"].cast("string"))), ",").alias("top_fragments"))
    worst = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("residual"), F.coalesce("confidence", F.lit(0.0)), "word"))
    hot = rows.withColumn("n", worst).where(F.col("n") <= words).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    hot = hot.select("root", F.array_join(F.transform("w", lambda x: F.upper(x["word"])), ",").alias("hot_words"))
    return hot.join(top, "root", "left").select("root", F.coalesce("top_fragments", F.lit("")).alias("top_fragments"), "hot_words")


def equation(host: Column, roots: Column, residual: Column) -> Column:
    """HOST - ROOT - ROOT = RESIDUAL, in capitals."""
    return F.upper(F.concat(host, F.lit(" - "), F.array_join(roots, " - "), F.lit(" = "), F.when(F.coalesce(residual, F.lit("")) == "", "(nothing)").otherwise(residual)))


def decomposed(words: DataFrame, best: DataFrame, least: int = 2) -> DataFrame:
    """token, seg_index, morph, span_start, span_end: the best segmentation of each word, or the word as a whole; pieces under ``least`` letters are left out.

    best: word, segments; a word without a row, or whose pieces are all too short, stands whole.
    """
    parts = F.col("segments")
    spans = F.transform(parts, lambda m, i: F.struct(m.alias("morph"), F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.char_length(x)).alias("s")))
    kept = F.filter(spans, lambda x: F.char_length(x["morph"]) >= least)
    whole = F.array(F.struct(F.col("word").alias("morph"), F.lit(0).alias("s")))
    rows = words.join(best, "word", "left").select(F.col("word").alias("token"), F.posexplode(F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(whole)).alias("seg_index", "x"))
    return rows.select("token", "seg_index", F.col("x.morph").alias("morph"), F.col("x.s").alias("span_start"), (F.col("x.s") + F.char_length("x.morph")).alias("span_end"))


def composites(tokens: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """token, morphs, vec: the mean vector of a token's morphs, neighbours that repeat taken once; a token that is its own only morph is left out.

    tokens: token, morphs; vectors: morph, vec (``size`` long). Morphs without a vector don't count; a token without any has null.
    """
    from ..functions.text import collapse_repeats

    own = tokens.select("token", collapse_repeats(F.col("morphs")).alias("morphs")).where(~((F.size("morphs") == 1) & (F.lower(F.get("morphs", F.lit(0))) == F.lower("token"))))
    rows = own.select("token", F.explode("morphs").alias("morph")).join(vectors, "morph")
    mean = rows.groupBy("token").agg(*[F.avg(F.get("vec", F.lit(k))).alias(f"x{k}") for k in range(size)]).select("token", F.array(*[f"x{k}" for k in range(size)]).alias("vec"))
    return own.join(mean, "token", "left")
