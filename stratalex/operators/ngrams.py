"""Character and token n-gram statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pmi, smoothed
from ..functions.text import char_ngrams


def index(types: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """gram, tf (instances), df (distinct types) of types (word, n); grams are made once for each type."""
    grams = types.select("word", "n", F.explode(char_ngrams(F.col("word"), least, most)).alias("g"))
    # occurrences within a type are summed before they are shuffled
    per = grams.groupBy("word", F.col("g.gram").alias("gram")).agg(F.sum("n").alias("tf"))
    return per.groupBy("gram").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def membership(types: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """gram, word, starts of the gram in the word."""
    return types.select("word", F.explode(char_ngrams(F.col("word"), least, most)).alias("g")).groupBy(F.col("g.gram").alias("gram"), "word").agg(F.array_sort(F.collect_list("g.start")).alias("starts"))


def neighbour_entropy(pairs: DataFrame, item: str) -> DataFrame:
    """Shannon entropy in bits of what stands beside ``item`` (l or r) in pairs (l, r, n)."""
    total = Window.partitionBy(item)
    p = F.col("n") / F.sum("n").over(total)
    return pairs.withColumn("p", p).groupBy(item).agg(F.sum("n").alias("freq"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def positions(sequences: DataFrame, items: str) -> DataFrame:
    """item, initial, medial, final: a lone item counts as both initial and final."""
    rows = sequences.select(F.size(items).alias("size"), F.posexplode(items).alias("i", "item"))
    first, last = F.col("i") == 0, F.col("i") == F.col("size") - 1
    return rows.groupBy("item").agg(F.count_if(first).alias("initial"), F.count_if(~first & ~last).alias("medial"), F.count_if(last).alias("final"))


def adjacency(pairs: DataFrame, items: DataFrame, min_count: int = 1) -> DataFrame:
    """l, r, n, p (smoothed, of r after l) and pmi from pairs (l, r, n) and item counts (item, freq)."""
    sums = items.agg(F.sum("freq").alias("m"), F.count(F.lit(1)).alias("v"))
    left = Window.partitionBy("l")
    out = pairs.withColumn("after", F.sum("n").over(left)).where(F.col("n") >= min_count)
    out = out.join(items.select(F.col("item").alias("l"), F.col("freq").alias("fl")), "l").join(items.select(F.col("item").alias("r"), F.col("freq").alias("fr")), "r").join(F.broadcast(sums))
    return out.select("l", "r", "n", smoothed(F.col("n"), F.col("after"), F.col("v")).alias("p"), pmi(F.col("n"), F.col("fl"), F.col("fr"), F.col("m")).alias("pmi"))


def js_divergence(dist: DataFrame, left: DataFrame, eps: float = 1e-12) -> DataFrame:
    """a, b, divergence in bits of the distributions (key, item, p) for the pairs (a, b) in ``left``."""
    items = left.join(dist.select(F.col("key").alias("a"), "item"), "a").select("a", "b", "item").union(left.join(dist.select(F.col("key").alias("b"), "item"), "b").select("a", "b", "item")).distinct()
    of = lambda k, p: dist.select(F.col("key").alias(k), "item", F.col("p").alias(p))
    both = items.join(of("a", "pa"), ["a", "item"], "left").join(of("b", "pb"), ["b", "item"], "left").fillna(0.0, ["pa", "pb"])
    m = (F.col("pa") + F.col("pb")) / 2
    kl = lambda p: F.when(p > 0, p * F.log2((p + eps) / (m + eps))).otherwise(F.lit(0.0))
    return both.groupBy("a", "b").agg((F.sum(kl(F.col("pa"))) / 2 + F.sum(kl(F.col("pb"))) / 2).alias("divergence"))
