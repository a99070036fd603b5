"""Scores of a word's decompositions and of the definitions put together for it.

Morphs are arrays of strings, vectors arrays of doubles; functions are expressions over columns, or take whole tables, so a table of decompositions is scored
without leaving the JVM. Constants are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp
from ..functions.vectors import cosine, dot, norm



def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(0.0))


def _pairs(items: Column, value) -> Column:
    """``value`` of each pair of an array's items, in order."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: value(a, b))))


def reconstruction_error(actual: Column, predicted: Column, metric: str = "cosine") -> Column:
    """1 - cosine held between -1 and 1 (1 without a direction), or the mean squared difference."""
    if metric == "cosine":
        size = norm(actual) * norm(predicted)
        return F.when(size == 0, 1.0).otherwise(1 - clamp(dot(actual, predicted) / (size + 1e-9), -1.0, 1.0))
    return _mean(F.zip_with(actual, predicted, lambda x, y: (x - y) * (x - y)))


def mean_vector(vectors: Column, size: int) -> Column:
    """Place by place; zeros for no vector."""
    n = F.greatest(F.size(vectors), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(vectors, F.lit(0.0), lambda a, v: a + F.get(v, k)) / n)


def parse_score(tfidf: Column, target: Column, path: Column, confidences: Column, lengths: Column, size: int) -> Column:
    """0.5 sum of tf-idf + 0.3 cosine of the mean vectors + 0.2 confidence weighted by length, 1 at least."""
    weights = F.transform(lengths, lambda n: F.greatest(F.lit(1.0), n.cast("double")))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.zip_with(confidences, weights, lambda c, w: c * w), F.lit(0.0), lambda a, x: a + x)
    like = cosine(mean_vector(target, size), mean_vector(path, size), 1e-9)
    return 0.5 * F.aggregate(tfidf, F.lit(0.0), lambda a, x: a + x) + 0.3 * like + 0.2 * F.when(total > 0, weighted / total).otherwise(0.0)


def multi_segment_bonus(canonicals: Column, coverage: Column, residual: Column, bonus: float = 0.25) -> Column:
    """For complete covers of two segments or more: bonus * share of different canonicals / segments."""
    named = F.filter(F.transform(canonicals, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    novelty = F.size(F.array_distinct(named)) / F.size(named)
    return F.when((F.size(canonicals) >= 2) & (coverage >= 0.999) & (residual <= 0.001) & (F.size(named) > 0), bonus * novelty / F.size(canonicals)).otherwise(0.0)


def size_penalty(sizes: Column, least: int = 3, most: int = 35, low: float = 6.0, high: float = 18.0) -> Column:
    """Of clusters with these sizes: too few or many, an average out of bounds, and dispersion; null for none."""
    n = F.size(sizes)
    average = _mean(F.transform(sizes, lambda x: x.cast("double")))
    spread = F.sqrt(_mean(F.transform(sizes, lambda x: (x - average) * (x - average))))
    count = F.when(n < least, (least - n) / least).when(n > most, (n - most) / most).otherwise(0.0)
    mean = F.when(average < low, (low - average) / low).when(average > high, (average - high) / high).otherwise(0.0)
    return F.when(n > 0, count + 1.3 * mean + 0.4 * F.when(average > 0, spread / average).otherwise(spread))


def lengths(morphs: Column) -> Column:
    return F.transform(morphs, lambda m: F.char_length(F.coalesce(m, F.lit(""))))


def length_variance(morphs: Column) -> Column:
    n = lengths(morphs)
    mean = _mean(F.transform(n, lambda x: x.cast("double")))
    return F.when(F.size(morphs) > 1, _mean(F.transform(n, lambda x: (x - mean) * (x - mean)))).otherwise(0.0)


def strategy_bonus(strategy: Column, morphs: Column, supports: Column) -> Column:
    """What a strategy adds: fewer pieces, pieces of more than 5 supports, or balanced pieces; 0 for an unknown strategy."""
    n = lengths(morphs)
    total = F.aggregate(n, F.lit(0), lambda a, x: a + x)
    square = F.aggregate(n, F.lit(0), lambda a, x: a + x * x)
    key = F.lower(F.trim(F.coalesce(strategy, F.lit(""))))
    balance = 0.5 * F.when(total > 0, square / (total * total)).otherwise(0.0) - 0.2 * length_variance(morphs)
    return F.when(key == "prefer-fewer", -0.5 * F.size(morphs)).when(key == "prefer-known", 0.3 * F.size(F.filter(supports, lambda x: x > 5))).when(key == "prefer-balance", balance).otherwise(0.0)


def numeric_penalty(word: Column, morphs: Column, digits: Column, each: float = 4.0) -> Column:
    """For each piece of two letters or more whose definition names a number of ``digits`` (null: none); a whole word of as many letters is free."""
    pieces = F.arrays_zip(morphs.alias("m"), digits.alias("d"))
    whole = lambda x: (F.size(morphs) == 1) & (F.upper(x["m"]) == F.upper(word)) & (x["d"] == F.char_length(word))
    return each * F.size(F.filter(pieces, lambda x: (F.char_length(x["m"]) > 1) & x["d"].isNotNull() & ~whole(x)))


def anchor_strength(morph: Column, qualities: Column, candidates: Column) -> Column:
    """Length, scarcity of candidates and their mean quality; ``qualities`` holds every measure of every candidate."""
    long = F.least(F.lit(1.0), F.log1p(F.char_length(F.trim(F.coalesce(morph, F.lit(""))))) / F.log1p(F.lit(6.0)))
    return clamp(0.45 * long + 0.35 * F.when(candidates > 0, 1 / candidates).otherwise(0.0) + 0.20 * _mean(qualities), 0.0, 1.0)


def band_similarity(vectors: Column, target: float = 0.45, radius: float = 0.20) -> Column:
    """Mean over the pairs of how near their cosine lies to ``target``; 0 for fewer than two."""
    return _mean(_pairs(vectors, lambda a, b: clamp(1 - F.abs(cosine(a, b) - target) / radius, 0.0, 1.0)))


def coverage_confidence(coverage: Column, residual: Column) -> Column:
    return clamp(0.35 + 0.5 * coverage - 0.2 * residual, 0.0, 1.0)


def candidate_quality(metrics: Column, has_core: Column, definition: Column, is_meta: Column, contrasts: Column, raw_is_meta: Column) -> Column:
    """Mean of the metrics that are there, more for core terms and plain glosses, less for contrast hits and metalanguage without a core."""
    there = F.filter(metrics, lambda x: x.isNotNull())
    plain = (F.trim(F.coalesce(definition, F.lit(""))) != "") & ~is_meta
    bonus = F.when(has_core, 0.12).otherwise(0.0) + F.when(plain, 0.08).otherwise(0.0)
    return F.greatest(F.lit(0.0), _mean(there) + bonus - 0.18 * contrasts - F.when(raw_is_meta & ~has_core, 0.12).otherwise(0.0))


def bundle_coherence(qualities: Column, lexical: Column, functional: Column, has_head: Column) -> Column:
    """Of a word's morph readings: quality, share that names a meaning, a head, and both kinds together; ``lexical`` and ``functional`` are counts."""
    n = F.size(qualities)
    return F.when(n > 0, clamp(0.35 * _mean(qualities) + 0.45 * lexical / n + F.when(has_head, 0.20).otherwise(0.0) + F.when((lexical > 0) & (functional > 0), 0.05).otherwise(0.0), 0.0, 1.0)).otherwise(0.0)


def bundle_bonus(coherence: Column, head: Column, head_is_meta: Column) -> Column:
    return F.when(F.trim(F.coalesce(head, F.lit(""))) == "", -0.25).when(head_is_meta, -0.35).otherwise(0.75 * coherence)


def profile_score(head_hits: Column, heads: Column, modifier_hits: Column, modifiers: Column) -> Column:
    """Of a leading head and modifiers: how many of each a profile's terms meet."""
    least = lambda x: F.greatest(x, F.lit(1))
    return clamp(0.30 * F.least(F.lit(1.0), head_hits / least(heads)) + 0.50 * F.least(F.lit(1.0), modifier_hits / least(modifiers)) + F.when(modifier_hits >= 2, 0.20).otherwise(0.0), 0.0, 1.0)


def speculative_score(morphs: Column, coverage: Column, support: Column, motif: Column, scarcity: Column, singleton_penalty: float = 0.08) -> Column:
    """0 unless a morph is a single letter or there are three; else a blend, with a bonus for dense splits and a penalty for single letters."""
    singles = F.size(F.filter(morphs, lambda m: F.char_length(m) == 1))
    dense = F.least(F.lit(0.20), F.greatest(F.lit(0), F.size(morphs) - 2) * 0.05)
    score = 0.38 * coverage + 0.28 * support + 0.42 * motif + 0.12 * scarcity + dense - singleton_penalty * singles
    return F.when((F.size(morphs) > 0) & ((singles > 0) | (F.size(morphs) >= 3)), F.greatest(F.lit(0.0), score)).otherwise(0.0)


def speculative_branches(rows: DataFrame, word: str = "word", score: str = "score", order: str = "branch", least: float = 0.70, most: int = 5) -> DataFrame:
    """The branches of each word of ``least`` or more, best first, ``most`` at most (the feature's own limit)."""
    place = F.row_number().over(Window.partitionBy(word).orderBy(F.desc(score), order))
    return rows.where(F.col(score) >= least).withColumn("place", place).where(F.col("place") <= most)


def definition_score(largest: Column, clusters: Column, total: Column) -> Column:
    """How far a morph's definitions agree, from their clusters: the largest one's size, their number, and how many definitions there are; one alone is 0.2."""
    cohesion = 1 - (clusters - 1) / (total - 1)
    return F.when(total == 1, 0.2).when(total > 1, (0.7 * largest / total + 0.3 * cohesion) * F.least(F.lit(1.0), F.log1p(total) / F.log1p(F.lit(5.0))))


def definition_coherence(morphs: Column, scores: Column, vectors: Column) -> Column:
    """Of a decomposition: the mean of its morphs' definition scores, complementarity of their definitions' vectors, less for many single letters."""
    complement = F.when(F.size(vectors) >= 2, band_similarity(vectors, 0.35, 0.65)).otherwise(0.0)
    singles = F.size(F.filter(morphs, lambda m: F.char_length(m) == 1))
    total = F.aggregate(lengths(morphs), F.lit(0), lambda a, x: a + x)
    penalty = F.when((total >= 5) & (singles >= 3), 0.02 * (singles - 2) + F.when(complement < 0.2, 0.05 * (0.2 - complement)).otherwise(0.0)).otherwise(0.0)
    return F.when(F.size(scores) > 0, clamp(_mean(scores) + 0.3 * complement - penalty, -1.0, 1.0)).otherwise(0.0)


def semantic_coherence(pieces: Column, cohesion: float = 0.3, diversity: float = 0.7) -> Column:
    """Of an array of (morph, vector): single letters should be alike, longer morphs should differ; 0.5 where neither can be said."""
    singles, large = F.filter(pieces, lambda x: F.char_length(x["morph"]) == 1), F.filter(pieces, lambda x: F.char_length(x["morph"]) > 1)
    alike = lambda p: _mean(_pairs(F.filter(p, lambda x: x["vector"].isNotNull()), lambda a, b: cosine(a["vector"], b["vector"])))
    near, far = alike(singles), alike(large)
    good = F.when(near >= cohesion, F.least(F.lit(1.0), near / cohesion)).otherwise(near / cohesion * 0.5)
    apart = F.when(far <= diversity, 1 - far / diversity).otherwise(0.0)
    n, two, both = F.greatest(F.size(pieces), F.lit(1)), F.size(singles) >= 2, F.size(large) >= 2
    return F.when(two & both, F.size(singles) / n * good + F.size(large) / n * apart).when(two, good).when(both, apart).otherwise(0.5)


def blended(base: Column, coherence: Column, weight: float = 0.05) -> Column:
    return (1 - weight) * base + weight * coherence


def converged(texts: Column, vectors: Column, least: float = 0.815, length: int = 120) -> Column:
    """Whether a debate's texts agree: two of substance at least, long enough on average, mean cosine of their pairs ``least`` or more."""
    pieces = F.filter(F.arrays_zip(F.transform(texts, lambda t: F.trim(F.coalesce(t, F.lit("")))).alias("t"), vectors.alias("v")), lambda x: (x["t"] != "") & ~x["t"].startswith("[ERROR]"))
    long = _mean(F.transform(pieces, lambda x: F.char_length(x["t"]).cast("double")))
    return (F.size(pieces) >= 2) & (long >= length) & (_mean(_pairs(pieces, lambda a, b: cosine(a["v"], b["v"]))) >= least)


def cluster_cohesion(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """key, cohesion: mean cosine of a cluster's pairs, those of cosine 0 left out, to 3 places; 0 without any, as for a null key.

    Equal vectors are counted and not paired: a pair of different ones stands for as many pairs as their counts' product. So the work grows with the square
    of a cluster's different vectors, whatever the number of its rows.
    """
    own = rows.select(F.col(key).alias("k"), F.col(vec).alias("v")).groupBy("k", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    other = own.select("k", F.col("v").alias("w"), F.col("n").alias("m"))
    apart = own.join(other, "k").where(F.col("v") < F.col("w")).select("k", cosine(F.col("v"), F.col("w")).alias("c"), (F.col("n") * F.col("m")).alias("n"))
    alike = own.select("k", F.when(F.col("k").isNotNull(), cosine(F.col("v"), F.col("v"))).otherwise(0.0).alias("c"), (F.col("n") * (F.col("n") - 1) / 2).alias("n"))
    met = F.when(F.col("c") != 0, F.col("n")).otherwise(0.0)
    sums = alike.unionByName(apart).groupBy("k").agg(F.sum(F.col("c") * F.col("n")).alias("total"), F.sum(met).alias("pairs"))
    return sums.select(F.col("k").alias(key), F.round(F.when(F.col("pairs") > 0, F.col("total") / F.col("pairs")).otherwise(0.0), 3).alias("cohesion"))


def within_band(rows: DataFrame, item: str, label: str = "label", score: str = "sim", least: float = 0.3, band: float = 0.05) -> DataFrame:
    """The labels of each item whose score reaches ``least`` and lies within ``band`` of the item's best."""
    top = F.max(score).over(Window.partitionBy(item))
    return rows.withColumn("__top", top).where((F.col(score) >= least) & (F.col(score) >= F.col("__top") - band)).drop("__top")
