"""Enrichment of senses and profiles: tags, domains, terms; candidate definitions; similar words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import glosses as G
from ..functions.vectors import cosine, norm
from .vectors import nearest

#: The order of trust of the kinds of evidence that definitions come from. Fixed values.
KINDS = ("cluster", "residual", "attested", "hypothesis", "dictionary")


def enriched_senses(senses: DataFrame, domains: DataFrame) -> DataFrame:
    """word, sense_id, tags, headword, domains, compound: each sense's parts of speech, headword and that headword's domains; domains: headword, domain."""
    rows = senses.select("word", "sense_id", G.parts_of_speech(F.col("gloss")).alias("tags"), G.singular(G.headword(F.col("gloss"))).alias("headword"), G.is_compound(F.coalesce("gloss", F.lit(""))).alias("compound"))
    known = domains.groupBy("headword").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    return rows.join(known, "headword", "left").withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))


def term_vectors(rows: DataFrame, item: str, terms: Column, most: int | None = None) -> DataFrame:
    """item, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), of length 1 for each item; of all terms the ``most`` frequent (then the first) only."""
    tf = rows.select(item, F.explode(terms).alias("term")).groupBy(item, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if most is not None:  # a vocabulary's bound is part of the method
        df = df.orderBy(F.desc("total"), "term").limit(most)
    n = rows.select(item).distinct().agg(F.count(F.lit(1)).alias("n"))
    weighted = tf.join(df, "term").join(F.broadcast(n)).select(item, "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # one row
    size = weighted.groupBy(item).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return weighted.join(size, item).select(item, "term", (F.col("w") / F.col("size")).alias("weight"))


def char_terms(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams of lower-cased text, white space made one blank; they cross the limits of words."""
    from ..functions.text import char_ngrams

    return F.transform(char_ngrams(F.lower(F.regexp_replace(text, r"\s+", " ")), least, most), lambda x: x["gram"])


def word_terms(text: Column) -> Column:
    """Words of two letters and more, and pairs of neighbours."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    pairs = F.zip_with(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(found, F.filter(pairs, lambda x: x.isNotNull()))


def hashed_terms(text: Column, places: int = 4096) -> Column:
    """Words as numbers of ``places``."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0)), lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(places)).cast("string"))


def domains_of(glosses: DataFrame, domains: DataFrame, item: str, least: float = 0.1) -> DataFrame:
    """item, domain, sim: the domains whose terms are most like a gloss's, ties kept, from ``least`` on; both (item or domain, term, weight), of length 1."""
    sim = glosses.join(domains.withColumnRenamed("weight", "other"), "term").groupBy(item, "domain").agg(F.round(F.sum(F.col("weight") * F.col("other")), 9).alias("sim"))
    return sim.withColumn("top", F.max("sim").over(Window.partitionBy(item))).where((F.col("sim") == F.col("top")) & (F.col("sim") >= least)).drop("top")


def canon_profiles(entries: DataFrame, enriched: DataFrame, terms: int = 12) -> DataFrame:
    """word, tags, domains, head_terms, enriched: an entry's senses put together; entries: word, texts; enriched: word, tags, domains (a row for each sense)."""
    own = enriched.groupBy("word").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("domains"))
    words = entries.select("word", F.explode("texts").alias("t")).select("word", F.explode(G.tokens(F.col("t"))).alias("term")).where((F.length("term") > 2) & ~F.col("term").isin(*G.NOT_HEADS))
    counts = words.groupBy("word", "term").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "term"))
    top = counts.withColumn("k", place).where(F.col("k") <= terms).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "term"))).alias("x"))
    none = F.array().cast("array<string>")
    out = entries.select("word").join(own, "word", "left").join(top.select("word", F.transform("x", lambda x: x["term"]).alias("head_terms")), "word", "left")
    return out.select("word", F.coalesce("tags", none).alias("tags"), F.coalesce("domains", none).alias("domains"), F.coalesce("head_terms", none).alias("head_terms"), F.col("tags").isNotNull().alias("enriched"))


def definition_candidates(rows: DataFrame) -> DataFrame:
    """One row for each definition of a morph, case and space aside: that of the most trusted kind, then of the greatest quality; rows: morph, kind, definition, quality."""
    text = F.lower(F.trim(F.regexp_replace("definition", r"\s+", " ")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    named = rows.where((F.coalesce(text, F.lit("")) != "") & (rank > 0) & ~G.is_placeholder(F.col("definition")))
    return named.withColumn("__n", F.row_number().over(Window.partitionBy("morph", text).orderBy(rank, F.desc("quality"), "definition"))).where("__n = 1").drop("__n")


def fallback_hints(found: DataFrame, sims: DataFrame, most: int = 5) -> DataFrame:
    """Dictionary entries that stand in a word, by how much of it they cover, then by likeness; found: word, morph; sims: word, morph, sim."""
    rows = found.join(sims, ["word", "morph"], "left").withColumn("coverage", F.char_length("morph") / F.char_length("word"))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("coverage"), F.desc(F.coalesce("sim", F.lit(0.0))), "morph"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("word", "morph", "coverage", "sim", "place")


def similar_words(entries: DataFrame, target: DataFrame, variants: DataFrame, most: int = 11) -> DataFrame:
    """word, score, form, meaning, distance: entries by 0.53 likeness of form (the best of the target's spellings) and 0.47 of meaning, the target left out.

    entries: word, form_vec, meaning_vec; target: one of them; variants: the vectors of the target's spellings (vec), a few.
    """
    one = target.select(F.col("word").alias("t_word"), F.col("meaning_vec").alias("t_meaning"))
    spelled = variants.agg(F.collect_list("vec").alias("vecs"))  # a few spellings of one word
    rows = entries.join(F.broadcast(one)).join(F.broadcast(spelled)).where(F.lower("word") != F.lower("t_word"))
    form = F.coalesce(F.array_max(F.transform("vecs", lambda v: cosine(v, F.col("form_vec")))), F.lit(0.0))
    rows = rows.withColumn("form", form).withColumn("meaning", cosine(F.col("meaning_vec"), F.col("t_meaning")))
    out = rows.select("word", F.round(0.53 * F.col("form") + 0.47 * F.col("meaning"), 3).alias("score"), F.round("form", 3).alias("form"), F.round("meaning", 3).alias("meaning"), F.levenshtein(F.lower("word"), F.lower("t_word")).alias("distance"))
    return out.orderBy(F.desc("score"), "word").limit(most)  # the report's own limit


def delta_senses(words: DataFrame, senses: DataFrame, k: int = 5, gain: float = 0.10) -> DataFrame:
    """item, sense, sim, place, accepted: the senses nearest to what a word means beyond its anchor; words: item, vec, anchor_vec, before, after (residuals).

    senses: sense, sense_vec, a dictionary's. A hypothesis is accepted if the residual falls by ``gain`` or more.
    """
    delta = F.explode(F.array(F.zip_with("vec", "anchor_vec", lambda a, b: a - b)))  # a generator's output is worked out once
    rows = words.select("item", delta.alias("d"), (F.col("before") - F.col("after") >= gain).alias("accepted")).select("*", F.explode(F.array(norm(F.col("d")))).alias("n"))
    rows = rows.where((F.col("n") > 0) & ~F.isnan("n")).select("item", F.transform("d", lambda x: x / F.col("n")).alias("d"), "accepted")
    pairs = nearest(rows.select("item", "accepted", F.col("d").alias("vec")), senses.select("sense", F.col("sense_vec").alias("vec")), k)
    pairs = pairs.select("item", "sense", F.round("sim", 9).alias("sim"), "accepted")
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sim"), "sense"))).where(F.col("place") <= k)


def search_tiers(rows: DataFrame, query: str, form: str, meaning: str, likeness: str, least: float) -> DataFrame:
    """``rows`` with score, priority and tier of a candidate word (column ``form``) beside the word searched for (column ``query``), from ``least`` on.

    score: 0.40 of the likeness of form and 0.60 of that of meaning in per cent, and 0.60 where one word begins or ends with the other.
    """
    edge = F.col(form).startswith(F.col(query)) | F.col(form).endswith(F.col(query))
    priority = F.when(edge, 2).when(F.col(form).contains(F.col(query)), 1).otherwise(0)
    score = 0.40 * F.col(likeness) + 0.60 * F.least(F.lit(100.0), 100 * F.col(meaning)) + F.when(edge, 0.60).otherwise(0.0)
    out = rows.withColumn("score", score).withColumn("priority", priority)
    tier = F.when((F.col("priority") == 2) & (F.col("score") > 0.85), "Very strong connection").when(F.col("priority") == 2, "Possible connection").when(F.col("priority") == 1, "Somewhat possible connection").otherwise("Weak to no connection")
    return out.withColumn("tier", tier).where(F.col("score") >= least)


def exact_candidates(rows: DataFrame, whole_words: bool = True, short: int = 4) -> DataFrame:
    """word, analysis, definition, score, suppressed: what is known of a word as a whole, beside its decompositions; rows: word, kind, definition, quality.

    A dictionary's entry scores 200, the best cluster or residual 150 and its quality. Without ``whole_words`` the dictionary is suppressed, and so is the other for
    words of more than ``short`` letters.
    """
    said = rows.where(F.trim(F.coalesce("definition", F.lit(""))) != "")
    first = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("quality"), "definition"))
    entry = said.where("kind = 'dictionary'").withColumn("n", first).where("n = 1").select("word", F.lit("dictionary_exact").alias("analysis"), "definition", F.lit(200.0).alias("score"), F.lit(not whole_words).alias("suppressed"))
    anchor = said.where("kind in ('cluster', 'residual')").withColumn("n", first).where("n = 1")
    anchor = anchor.select("word", F.lit("whole_word_anchor").alias("analysis"), "definition", (150 + F.col("quality")).alias("score"), (F.lit(not whole_words) & (F.char_length("word") > short)).alias("suppressed"))
    return entry.unionByName(anchor)


def sentence_matches(sentences: DataFrame, clusters: DataFrame, most: int = 7) -> DataFrame:
    """sentence, word_index, start, end, ngram and the clusters of every n-gram of up to ``most`` letters of a sentence's words; sentences: sentence, words; clusters: ngram, ..."""
    from ..functions.text import char_ngrams

    words = sentences.select("sentence", F.posexplode("words").alias("word_index", "word"))
    grams = words.select("sentence", "word_index", F.explode(char_ngrams(F.lower("word"), 1, most)).alias("x"))
    return grams.select("sentence", "word_index", F.col("x.start").alias("start"), (F.col("x.start") + F.char_length("x.gram")).alias("end"), F.col("x.gram").alias("ngram")).join(clusters, "ngram")


def sections(rows: DataFrame, item: str, text: str) -> DataFrame:
    """item, section, text: the sections of a text with lines ``KEY: value``, their lines joined by line breaks; a key again adds to its section, lines before the first belong to none."""
    pattern = r"^\s*([A-Z][A-Z_ ]+?)\s*:\s*(.*)$"
    lines = rows.select(item, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")).alias("at", "line"))
    key = F.regexp_extract("line", pattern, 1)
    lines = lines.select(item, "at", F.when(key != "", key).alias("key"), F.when(key != "", F.regexp_extract("line", pattern, 2)).otherwise(F.col("line")).alias("line"))
    owned = lines.withColumn("section", F.last("key", ignorenulls=True).over(Window.partitionBy(item).orderBy("at"))).where("section is not null and (key is null or line <> '')")
    parts = owned.groupBy(item, "section").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    return parts.select(item, "section", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))
