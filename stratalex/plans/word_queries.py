"""Queries of words: spellings, covers, residuals, enrichment and likeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import glosses as G
from ..functions.text import words
from ..functions.vectors import unit
from ..operators import enrichment as E
from ..operators import refresh as R
from ..operators import segment as S
from ..operators import variants as V
from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_W = "w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark)"


def _words(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.transform(words(F.col("text")), F.lower)).alias("word")).distinct()


_RULES = [("E", "I"), ("TH", "T"), ("T", "TH")]


def _step(level: str) -> str:
    one = "SELECT word, left(v, i) || '{t}' || substr(v, i + {n} + 1) AS v FROM (SELECT word, v, unnest(range(0, length(v))) AS i FROM {l}) WHERE substr(v, i + 1, {n}) = '{s}'{more}"
    return " UNION ".join(one.format(s=s, t=t, n=len(s), l=level, more=f" AND substr(v, i + 1, {len(t)}) <> '{t}'" if t.startswith(s) else "") for s, t in _RULES)


@query("x12_lookup_variants", f"""
WITH {_W}, s AS (SELECT word, upper(word) AS v FROM w WHERE length(word) <= 6), l1 AS ({_step('s')}), l2 AS ({_step('l1')}), a AS (SELECT * FROM s UNION SELECT * FROM l1 UNION SELECT * FROM l2)
SELECT word, array_to_string([upper(word)] || coalesce(list_sort(list(v) FILTER (v <> upper(word))), []), ',') AS variants FROM a GROUP BY word""")
def _variants(spark, d):
    w = _words(spark, d).where("length(word) <= 6")
    return w.select("word", F.array_join(V.lookup_variants(F.col("word"), _RULES), ",").alias("variants"))


_SUBS = {"e": ["i", "ae"], "o": ["u"], "t": ["d"]}
_SUB_SQL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in _SUBS.items()) + " ELSE {other} END"


@query("x13_substitution_variants", f"""
WITH RECURSIVE {_W}, s AS (SELECT word, 0 AS pos, '' AS v, 0 AS n FROM w WHERE length(word) <= 6 UNION ALL
  SELECT word, pos + 1, v || c.x, n + (c.x <> substr(word, pos + 1, 1))::INT FROM (SELECT *, unnest([substr(word, pos + 1, 1)] || CASE WHEN n < 3 THEN {_SUB_SQL.format(c="substr(word, pos + 1, 1)", other="[]::VARCHAR[]")} ELSE []::VARCHAR[] END) AS x FROM s WHERE pos < length(word)) c)
SELECT word, array_to_string(list_sort(list_distinct(list(v))), ',') AS variants FROM s WHERE pos = length(word) GROUP BY word""")
def _substituted(spark, d):
    return _words(spark, d).where("length(word) <= 6").select("word", F.array_join(V.substitution_variants(F.col("word"), _SUBS), ",").alias("variants"))


@query("n62_two_place_variants", f"""
WITH {_W}, x AS (SELECT word, i, j, {_SUB_SQL.format(c="substr(word, i, 1)", other="[substr(word, i, 1)]")} AS a, {_SUB_SQL.format(c="substr(word, j, 1)", other="[substr(word, j, 1)]")} AS b FROM w, range(1, 13) p(i), range(1, 13) q(j) WHERE i < j AND j <= length(word) AND length(word) <= 8),
y AS (SELECT word, left(word, i - 1) || a || substr(word, i + 1, j - i - 1) || b || substr(word, j + 1) AS v FROM (SELECT word, i, j, a, unnest(b) AS b FROM (SELECT word, i, j, unnest(a) AS a, b FROM x)) UNION SELECT word, word FROM w WHERE length(word) <= 8)
SELECT word, array_to_string(list_sort(list_distinct(list(v))), ',') AS variants FROM y GROUP BY word""")
def _two(spark, d):
    return _words(spark, d).where("length(word) <= 8").select("word", F.array_join(V.two_place_variants(F.col("word"), _SUBS), ",").alias("variants"))


@query("x14_compressed", f"WITH {_W} SELECT word, replace(replace(word, 'th', 't'), 'er', 'r') AS compressed FROM w")
def _compressed(spark, d):
    rules = [{"from": "th", "to": "t", "direction": "from"}, {"from": "a", "to": "e", "direction": "to"}, {"from": "er", "to": "r", "direction": "both"}]
    return _words(spark, d).select("word", V.compressed(F.col("word"), rules).alias("compressed"))


_PIECES = "pc AS (SELECT DISTINCT substr(word, i, n) AS piece FROM w, range(1, 4) a(i), range(1, 4) b(n) WHERE i + n - 1 <= length(word) AND (i = 1 OR length(word) = i + n - 1) AND ascii(word) % 2 = 0)"
_COVER = "cov AS (SELECT word, 0 AS pos, []::VARCHAR[] AS p FROM w WHERE length(word) <= 9 UNION ALL SELECT word, pos + length(piece), list_append(p, piece) FROM cov JOIN pc ON substr(word, pos + 1, length(piece)) = piece WHERE pos < length(word))"


def _pieces(spark, d):
    w = _words(spark, d).where(F.ascii("word") % 2 == 0)
    cut = w.select("word", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select("word", "i", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).where("i + n - 1 <= length(word) and (i = 1 or length(word) = i + n - 1)")
    return cut.select(F.substring("word", F.col("i"), F.col("n")).alias("piece")).distinct()


@query("n2_attested_covers", f"""
WITH RECURSIVE {_W}, {_PIECES}, {_COVER} SELECT word, row_number() OVER (PARTITION BY word ORDER BY len(p), p)::INT AS rank, array_to_string(p, '+') AS pieces FROM cov WHERE pos = length(word) QUALIFY rank <= 100""")
def _covers(spark, d):
    return S.attested_covers(_words(spark, d).where("length(word) <= 9"), _pieces(spark, d)).withColumn("pieces", F.array_join("pieces", "+"))


@query("n3_coverable", f"WITH RECURSIVE {_W}, {_PIECES}, {_COVER} SELECT word, bool_or(pos = length(word)) AS covered FROM cov GROUP BY word")
def _coverable(spark, d):
    return S.coverable(_words(spark, d).where("length(word) <= 9"), _pieces(spark, d))


@query("n4_isolatable", f"""
WITH RECURSIVE {_W}, {_PIECES}, h AS (SELECT word AS host, substr(word, 2, 2) AS root FROM w WHERE length(word) BETWEEN 3 AND 9), o AS (SELECT host, root, i, left(host, i) AS pre, substr(host, i + 3) AS post FROM (SELECT host, root, unnest(range(0, length(host) - 1)) AS i FROM h) WHERE substr(host, i + 1, 2) = root),
t AS (SELECT DISTINCT host, unnest([pre, post]) AS word FROM o), c AS (SELECT host, word, 0 AS pos FROM t UNION SELECT host, word, pos + length(piece) FROM c JOIN pc ON substr(word, pos + 1, length(piece)) = piece WHERE pos < length(word) AND position(piece IN host) > 0),
k AS (SELECT host, word, bool_or(pos = length(word)) AS ok FROM c GROUP BY ALL)
SELECT o.host, root, bool_or(a.ok AND b.ok) AS isolatable FROM o JOIN k a ON a.host = o.host AND a.word = pre JOIN k b ON b.host = o.host AND b.word = post GROUP BY ALL""")
def _isolatable(spark, d):
    hosts = _words(spark, d).where("length(word) between 3 and 9").select(F.col("word").alias("host"), F.substring("word", 2, 2).alias("root"))
    return S.isolatable_roots(hosts, _pieces(spark, d))


@query("n5_all_splits", f"""
WITH RECURSIVE {_W}, s AS (SELECT word, 0 AS pos, []::VARCHAR[] AS p FROM w WHERE length(word) BETWEEN 2 AND 9 UNION ALL SELECT word, pos + n, list_append(p, substr(word, pos + 1, n)) FROM (SELECT *, unnest(range(2, length(word) - pos + 1)) AS n FROM s WHERE pos < length(word)))
SELECT word, array_to_string(p, '+') AS pieces FROM s WHERE pos = length(word)""")
def _splits(spark, d):
    return S.all_splits(_words(spark, d).where("length(word) between 2 and 9")).withColumn("pieces", F.array_join("pieces", "+"))


@query("n32_definition_beam", """
WITH c AS (SELECT l_orderkey AS word, l_linenumber % 2 AS place, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_partkey, l_suppkey, l_extendedprice) AS choice, l_partkey, l_quantity / 50 AS quality FROM lineitem WHERE l_linenumber < 5),
k AS (SELECT word, place, choice, quality, e.embedding::DOUBLE[] AS v FROM c JOIN embeddings e ON e.vec_id = l_partkey % 200 WHERE choice <= 3), u AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS n FROM k),
a AS (SELECT * FROM u WHERE place = 0), b AS (SELECT * FROM u WHERE place = 1),
p AS (SELECT a.word, 0.45 * greatest(0, least(1, 1 - abs(list_dot_product(a.n, b.n) - 0.45) / 0.2)) + 0.3 * 0.5 + 0.15 * (a.quality + b.quality) / 2 - 0.1 * ((a.choice % 2) + (b.choice % 2)) / 2 AS score FROM a JOIN b USING (word)
UNION ALL SELECT word, 0.3 * 0.5 + 0.15 * quality - 0.1 * (choice % 2) FROM u WHERE word NOT IN (SELECT word FROM a INTERSECT SELECT word FROM b))
SELECT word::VARCHAR AS word, round(max(score), 6)::DOUBLE AS score FROM p GROUP BY word""")
def _definitions(spark, d):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("l_orderkey", "place").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    c = table(spark, d, "lineitem").where("l_linenumber < 5").withColumn("place", F.col("l_linenumber") % 2).withColumn("choice", nth.cast("long")).where("choice <= 3")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), unit(F.col("embedding").cast("array<double>")).alias("vector"))
    rows = c.withColumn("k", F.col("l_partkey") % 200).join(e, "k").select(F.col("l_orderkey").cast("string").alias("word"), "place", "choice", "vector", (F.col("l_quantity") / 50).alias("quality"), F.lit(0.5).alias("anchor"), (F.col("choice") % 2).cast("double").alias("contradiction"))
    return S.definition_beam(rows).select("word", "score")


# a part's name as a word, its first letters as a root, and segments at places that its numbers choose
_SEG = """t AS (SELECT p_partkey AS id, replace(p_name, ' ', '') AS word, left(p_name, 2 + p_size % 3) AS root, p_size % length(replace(p_name, ' ', '')) AS a, p_partkey % 5 AS n FROM part),
g AS (SELECT id, word, root, length(word) AS size, unnest([CASE WHEN n % 2 = 0 THEN {'s': 0, 'e': length(root), 'c': root} END, {'s': a, 'e': a + n, 'c': 'x'}, CASE WHEN n = 3 THEN {'s': 0, 'e': length(word), 'c': word} END, {'s': a + 1, 'e': a + 30, 'c': 'y'}]) AS x FROM t)"""


def _segmented(spark, d):
    name = F.replace("p_name", F.lit(" "), F.lit(""))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("word"), F.substring("p_name", F.lit(1), 2 + F.col("p_size") % 3).alias("root"), (F.col("p_size") % F.length(name)).alias("a"), (F.col("p_partkey") % 5).cast("int").alias("n"))
    of = lambda s, e, c: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), c.alias("canonical"))
    items = F.array(F.when(F.col("n") % 2 == 0, of(F.lit(0), F.length("root"), F.col("root"))), of(F.col("a"), F.col("a") + F.col("n"), F.lit("x")), F.when(F.col("n") == 3, of(F.lit(0), F.length("word"), F.col("word"))), of(F.col("a") + 1, F.col("a") + 30, F.lit("y")))
    return p.withColumn("segments", F.filter(items, lambda x: x.isNotNull()))


def _mask(where: str, extra: str = "") -> str:
    return f"m AS (SELECT t.id, t.word, i, bool_or(i >= x.s AND i < x.e{where}){extra} AS hit FROM t, range(0, 40) r(i), g WHERE g.id = t.id AND x IS NOT NULL AND i < length(t.word) GROUP BY ALL)"


@query("y8_breakdown", f"""
WITH {_SEG}, {_mask('')}, r AS (SELECT id, count_if(hit) / count(*) AS coverage, string_agg(CASE WHEN hit THEN ' ' ELSE substr(word, i::INT + 1, 1) END, '' ORDER BY i) AS rest FROM m GROUP BY id)
SELECT id, round(coverage, 6)::DOUBLE AS coverage, trim(regexp_replace(rest, ' +', ' ', 'g')) AS uncovered FROM r""")
def _breakdown(spark, d):
    p = _segmented(spark, d).select("id", R.breakdown(F.col("word"), F.col("segments")).alias("b"))
    return p.select("id", F.round("b.coverage", 6).alias("coverage"), F.array_join("b.uncovered", " ").alias("uncovered"))


@query("y7_refreshed", f"""
WITH {_SEG}, g1 AS (SELECT * FROM g WHERE x IS NOT NULL AND lower(x.c) <> lower(root)), {_mask('').replace('FROM t, range(0, 40) r(i), g WHERE', 'FROM t, range(0, 40) r(i), g1 g WHERE').replace('m AS', 'm1 AS')}, f AS (SELECT m1.id, bool_and(hit) AND starts_with(lower(any_value(m1.word)), lower(any_value(root))) AS full_cover FROM m1 JOIN t ON t.id = m1.id GROUP BY m1.id),
g2 AS (SELECT g1.*, full_cover FROM g1 JOIN f USING (id)), k AS (SELECT t.id, t.word, i, full_cover, bool_or(i >= x.s AND i < x.e AND (NOT full_cover OR lower(x.c) <> lower(t.word))) OR (full_cover AND i < length(t.root)) AS hit FROM t JOIN g2 ON g2.id = t.id, range(0, 40) r(i) WHERE i < length(t.word) GROUP BY t.id, t.word, t.root, i, full_cover)
SELECT id, round(count_if(hit) / count(*), 6)::DOUBLE AS coverage, trim(regexp_replace(string_agg(CASE WHEN hit THEN ' ' ELSE substr(word, i::INT + 1, 1) END, '' ORDER BY i), ' +', ' ', 'g')) AS uncovered FROM k GROUP BY id""")
def _refreshed(spark, d):
    p = _segmented(spark, d).select("id", R.refreshed(F.col("word"), F.col("root"), F.col("segments")).alias("b"))
    return p.select("id", F.round("b.coverage", 6).alias("coverage"), F.array_join("b.uncovered", " ").alias("uncovered"))


@query("n50_preferred", """
WITH p AS (SELECT p_partkey, p_name AS word, CASE WHEN p_size % 3 = 0 THEN [p_name] ELSE string_split(p_name, ' ') END AS s, p_retailprice AS score FROM part), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY (len(s) > 1) DESC, score DESC, len(s), p_partkey) = 1)
SELECT word, len(s)::INT AS n, score FROM b WHERE NOT (len(s) = 1 AND lower(s[1]) = lower(word))""")
def _preferred(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("word"), F.transform(F.when(F.col("p_size") % 3 == 0, F.array("p_name")).otherwise(F.split("p_name", " ")), lambda x: F.struct(x.alias("canonical"))).alias("segments"), F.col("p_retailprice").alias("score"))
    return R.preferred(p).select("word", F.size("segments").alias("n"), "score")


_ROWS = "r AS (SELECT p_brand AS root, p_name || p_partkey AS word, (p_size % 11) / 10 AS coverage, 1 - (p_size % 11) / 10 AS residual, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 7) / 7 END AS confidence, CASE p_size % 3 WHEN 0 THEN [] WHEN 1 THEN [p_type] ELSE [p_type, left(p_name, 3)] END AS uncovered FROM part)"


def _analyses(spark, d):
    k = F.col("p_size") % 3
    uncovered = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("p_type")).otherwise(F.array("p_type", F.substring("p_name", 1, 3)))
    return table(spark, d, "part").select(F.col("p_brand").alias("root"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("word"), ((F.col("p_size") % 11) / 10).alias("coverage"), (1 - (F.col("p_size") % 11) / 10).alias("residual"), F.when(F.col("p_partkey") % 3 > 0, (F.col("p_partkey") % 7) / 7).alias("confidence"), uncovered.alias("uncovered"))


@query("n9_residual_summary", f"""
WITH {_ROWS}, s AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY residual DESC, coalesce(confidence, 0), word) AS n FROM r)
SELECT root, count(*) AS n_words, round(avg(length(word)), 6) AS avg_len, round(sum(coverage * length(word)) / sum(length(word)), 6)::DOUBLE AS avg_coverage, string_agg(word || ':' || format('{{:.2f}}', residual::DOUBLE), ', ' ORDER BY n) FILTER (n <= 3) AS headline FROM s GROUP BY root""")
def _summary(spark, d):
    return R.summary(_analyses(spark, d)).select("root", "n_words", F.round("avg_len", 6).alias("avg_len"), F.round("avg_coverage", 6).alias("avg_coverage"), "headline")


@query("n52_guidance", f"""
WITH {_ROWS}, f AS (SELECT root, upper(unnest(uncovered)) AS f FROM r), c0 AS (SELECT root, f, count(*) AS freq, sum(length(f)) AS total FROM f GROUP BY root, f), c AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY freq DESC, total DESC, f) AS n FROM c0), t AS (SELECT root, string_agg(f || 'x' || freq, ',' ORDER BY n) AS top_fragments FROM c WHERE n <= 6 GROUP BY root),
h AS (SELECT root, word, row_number() OVER (PARTITION BY root ORDER BY residual DESC, coalesce(confidence, 0), word) AS n FROM r) SELECT h.root, coalesce(any_value(top_fragments), '') AS top_fragments, string_agg(upper(word), ',' ORDER BY n) AS hot_words FROM h LEFT JOIN t ON t.root = h.root WHERE n <= 10 GROUP BY h.root""")
def _guidance(spark, d):
    return R.guidance(_analyses(spark, d))


@query("n52_equations", "SELECT p_partkey, upper(p_name || ' - ' || array_to_string(string_split(p_name, ' '), ' - ') || ' = ' || CASE WHEN p_size % 2 = 0 THEN '(nothing)' ELSE p_type END) AS equation FROM part")
def _equations(spark, d):
    return table(spark, d, "part").select("p_partkey", R.equation(F.col("p_name"), F.split("p_name", " "), F.when(F.col("p_size") % 2 == 1, F.col("p_type"))).alias("equation"))


@query("n51_decomposed", f"""
WITH {_W}, b AS (SELECT word, [left(word, length(word) // 2), substr(word, length(word) // 2 + 1)] AS s FROM w WHERE length(word) > 1 AND ascii(word) % 3 > 0),
x AS (SELECT word, s[i] AS morph, CASE WHEN i = 1 THEN 0 ELSE length(s[1]) END AS start FROM (SELECT word, s, unnest([1, 2]) AS i FROM b) WHERE length(s[i]) >= 2), y AS (SELECT word AS token, row_number() OVER (PARTITION BY word ORDER BY start) - 1 AS seg_index, morph, start FROM x)
SELECT token, seg_index::INT AS seg_index, morph, start::INT AS span_start, (start + length(morph))::INT AS span_end FROM y UNION ALL SELECT word, 0, word, 0, length(word)::INT FROM w WHERE word NOT IN (SELECT token FROM y)""")
def _decomposed(spark, d):
    w = _words(spark, d)
    half = F.floor(F.length("word") / 2).cast("int")
    return R.decomposed(w, w.where((F.length("word") > 1) & (F.ascii("word") % 3 > 0)).select("word", F.array(F.substring("word", F.lit(1), half), F.substring("word", half + 1, F.length("word"))).alias("segments")))


@query("n49_composites", """
WITH t AS (SELECT p_partkey AS token, string_split(p_name, ' ') || CASE WHEN p_size % 2 = 0 THEN [string_split(p_name, ' ')[-1]] ELSE [] END AS m FROM part), u AS (SELECT token, list_filter(m, lambda x, i: i = 1 OR x <> m[greatest(i - 1, 1)]) AS m FROM t),
x AS (SELECT token, unnest(m) AS morph FROM u) SELECT token::VARCHAR AS token, round(avg(length(morph)), 6) AS a, round(avg(ascii(morph)), 6) AS b FROM x WHERE ascii(morph) % 4 > 0 GROUP BY token""")
def _composites(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("token"), F.concat(F.split("p_name", " "), F.when(F.col("p_size") % 2 == 0, F.array(F.element_at(F.split("p_name", " "), -1))).otherwise(F.array().cast("array<string>"))).alias("morphs"))
    v = t.select(F.explode("morphs").alias("morph")).distinct().where(F.ascii("morph") % 4 > 0).select("morph", F.array(F.length("morph").cast("double"), F.ascii("morph").cast("double")).alias("vec"))
    return R.composites(t, v, 2).where("vec is not null").select("token", F.round(F.get("vec", F.lit(0)), 6).alias("a"), F.round(F.get("vec", F.lit(1)), 6).alias("b"))


def _tfidf(terms: str, most: int) -> str:
    return f"""t AS (SELECT item_id, unnest({terms}) AS term FROM benchmark), f AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL), v AS (SELECT term, count(*) AS df FROM f GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {most}),
k AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM f JOIN v USING (term)) SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6)::DOUBLE AS weight FROM k"""


_GRAMS = "flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(1, length(text) - n + 2)), lambda i: substr(lower(regexp_replace(text, '\\s+', ' ', 'g')), i, n))))"


@query("n15_char_vectors", f"WITH {_tfidf(_GRAMS, 6000)}")
def _chars(spark, d):
    return E.term_vectors(table(spark, d, "benchmark"), "item_id", E.char_terms(F.col("text")), 6000).withColumn("weight", F.round("weight", 6))


_TOK = "regexp_extract_all(lower(text), '[a-z0-9_]{2,}')"


@query("n15_word_vectors", f"WITH {_tfidf(f'{_TOK} || list_transform(range(1, len({_TOK})), lambda i: {_TOK}[i] || chr(32) || {_TOK}[i + 1])', 5000)}")
def _word_vectors(spark, d):
    return E.term_vectors(table(spark, d, "benchmark"), "item_id", E.word_terms(F.col("text")), 5000).withColumn("weight", F.round("weight", 6))


_SENSES = ("a river", "to be, to exist", "to carry waters", "of the sea", "and", "they", "which is sung, often", "the stars", "")


def _sensed(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("word"), F.col("p_partkey").alias("sense_id"), F.get(F.array(*map(F.lit, _SENSES)), (F.col("p_partkey") % len(_SENSES)).cast("int")).alias("gloss"))


_GL = "[" + ", ".join(f"'{x}'" for x in _SENSES) + f"][p_partkey % {len(_SENSES)} + 1]"
_TAGS = "['NOUN', 'PHRASE,AUX', 'PHRASE,VERB,ADP', 'PHRASE,ADP', 'CCONJ', 'PHRASE,PRON', 'PHRASE,NOUN', 'NOUN', 'NOUN']"
_HEADS = "['river', 'be', 'carry', 'sea', NULL, 'they', 'which', 'star', NULL]"


@query("n53_enriched_senses", f"""
SELECT p_brand AS word, p_partkey AS sense_id, {_TAGS}[p_partkey % 9 + 1] AS tags, {_HEADS}[p_partkey % 9 + 1] AS headword, CASE {_HEADS}[p_partkey % 9 + 1] WHEN 'river' THEN 'NATURE,WATER' WHEN 'sea' THEN 'WATER' WHEN 'star' THEN 'SKY' ELSE '' END AS domains FROM part""")
def _enriched(spark, d):
    domains = spark.createDataFrame([("river", "WATER"), ("river", "NATURE"), ("sea", "WATER"), ("star", "SKY")], "headword string, domain string")
    out = E.enriched_senses(_sensed(spark, d), domains)
    return out.select("word", "sense_id", F.array_join("tags", ",").alias("tags"), "headword", F.array_join("domains", ",").alias("domains"))


@query("n54_domains", """
WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark), f AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(DISTINCT item_id) AS n FROM t), v AS (SELECT term, count(*) AS df FROM f GROUP BY term),
k AS (SELECT item_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM f JOIN v USING (term), n), u AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM k),
s AS (SELECT a.item_id, b.item_id % 5 AS g, b.item_id AS other, round(sum(a.w * b.w), 9) AS sim FROM u a JOIN u b USING (term) WHERE a.item_id >= 5 AND b.item_id < 5 GROUP BY ALL)
SELECT item_id, other AS domain, round(sim, 6) AS sim FROM s QUALIFY sim = max(sim) OVER (PARTITION BY item_id) AND sim >= 0.05""")
def _domains(spark, d):
    v = E.term_vectors(table(spark, d, "benchmark"), "item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return E.domains_of(v.where("item_id >= 5"), v.where("item_id < 5").withColumnRenamed("item_id", "domain"), "item_id", 0.05).withColumn("sim", F.round("sim", 6))


@query("n55_canon_profiles", f"""
WITH e AS (SELECT DISTINCT p_brand AS word FROM part), t AS (SELECT p_brand AS word, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')) AS term FROM part), c0 AS (SELECT word, term, count(*) AS n FROM t WHERE length(term) > 2 GROUP BY word, term), c AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, term) AS k FROM c0),
h AS (SELECT word, string_agg(term, ',' ORDER BY k) AS head_terms FROM c WHERE k <= 12 GROUP BY word), g AS (SELECT DISTINCT p_brand AS word, unnest(string_split({_TAGS}[p_partkey % 9 + 1], ',')) AS tag FROM part WHERE p_size > 10)
SELECT e.word, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags, any_value(head_terms) AS head_terms, count(tag) > 0 AS enriched FROM e JOIN h USING (word) LEFT JOIN g USING (word) GROUP BY e.word""")
def _profiles(spark, d):
    p = table(spark, d, "part")
    entries = p.groupBy(F.col("p_brand").alias("word")).agg(F.collect_list(F.concat("p_name", F.lit(" "), "p_type")).alias("texts"))
    senses = _sensed(spark, d).join(p.where("p_size > 10").select(F.col("p_partkey").alias("sense_id")), "sense_id")
    rows = senses.select("word", G.parts_of_speech(F.col("gloss")).alias("tags"), F.array().cast("array<string>").alias("domains"))
    return E.canon_profiles(entries, rows).select("word", F.array_join("tags", ",").alias("tags"), F.array_join("head_terms", ",").alias("head_terms"), "enriched")


@query("n56_definition_candidates", """
WITH r AS (SELECT p_brand AS morph, ['cluster', 'residual', 'attested', 'hypothesis', 'dictionary', 'other'][p_size % 6 + 1] AS kind, p_size % 6 + 1 AS rank, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '[UNKNOWN]' WHEN 2 THEN upper(p_name) ELSE p_name || ' ' END AS definition, p_retailprice AS quality FROM part)
SELECT morph, lower(trim(definition)) AS definition, kind, quality FROM r WHERE trim(definition) NOT IN ('', '[UNKNOWN]') AND kind <> 'other' QUALIFY row_number() OVER (PARTITION BY morph, lower(trim(definition)) ORDER BY rank, quality DESC, definition) = 1""")
def _candidates(spark, d):
    k, n = F.col("p_partkey") % 7, (F.col("p_size") % 6).cast("int")
    p = table(spark, d, "part").select(F.col("p_brand").alias("morph"), F.get(F.array(*map(F.lit, (*E.KINDS, "other"))), n).alias("kind"), F.when(k == 0, "").when(k == 1, "[UNKNOWN]").when(k == 2, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" "))).alias("definition"), F.col("p_retailprice").alias("quality"))
    return E.definition_candidates(p).select("morph", F.lower(F.trim("definition")).alias("definition"), "kind", "quality")


@query("n57_fallback_hints", f"""
WITH {_W}, f AS (SELECT DISTINCT word, upper(substr(word, i, n)) AS morph FROM w, range(1, 4) a(i), range(2, 5) b(n) WHERE i + n - 1 <= length(word)), s AS (SELECT word, morph, CASE WHEN ascii(morph) % 2 = 0 THEN (ascii(right(morph, 1)) % 10) / 10 END AS sim FROM f)
SELECT word, morph, round(length(morph) / length(word), 6) AS coverage, row_number() OVER (PARTITION BY word ORDER BY length(morph) / length(word) DESC, coalesce(sim, 0) DESC, morph)::INT AS place FROM s QUALIFY place <= 5""")
def _hints(spark, d):
    w = _words(spark, d)
    cut = w.select("word", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select("word", "i", F.explode(F.sequence(F.lit(2), F.lit(4))).alias("n")).where("i + n - 1 <= length(word)")
    found = cut.select("word", F.upper(F.substring("word", F.col("i"), F.col("n"))).alias("morph")).distinct()
    sims = found.where(F.ascii("morph") % 2 == 0).select("word", "morph", ((F.ascii(F.substring("morph", -1, 1)) % 10) / 10).alias("sim"))
    return E.fallback_hints(found, sims).select("word", "morph", F.round("coverage", 6).alias("coverage"), "place")


_C = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"


@query("n61_similar_words", f"""
WITH e AS (SELECT vec_id, 'w' || vec_id AS word, embedding[1:32]::DOUBLE[] AS f, embedding[33:64]::DOUBLE[] AS m FROM embeddings), t AS (SELECT * FROM e WHERE vec_id = 3), v AS (SELECT f AS v FROM e WHERE vec_id IN (3, 4, 5)),
s AS (SELECT e.word, (SELECT max({_C.format('v', 'e.f')}) FROM v) AS form, {_C.format('e.m', 't.m')} AS meaning, levenshtein(e.word, t.word) AS distance FROM e, t WHERE e.vec_id <> 3)
SELECT word, round(0.53 * form + 0.47 * meaning, 3) AS score, round(form, 3) AS form, round(meaning, 3) AS meaning, distance::INT AS distance FROM s ORDER BY score DESC, word LIMIT 11""")
def _similar(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.slice(F.col("embedding").cast("array<double>"), 1, 32).alias("form_vec"), F.slice(F.col("embedding").cast("array<double>"), 33, 32).alias("meaning_vec"))
    return E.similar_words(e, e.where("vec_id = 3"), e.where("vec_id in (3, 4, 5)").select(F.col("form_vec").alias("vec")))


@query("n40_delta_senses", f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id AS item, list_transform(range(1, 65), lambda i: a.v[i] - b.v[i]) AS d FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 5 = 0),
p AS (SELECT item, vec_id AS sense, round({_C.format('d', 'v')}, 9) AS sim FROM d, e WHERE vec_id % 5 = 2)
SELECT item, sense, round(sim, 6) AS sim, row_number() OVER (PARTITION BY item ORDER BY sim DESC, sense)::INT AS place, item % 3 = 1 AS accepted FROM p QUALIFY place <= 5""")
def _delta(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = e.where("vec_id % 5 = 0").withColumn("k", F.col("vec_id") + 1).join(e.select(F.col("vec_id").alias("k"), F.col("v").alias("anchor_vec")), "k")
    rows = rows.select(F.col("vec_id").alias("item"), F.col("v").alias("vec"), "anchor_vec", F.lit(0.5).alias("before"), F.when(F.col("vec_id") % 3 == 1, 0.3).otherwise(0.45).alias("after"))
    return E.delta_senses(rows, e.where("vec_id % 5 = 2").select(F.col("vec_id").alias("sense"), F.col("v").alias("sense_vec"))).withColumn("sim", F.round("sim", 6))


@query("n21_search_tiers", f"""
WITH {_W}, q AS (SELECT word AS query FROM w WHERE length(word) = 3 AND ascii(word) % 5 = 0), x AS (SELECT query, word, (ascii(word) % 10) / 10 AS ft, (length(word) % 7) / 700 AS meaning, starts_with(word, query) OR suffix(word, query) AS edge FROM q, w WHERE contains(word, query)),
s AS (SELECT *, 0.4 * ft + 0.6 * least(100, 100 * meaning) + CASE WHEN edge THEN 0.6 ELSE 0 END AS score FROM x)
SELECT query, word, round(score, 6)::DOUBLE AS score, CASE WHEN edge THEN 2 ELSE 1 END AS priority, CASE WHEN edge AND score > 0.85 THEN 'Very strong connection' WHEN edge THEN 'Possible connection' ELSE 'Somewhat possible connection' END AS tier FROM s WHERE score >= 0.3""")
def _tiers(spark, d):
    w = _words(spark, d)
    grams = w.select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - 2)), lambda i: F.substring("word", i, F.lit(3))))).alias("query"))
    pairs = grams.join(w.where((F.length("word") == 3) & (F.ascii("word") % 5 == 0)).select(F.col("word").alias("query")), "query")
    rows = pairs.withColumn("ft", (F.ascii("word") % 10) / 10).withColumn("meaning", (F.length("word") % 7) / 700)
    return E.search_tiers(rows, "query", "word", "meaning", "ft", 0.3).select("query", "word", F.round("score", 6).alias("score"), "priority", "tier")


@query("n58_exact_candidates", """
WITH r AS (SELECT p_name AS word, ['cluster', 'residual', 'dictionary', 'hypothesis'][p_size % 4 + 1] AS kind, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_type || p_partkey END AS definition, p_size / 50 AS quality FROM part), s AS (SELECT * FROM r WHERE trim(definition) <> ''),
e AS (SELECT word, 'dictionary_exact' AS analysis, definition, 200.0::DOUBLE AS score, true AS suppressed FROM s WHERE kind = 'dictionary' QUALIFY row_number() OVER (PARTITION BY word ORDER BY quality DESC, definition) = 1),
a AS (SELECT word, 'whole_word_anchor', definition, 150 + quality, length(word) > 8 FROM s WHERE kind IN ('cluster', 'residual') QUALIFY row_number() OVER (PARTITION BY word ORDER BY quality DESC, definition) = 1) SELECT * FROM e UNION ALL SELECT * FROM a""")
def _exact(spark, d):
    kind = F.get(F.array(*map(F.lit, ("cluster", "residual", "dictionary", "hypothesis"))), (F.col("p_size") % 4).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_name").alias("word"), kind.alias("kind"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.concat("p_type", F.col("p_partkey").cast("string"))).alias("definition"), (F.col("p_size") / 50).alias("quality"))
    return E.exact_candidates(rows, False, 8)


@query("n48_sentence_matches", f"""
WITH t AS (SELECT item_id AS sentence, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), x AS (SELECT sentence, j - 1 AS word_index, lower(w[j]) AS word FROM (SELECT sentence, w, unnest(range(1, len(w) + 1)) AS j FROM t)), {_W}, c AS (SELECT word AS ngram, length(word) % 5 AS cluster_id FROM w WHERE length(word) <= 3),
g AS (SELECT sentence, word_index, i AS start, i + n AS "end", substr(word, i + 1, n) AS ngram FROM (SELECT *, unnest(range(0, greatest(0, length(word) - n + 1))) AS i FROM x, range(1, 8) r(n))) SELECT sentence, word_index::INT AS word_index, start::INT AS start, "end"::INT AS "end", ngram, cluster_id::INT AS cluster_id FROM g JOIN c USING (ngram)""")
def _matches(spark, d):
    sentences = table(spark, d, "benchmark").select(F.col("item_id").alias("sentence"), words(F.col("text")).alias("words"))
    clusters = _words(spark, d).where("length(word) <= 3").select(F.col("word").alias("ngram"), (F.length("word") % 5).alias("cluster_id"))
    return E.sentence_matches(sentences, clusters)


@query("n18_tuned_clusters")
def _tuned(spark, d):
    from ..operators.tuning import tuned_clusters

    rows = table(spark, d, "embeddings").withColumn("key", F.concat_ws("-", "label", F.expr("vec_id div 1000")))  # some hundred vectors each
    out = tuned_clusters(rows, "key", "vec_id", "embedding")
    return out.select("key", "method", "parameter", F.round("score", 6).alias("score"), "cluster", F.array_join(F.array_sort("members"), ",").alias("members"))
