"""Queries of decompositions, glosses and their scores.

A part's name, brand and type stand for a word cut into morphs; a morph's vector is made of its length and of its first and last letters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import glosses as G
from ..operators import composition as C
from ..operators.enrichment import sections
from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


_P = """p AS (SELECT p_partkey AS id, upper(replace(p_name, ' ', '')) AS word, string_split(upper(p_name), ' ') || [substr(p_brand, 7)] || CASE WHEN p_size % 3 = 0 THEN [substr(p_type, 1, 1)] ELSE [] END || CASE WHEN p_size % 6 = 0 THEN [substr(p_type, 2, 1)] ELSE [] END AS m, p_size AS n, p_retailprice AS price FROM part),
v AS (SELECT *, list_transform(m, lambda x: [length(x) - 3.5, ascii(x) - 68.5, ascii(right(x, 1)) - 70.5]) AS v FROM p)"""
_COS = "(CASE WHEN sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) > 0 THEN list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) + {2}) ELSE 0 END)"


def _cos(a: str, b: str, eps: float = 0.0) -> str:
    return _COS.format(a, b, eps)


def _parts(spark, d):
    p = table(spark, d, "part")
    m = F.expr("concat(split(upper(p_name), ' '), array(substring(p_brand, 7)), if(p_size % 3 = 0, array(substring(p_type, 1, 1)), array()), if(p_size % 6 = 0, array(substring(p_type, 2, 1)), array()))")
    p = p.select(F.col("p_partkey").alias("id"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("word"), m.alias("m"), F.col("p_size").alias("n"), F.col("p_retailprice").alias("price"))
    return p.withColumn("v", F.transform("m", lambda x: F.array(F.char_length(x) - 3.5, F.ascii(x) - 68.5, F.ascii(F.substring(x, -1, 1)) - 70.5)))


@query("m7_reconstruction_error", f"""
WITH {_P}, e AS (SELECT id, v[1] AS a, v[2] AS b FROM v)
SELECT id, round(CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) = 0 THEN 1 ELSE 1 - greatest(-1, least(1, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) + 1e-9))) END, 6)::DOUBLE AS cosine_error,
  round(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) / 3, 6)::DOUBLE AS squared_error FROM e""")
def _error(spark, d):
    a, b = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    return _parts(spark, d).select("id", F.round(C.reconstruction_error(a, b), 6).alias("cosine_error"), F.round(C.reconstruction_error(a, b, "mse"), 6).alias("squared_error"))


@query("m10_parse_score", f"""
WITH {_P}, x AS (SELECT id, list_sum(list_transform(m, lambda x: length(x) / 10)) AS t, [list_avg(list_transform(v, lambda z: z[1])), list_avg(list_transform(v, lambda z: z[2])), list_avg(list_transform(v, lambda z: z[3]))] AS c, v[1] AS g,
  list_sum(list_transform(m, lambda x: length(x) * (ascii(x) % 7) / 7)) / list_sum(list_transform(m, lambda x: length(x))) AS conf FROM v)
SELECT id, round(0.5 * t + 0.3 * {_cos('g', 'c', 1e-9)} + 0.2 * conf, 6)::DOUBLE AS composite FROM x""")
def _parse(spark, d):
    score = C.parse_score(F.transform("m", lambda x: F.char_length(x) / 10), F.array(F.get("v", F.lit(0))), F.col("v"), F.transform("m", lambda x: (F.ascii(x) % 7) / 7), C.lengths(F.col("m")), 3)
    return _parts(spark, d).select("id", F.round(score, 6).alias("composite"))


@query("m11_multi_segment_bonus", f"""
WITH {_P} SELECT id, round(CASE WHEN n % 4 < 2 AND len(m) >= 2 THEN 0.25 * len(list_distinct(list_transform(m, lambda x: lower(x)))) / len(m) / len(m) ELSE 0 END, 6)::DOUBLE AS bonus FROM p""")
def _bonus(spark, d):
    full = F.when(F.col("n") % 4 < 2, 1.0).otherwise(0.9)
    return _parts(spark, d).select("id", F.round(C.multi_segment_bonus(F.col("m"), full, 1 - full), 6).alias("bonus"))


@query("m15_size_penalty", """
WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), s AS (SELECT p_type, count(*) AS k, avg(n) AS a, stddev_pop(n) AS sd FROM c GROUP BY p_type)
SELECT p_type, round(CASE WHEN k < 3 THEN (3 - k) / 3 WHEN k > 35 THEN (k - 35) / 35 ELSE 0 END + 1.3 * CASE WHEN a < 6 THEN (6 - a) / 6 WHEN a > 18 THEN (a - 18) / 18 ELSE 0 END + 0.4 * sd / a, 6)::DOUBLE AS penalty FROM s""")
def _sizes(spark, d):
    sizes = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n")).groupBy("p_type").agg(F.collect_list("n").alias("sizes"))
    return sizes.select("p_type", F.round(C.size_penalty(F.col("sizes")), 6).alias("penalty"))


@query("m22_length_variance", f"""
WITH {_P} SELECT id, round(CASE WHEN len(m) > 1 THEN list_aggregate(list_transform(m, lambda x: length(x)), 'var_pop') ELSE 0 END, 6)::DOUBLE AS variance FROM p""")
def _variance(spark, d):
    return _parts(spark, d).select("id", F.round(C.length_variance(F.col("m")), 6).alias("variance"))


@query("n31_strategies", f"""
WITH {_P}, s AS (SELECT id, m, ['prefer-fewer', 'Prefer-Known', 'prefer-balance', 'none'][n % 4 + 1] AS strategy, list_transform(m, lambda x: length(x)) AS l FROM p)
SELECT id, strategy, round(CASE lower(strategy) WHEN 'prefer-fewer' THEN -0.5 * len(m) WHEN 'prefer-known' THEN 0.3 * len(list_filter(m, lambda x: ascii(x) % 9 > 5)) WHEN 'prefer-balance' THEN 0.5 * list_sum(list_transform(l, lambda x: x * x)) / list_sum(l) ** 2 - 0.2 * CASE WHEN len(m) > 1 THEN list_aggregate(l, 'var_pop') ELSE 0 END ELSE 0 END, 6)::DOUBLE AS bonus FROM s""")
def _strategies(spark, d):
    p = _parts(spark, d).withColumn("strategy", F.get(F.array(*map(F.lit, ("prefer-fewer", "Prefer-Known", "prefer-balance", "none"))), F.col("n") % 4))
    return p.select("id", "strategy", F.round(C.strategy_bonus(F.col("strategy"), F.col("m"), F.transform("m", lambda x: F.ascii(x) % 9)), 6).alias("bonus"))


@query("m24_numeric_penalty", f"""
WITH {_P} SELECT id, 4.0::DOUBLE * len(list_filter(m, lambda x: length(x) > 1 AND ascii(x) % 3 = 0)) AS penalty FROM p""")
def _numeric(spark, d):
    return _parts(spark, d).select("id", C.numeric_penalty(F.col("word"), F.col("m"), F.transform("m", lambda x: F.when(F.ascii(x) % 3 == 0, F.char_length(x)))).alias("penalty"))


@query("m20_anchor_strength", f"""
WITH {_P}, x AS (SELECT id, unnest(m) AS morph, n FROM p), g AS (SELECT morph, count(*) AS k, avg((id % 10) / 10) AS q FROM x GROUP BY morph)
SELECT morph, round(greatest(0, least(1, 0.45 * least(1, ln(1 + length(morph)) / ln(7)) + 0.35 / k + 0.2 * q)), 6)::DOUBLE AS strength FROM g""")
def _anchor(spark, d):
    rows = _parts(spark, d).select("id", F.explode("m").alias("morph")).groupBy("morph").agg(F.count(F.lit(1)).alias("k"), F.avg((F.col("id") % 10) / 10).alias("q"))
    return rows.select("morph", F.round(C.anchor_strength(F.col("morph"), F.array("q"), F.col("k")), 6).alias("strength"))


@query("m21_band_similarity", f"""
WITH {_P}, x AS (SELECT id, v, i, j FROM v, range(1, 6) a(i), range(1, 6) b(j) WHERE i < j AND j <= len(v))
SELECT id, round(avg(greatest(0, least(1, 1 - abs({_cos('v[i]', 'v[j]')} - 0.45) / 0.2))), 6)::DOUBLE AS similarity FROM x GROUP BY id""")
def _band(spark, d):
    return _parts(spark, d).select("id", F.round(C.band_similarity(F.col("v")), 6).alias("similarity"))


@query("m23_coverage_confidence", "SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(1, 0.35 + 0.5 * l_discount * 10 - 0.2 * l_tax * 10)), 6)::DOUBLE AS confidence FROM lineitem")
def _confidence(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(C.coverage_confidence(F.col("l_discount") * 10, F.col("l_tax") * 10), 6).alias("confidence"))


@query("m25_candidate_quality", """
WITH x AS (SELECT doc_id, list_filter([n_chars % 10 / 10, CASE WHEN n_chars % 3 > 0 THEN n_chars % 7 / 7 END, CASE WHEN n_chars % 5 = 0 THEN 0.5 END], lambda z: z IS NOT NULL) AS q, n_chars % 2 = 0 AS core, n_chars % 4 = 1 AS meta, n_chars % 3 AS hits, coalesce(trim(text), '') <> '' AS said FROM documents)
SELECT doc_id, round(greatest(0, coalesce(list_avg(q), 0) + CASE WHEN core THEN 0.12 ELSE 0 END + CASE WHEN said AND NOT meta THEN 0.08 ELSE 0 END - 0.18 * hits - CASE WHEN meta AND NOT core THEN 0.12 ELSE 0 END), 6)::DOUBLE AS quality FROM x""")
def _quality(spark, d):
    n = F.col("n_chars")
    metrics = F.array((n % 10) / 10, F.when(n % 3 > 0, (n % 7) / 7), F.when(n % 5 == 0, 0.5))
    return table(spark, d, "documents").select("doc_id", F.round(C.candidate_quality(metrics, n % 2 == 0, F.col("text"), n % 4 == 1, n % 3, n % 4 == 1), 6).alias("quality"))


@query("n34_bundles", f"""
WITH {_P}, b AS (SELECT id, len(m) AS k, list_avg(list_transform(m, lambda x: ascii(x) % 5 / 5)) AS q, len(list_filter(m, lambda x: length(x) > 1)) AS lex, len(list_filter(m, lambda x: length(x) = 1)) AS fun, m[1] AS head, n % 5 = 0 AS meta FROM p),
c AS (SELECT *, greatest(0, least(1, 0.35 * q + 0.45 * lex / k + 0.2 + CASE WHEN lex > 0 AND fun > 0 THEN 0.05 ELSE 0 END)) AS coherence FROM b)
SELECT id, round(coherence, 6)::DOUBLE AS coherence, round(CASE WHEN meta THEN -0.35 ELSE 0.75 * coherence END, 6)::DOUBLE AS bonus FROM c""")
def _bundles(spark, d):
    lexical, single = F.size(F.filter("m", lambda x: F.char_length(x) > 1)), F.size(F.filter("m", lambda x: F.char_length(x) == 1))
    p = _parts(spark, d).withColumn("coherence", C.bundle_coherence(F.transform("m", lambda x: (F.ascii(x) % 5) / 5), lexical, single, F.lit(True)))
    return p.select("id", F.round("coherence", 6).alias("coherence"), F.round(C.bundle_bonus(F.col("coherence"), F.get("m", F.lit(0)), F.col("n") % 5 == 0), 6).alias("bonus"))


_SPEC = "CASE WHEN len(list_filter(m, lambda x: length(x) = 1)) > 0 OR len(m) >= 3 THEN greatest(0, 0.38 * (n % 11) / 10 + 0.28 * (n % 4) / 3 + 0.42 * motif + 0.12 / len(m) + least(0.2, greatest(0, len(m) - 2) * 0.05) - 0.08 * len(list_filter(m, lambda x: length(x) = 1))) ELSE 0 END"
_PROFILE = "greatest(0, least(1, 0.3 * least(1, (CASE WHEN ascii(m[1]) % 2 = 0 THEN 1 ELSE 0 END)) + 0.5 * least(1, hits / greatest(1, len(m) - 1)) + CASE WHEN hits >= 2 THEN 0.2 ELSE 0 END))"


def _profiled(spark, d):
    hits = F.size(F.filter(F.slice("m", 2, 9), lambda x: F.ascii(x) % 2 == 1))
    return _parts(spark, d).withColumn("motif", C.profile_score(F.when(F.ascii(F.get("m", F.lit(0))) % 2 == 0, 1).otherwise(0), F.lit(1), hits, F.size("m") - 1))


@query("m19_profile_score", f"""
WITH {_P}, h AS (SELECT id, m, len(list_filter(m[2:], lambda x: ascii(x) % 2 = 1)) AS hits FROM p) SELECT id, round({_PROFILE}, 6)::DOUBLE AS score FROM h""")
def _profile(spark, d):
    return _profiled(spark, d).select("id", F.round("motif", 6).alias("score"))


@query("m18_speculative_score", f"""
WITH {_P}, h AS (SELECT *, len(list_filter(m[2:], lambda x: ascii(x) % 2 = 1)) AS hits FROM p), k AS (SELECT *, {_PROFILE} AS motif FROM h) SELECT id, round({_SPEC}, 6)::DOUBLE AS score FROM k""")
def _speculative(spark, d):
    p = _profiled(spark, d)
    return p.select("id", F.round(C.speculative_score(F.col("m"), (F.col("n") % 11) / 10, (F.col("n") % 4) / 3, F.col("motif"), 1 / F.size("m")), 6).alias("score"))


@query("n36_speculative_branches", f"""
WITH {_P}, h AS (SELECT *, len(list_filter(m[2:], lambda x: ascii(x) % 2 = 1)) AS hits FROM p), k AS (SELECT *, {_PROFILE} AS motif FROM h), s AS (SELECT word, id, round({_SPEC}, 6)::DOUBLE AS score FROM k)
SELECT word, id, score, row_number() OVER (PARTITION BY word ORDER BY score DESC, id)::INT AS place FROM s WHERE score >= 0.7 QUALIFY place <= 5""")
def _branches(spark, d):
    p = _profiled(spark, d)
    scored = p.select("word", "id", F.round(C.speculative_score(F.col("m"), (F.col("n") % 11) / 10, (F.col("n") % 4) / 3, F.col("motif"), 1 / F.size("m")), 6).alias("score"))
    return C.speculative_branches(scored, order="id")


@query("n30_definition_coherence", f"""
WITH {_P}, x AS (SELECT id, avg(greatest(0, least(1, 1 - abs({_cos('v[i]', 'v[j]')} - 0.35) / 0.65))) AS c FROM v, range(1, 6) a(i), range(1, 6) b(j) WHERE i < j AND j <= len(v) GROUP BY id),
s AS (SELECT id, len(m) AS k, list_sum(list_transform(m, lambda x: length(x))) AS total, len(list_filter(m, lambda x: length(x) = 1)) AS singles, list_avg(list_transform(m, lambda x: CASE WHEN ascii(x) % 4 = 0 THEN 0.2 ELSE (0.7 * 2 / (2 + ascii(x) % 4) + 0.3 * (1 - (ascii(x) % 4) / (1 + ascii(x) % 4))) * least(1, ln(3 + ascii(x) % 4) / ln(6)) END)) AS base FROM p)
SELECT s.id, round(greatest(-1, least(1, base + 0.3 * c - CASE WHEN total >= 5 AND singles >= 3 THEN 0.02 * (singles - 2) + CASE WHEN c < 0.2 THEN 0.05 * (0.2 - c) ELSE 0 END ELSE 0 END)), 6)::DOUBLE AS coherence FROM s JOIN x USING (id)""")
def _coherence(spark, d):
    # a morph has 1 definition, or 2 to 5 of which two are alike
    def one(x):
        k = F.ascii(x) % 4
        return C.definition_score(F.when(k == 0, 1).otherwise(2), F.when(k == 0, 1).otherwise(k + 1), F.when(k == 0, 1).otherwise(k + 2))

    return _parts(spark, d).select("id", F.round(C.definition_coherence(F.col("m"), F.transform("m", one), F.col("v")), 6).alias("coherence"))


@query("n30_semantic_coherence", f"""
WITH {_P}, z AS (SELECT id, m, v, i, j FROM v, range(1, 6) a(i), range(1, 6) b(j) WHERE i < j AND j <= len(v)),
q AS (SELECT id, avg({_cos('v[i]', 'v[j]')}) FILTER (length(m[i]) = 1 AND length(m[j]) = 1) AS near, avg({_cos('v[i]', 'v[j]')}) FILTER (length(m[i]) > 1 AND length(m[j]) > 1) AS far FROM z GROUP BY id),
c AS (SELECT p.id, len(list_filter(m, lambda x: length(x) = 1)) AS s, len(list_filter(m, lambda x: length(x) > 1)) AS l, len(m) AS k, CASE WHEN near >= 0.3 THEN least(1, near / 0.3) ELSE near / 0.3 * 0.5 END AS good, CASE WHEN far <= 0.7 THEN 1 - far / 0.7 ELSE 0 END AS apart FROM p JOIN q USING (id))
SELECT id, round(CASE WHEN s >= 2 AND l >= 2 THEN s / k * good + l / k * apart WHEN s >= 2 THEN good WHEN l >= 2 THEN apart ELSE 0.5 END, 6)::DOUBLE AS coherence FROM c""")
def _semantic(spark, d):
    pieces = F.zip_with("m", "v", lambda m, v: F.struct(m.alias("morph"), v.alias("vector")))
    return _parts(spark, d).select("id", F.round(C.semantic_coherence(pieces), 6).alias("coherence"))


@query("n41_convergence", """
WITH t AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, coalesce(trim(text), '') AS text FROM embeddings JOIN documents ON doc_id = vec_id), k AS (SELECT label, vec_id // 10 AS debate, v, text FROM t WHERE text <> '' AND text NOT LIKE '[ERROR]%'),
n AS (SELECT label, debate, row_number() OVER (PARTITION BY label, debate) AS r, v, text FROM k), s AS (SELECT a.label, a.debate, avg(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) AS sim FROM n a JOIN n b ON a.label = b.label AND a.debate = b.debate AND a.r < b.r GROUP BY ALL)
SELECT g.label, g.debate, coalesce(sim >= 0.3 AND long >= 120, false) AS agreed FROM (SELECT label, vec_id // 10 AS debate FROM t GROUP BY ALL) g LEFT JOIN (SELECT label, debate, avg(length(text)) AS long FROM k GROUP BY ALL) USING (label, debate) LEFT JOIN s USING (label, debate)""")
def _converged(spark, d):
    t = table(spark, d, "embeddings").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select("label", F.expr("vec_id div 10").alias("debate"), F.struct("text", F.col("embedding").cast("array<double>").alias("v")).alias("x"))
    g = t.groupBy("label", "debate").agg(F.collect_list("x").alias("x"))
    return g.select("label", "debate", C.converged(F.col("x.text"), F.col("x.v"), 0.3).alias("agreed"))


@query("n42_label_band", """
WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL), k AS (SELECT label, list(x ORDER BY i) AS c FROM c GROUP BY label),
s AS (SELECT vec_id, k.label, round(list_dot_product(embedding::DOUBLE[], c) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(c, c))), 9) AS sim FROM embeddings e, k)
SELECT vec_id, label, round(sim, 6) AS sim FROM s QUALIFY sim >= 0.2 AND sim >= max(sim) OVER (PARTITION BY vec_id) - 0.1""")
def _labels(spark, d):
    from ..functions.vectors import cosine
    from ..operators.vectors import mean_vectors

    e = table(spark, d, "embeddings")
    centers = mean_vectors(e, "label", "embedding").agg(F.collect_list(F.struct("label", F.col("vec").alias("c"))).alias("all"))  # a vector for each label, in one row
    rows = e.join(F.broadcast(centers)).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.explode("all").alias("x"))
    rows = rows.select("vec_id", "x.label", F.round(cosine(F.col("v"), F.col("x.c")), 9).alias("sim"))
    return C.within_band(rows, "vec_id", least=0.2, band=0.1).select("vec_id", "label", F.round("sim", 6).alias("sim"))


_GLOSSES = ("a river", "Top residuals: nacro:1.00", "[UNKNOWN]", "the prefix of verbs", "root meaning 'river'", "digits 19", "number '7' of stars", "OX denotes motion", "", "to be, to exist", "to  carry water", "of the sea", "and", "they", "which is sung, often", "old word for the number 456")
_GLOSS = f"[{', '.join(repr(g).replace(chr(34), chr(39)) if chr(39) not in g else chr(39) + g.replace(chr(39), chr(39) * 2) + chr(39) for g in _GLOSSES)}][n_chars % {len(_GLOSSES)} + 1]"
_SQUEEZE = "trim(regexp_replace(g, '\\s+', ' ', 'g'))"


def _glossed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.get(F.array(*map(F.lit, _GLOSSES)), (F.col("n_chars") % len(_GLOSSES)).cast("int")).alias("g"), "n_chars")


@query("x24_gloss_kinds", f"""
WITH d AS (SELECT doc_id, {_GLOSS} AS g FROM documents), k AS (SELECT *, lower({_SQUEEZE}) AS low FROM d)
SELECT doc_id, starts_with(low, 'top residuals:') OR regexp_full_match(trim(g), '\\[[A-Z][A-Z'' ?-]*\\]') AS placeholder,
  low <> '' AND CASE WHEN regexp_matches(low, '(?:^|[^a-z0-9_])(?:{"|".join(sorted(G.META, key=len, reverse=True))})(?:[^a-z0-9_]|$)') THEN NOT regexp_matches(low, '["''`].{{1,48}}?["''`]') ELSE regexp_matches(trim(g), '^[A-Z][A-Z0-9''-]* +(?:denotes|encodes|signifies)(?:[^a-zA-Z0-9_]|$)') OR starts_with(low, 'a root ') OR starts_with(low, 'the root ') OR starts_with(low, 'root denoting ') END AS meta FROM k""")
def _kinds(spark, d):
    return _glossed(spark, d).select("doc_id", G.is_placeholder(F.col("g")).alias("placeholder"), G.is_meta(F.col("g")).alias("meta"))


@query("x26_digit_count", f"""
WITH d AS (SELECT doc_id, {_GLOSS} AS g FROM documents) SELECT doc_id, nullif(length(regexp_extract({_SQUEEZE}, '(?i)(?:^|[^a-zA-Z0-9_])(?:digits?|numbers?|numerals?) *[''"]?([0-9]+)', 1)), 0)::INT AS digits FROM d""")
def _digits(spark, d):
    return _glossed(spark, d).select("doc_id", G.digit_count(F.col("g")).alias("digits"))


_TOKENS = "regexp_extract_all(lower(g), '[a-z]+')"
_NOT = "[" + ", ".join(f"'{w}'" for w in G.NOT_HEADS) + "]"


@query("x22_headwords", f"""
WITH d AS (SELECT doc_id, {_GLOSS} AS g FROM documents), t AS (SELECT doc_id, CASE WHEN {_TOKENS}[1] = 'to' AND len({_TOKENS}) > 1 THEN {_TOKENS}[2:] ELSE {_TOKENS} END AS t FROM d), h AS (SELECT doc_id, list_filter(t, lambda x: NOT list_contains({_NOT}, x))[1] AS h FROM t)
SELECT doc_id, h AS headword, CASE WHEN length(h) > 4 AND h LIKE '%ies' THEN left(h, length(h) - 3) || 'y' WHEN h LIKE '%sses' THEN left(h, length(h) - 2) WHEN length(h) > 3 AND h LIKE '%s' AND h NOT LIKE '%ss' AND h NOT LIKE '%us' THEN left(h, length(h) - 1) ELSE h END AS singular FROM h""")
def _heads(spark, d):
    rows = _glossed(spark, d).select("doc_id", G.headword(F.col("g")).alias("headword"))
    return rows.withColumn("singular", G.singular(F.col("headword")))


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("x23_parts_of_speech", f"""
WITH d AS (SELECT doc_id, {_GLOSS} AS g FROM documents), t AS (SELECT doc_id, g, lower(trim(g)) AS low, {_TOKENS} AS t FROM d), c AS (SELECT *, starts_with(low, 'to be') OR list_contains({_list(G.COPULAS)}, low) AS cop FROM t),
k AS (SELECT *, list_filter([CASE WHEN cop THEN 'AUX' END, CASE WHEN regexp_matches(low, '^to +[a-z]') AND NOT cop THEN 'VERB' END, CASE WHEN list_contains({_list(G.PREPOSITIONS)}, t[1]) AND len(t) <= 3 THEN 'ADP' END, CASE WHEN len(t) = 1 AND list_contains({_list(G.COORDINATORS)}, t[1]) THEN 'CCONJ' END, CASE WHEN len(t) = 1 AND list_contains({_list(G.PRONOUNS)}, t[1]) THEN 'PRON' END], lambda x: x IS NOT NULL) AS tags FROM c),
f AS (SELECT *, CASE WHEN len(tags) > 0 THEN tags ELSE ['NOUN'] END AS full_tags, len(t) > 0 AND (contains(g, ',') OR contains(g, ' / ') OR contains(g, ';') OR list_has_any(t, {_list(G.PHRASE_WORDS)}) OR len(t) > 2) AS compound FROM k)
SELECT doc_id, array_to_string(CASE WHEN low = '' THEN ['NOUN'] WHEN compound THEN ['PHRASE'] || full_tags ELSE full_tags END, ',') AS tags FROM f""")
def _tags(spark, d):
    return _glossed(spark, d).select("doc_id", F.array_join(G.parts_of_speech(F.col("g")), ",").alias("tags"))


@query("x27_enhanced_definitions", """
SELECT item_id, lower(array_to_string(list_transform(string_split(text, '. '), lambda x: trim(x)), ' ')) || '.' || CASE WHEN item_id % 3 > 0 THEN ' usage: ' || lower(array_to_string(list_transform(list_filter(string_split(text, ', '), lambda x: x <> ''), lambda x: '`' || trim(x) || '`'), ', ')) ELSE '' END AS enhanced FROM benchmark""")
def _enhanced(spark, d):
    uses = F.when(F.col("item_id") % 3 > 0, F.split("text", ", ")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "benchmark").select("item_id", G.enhanced_definition(F.split("text", r"\. "), uses).alias("enhanced"))


@query("x28_sections", """
WITH t AS (SELECT page_id, i, string_split(html, '><')[i] AS l FROM (SELECT page_id, html, unnest(range(1, len(string_split(html, '><')) + 1)) AS i FROM pages)),
k AS (SELECT page_id, i, CASE WHEN starts_with(l, 'p>') THEN 'NOTE' WHEN starts_with(l, 'a ') THEN 'LINK' END AS key, l FROM t), o AS (SELECT *, last_value(key IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS own FROM k)
SELECT page_id, own AS section, len(string_split(string_agg(l, chr(10) ORDER BY i), chr(10))) AS n_lines, sha256(string_agg(l, chr(10) ORDER BY i)) AS digest FROM o WHERE own IS NOT NULL GROUP BY ALL""")
def _sections(spark, d):
    lines = F.transform(F.split("html", "><"), lambda x: F.when(x.startswith("p>"), F.concat(F.lit("NOTE: "), F.replace(x, F.lit("\n"), F.lit(" ")))).when(x.startswith("a "), F.concat(F.lit("LINK: "), F.replace(x, F.lit("\n"), F.lit(" ")))).otherwise(x))
    found = sections(table(spark, d, "pages").select("page_id", F.array_join(lines, "\n").alias("t")), "page_id", "t")
    return found.select("page_id", "section", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.sha2("text", 256).alias("digest"))
