"""Queries of phrases, decisions between readings and groups of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import decision as D
from ..operators import phrases as P
from ..operators import vectors as V
from ..operators.donors import resolve
from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _pick(col, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(col) % len(values) + 1).cast("int"))


_ROLES = ("noun", "verb", "modifier", "relational", "unknown", "noun")
_PROFILES = ("plain", "conjunction", "plain", "relative", "plain", "imperative_existential", "plain", "plain", "locative", "plain", "plain")
_CHUNKS = ("and", "her light", "in her", "her fire", "", "in", "and", "that", "that", "in her")
_sql = lambda v, c: f"[{', '.join(repr(x) for x in v)}][({c} % {len(v)} + 1)::INT]"


@query("n39_token_relations", f"""
WITH t AS (SELECT user_id, event_id, {_sql(_ROLES, 'event_id')} AS role, {_sql(_PROFILES, 'event_id')} AS profile FROM events),
n AS (SELECT *, lead(event_id) OVER w AS next, lead(role) OVER w AS nr, lead(profile) OVER w AS np FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT *, CASE WHEN profile = 'conjunction' THEN 1 WHEN np IN ('relative', 'locative') THEN 2 WHEN profile = 'imperative_existential' THEN 3 WHEN role = 'relational' THEN 4 WHEN nr = 'relational' THEN 5
  WHEN role = 'modifier' AND nr IN ('noun', 'verb') THEN 6 WHEN role = 'verb' AND nr IN ('noun', 'unknown') THEN 7 WHEN role IN ('noun', 'unknown') AND nr = 'verb' THEN 8 WHEN role = 'noun' AND nr = 'noun' THEN 9 ELSE 10 END AS k FROM n WHERE next IS NOT NULL)
SELECT user_id, event_id, next, CASE WHEN k IN (1, 9, 10) THEN 'coordination/apposition' WHEN k IN (2, 4, 5) THEN 'relational_attachment' WHEN k = 6 THEN 'head-modifier' ELSE 'predicate-argument' END AS relation,
  CASE WHEN k IN (5, 8) THEN 'right_to_left' ELSE 'left_to_right' END AS direction, [0.9, 1.3, 1.4, 1.2, 1.2, 0.9, 1.1, 0.8, 0.4, 0.1][k]::DOUBLE AS score FROM k""")
def _relations(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", _pick("event_id", *_ROLES).alias("role"), _pick("event_id", *_PROFILES).alias("profile"))
    return P.relations(t, "user_id", "event_id")


@query("n60_clause_skeleton", f"""
WITH t AS (SELECT user_id, event_id, {_sql(_CHUNKS, 'event_id')} AS c FROM events), u AS (SELECT * FROM t WHERE c <> ''),
s AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM u), e AS (SELECT *, CASE WHEN p IN ('her', 'in her') AND c LIKE 'her %' THEN trim(substr(c, 5)) ELSE c END AS x FROM s),
k AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY event_id) AS px FROM e)
SELECT a.user_id, coalesce(draft, '') AS draft FROM (SELECT DISTINCT user_id FROM events) a LEFT JOIN (SELECT user_id, string_agg(x, ' ' ORDER BY event_id) AS draft FROM k WHERE px IS NULL OR x <> px OR x NOT IN ('and', 'that', 'in', 'her') GROUP BY 1) b ON a.user_id = b.user_id""")
def _skeleton(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", _pick("event_id", *_CHUNKS).alias("c"))
    own = t.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "c"))).alias("c"))
    return own.select("user_id", P.skeleton(F.transform("c", lambda x: x["c"])).alias("draft"))


@query("n59_clause_composition", """
SELECT user_id, round(avg(value), 6) AS confidence, string_agg(event_type, '; ' ORDER BY event_id) AS text, count(*) AS n FROM events GROUP BY 1""")
def _composition(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("confidence"), F.col("event_type").alias("text"))
    return P.compose(rows, "user_id", "event_id").withColumn("confidence", F.round("confidence", 6))


@query("n35_decision_score", """
SELECT p_partkey, round(p_size / 50 + 0.22 * (p_size % 7) / 7 + 0.14 * (p_partkey % 3) / 3 + 0.08 * (p_partkey % 5) / 5 + 0.05 * (p_size % 2) - 0.08 * (p_partkey % 4) / 4 + coalesce(0.06 * CASE WHEN p_partkey % 2 = 0 THEN (p_size % 11) / 11 END, 0), 6) AS score FROM part""")
def _decision(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    parts = {"base": s / 50, "semantic": (s % 7) / 7, "attestation": (k % 3) / 3, "fnp": (k % 5) / 5, "profile": s % 2, "singleton": (k % 4) / 4, "grouped": F.when(k % 2 == 0, (s % 11) / 11)}
    return table(spark, d, "part").select("p_partkey", *[v.alias(n) for n, v in parts.items()]).select("p_partkey", F.round(D.decision_score(), 6).alias("score"))


_PAIRS = [("the", "and"), ("de", "la"), ("der", "die"), ("of", "in")]


_EDGE = "(?:^|[^\\p{{L}}\\p{{N}}_]){0}(?:[^\\p{{L}}\\p{{N}}_]|$)"


@query("n33_contradictions", "SELECT doc_id, least(0.5, 0.2 * (" + " + ".join(f"(regexp_matches(lower(coalesce(text, '')), '{_EDGE.format(a)}') AND regexp_matches(lower(coalesce(text, '')), '{_EDGE.format(b)}'))::INT" for a, b in _PAIRS) + "))::DOUBLE AS penalty FROM documents")
def _contradictions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(D.contradiction(F.col("text"), _PAIRS), 6).alias("penalty"))


@query("n25_group_status", """
WITH g AS (SELECT p_brand, count(*) AS packets, avg((p_size % 20) / 20 + 0.3) AS confidence, avg((p_partkey % 5 = 0)::INT) AS exceptions, avg((p_partkey % 7 = 0)::INT) AS risks, max(p_size) AS top FROM part GROUP BY 1),
f AS (SELECT *, p_brand LIKE '%3' AS split, p_brand LIKE '%#1%' AS mixed FROM g)
SELECT p_brand, CASE WHEN split THEN 'split_recommended' WHEN exceptions >= 0.25 OR risks >= 0.25 OR mixed OR confidence < 0.65 THEN 'needs_review' WHEN packets = 1 AND confidence >= 0.85 AND top > 10 THEN 'stable' WHEN packets >= 2 AND confidence >= 0.78 AND top / 50 >= 0.75 THEN 'stable' ELSE 'provisional' END AS status FROM f""")
def _status(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg((s % 20) / 20 + 0.3).alias("c"), F.avg((k % 5 == 0).cast("int")).alias("e"), F.avg((k % 7 == 0).cast("int")).alias("r"), F.max("p_size").alias("top"))
    return g.select("p_brand", D.group_status(F.col("n"), F.col("c"), F.col("e"), F.col("r"), F.col("top") / 50, F.col("p_brand").endswith("3"), F.col("p_brand").contains("#1"), F.col("top") > 10).alias("status"))


@query("n24_effect_likeness", """
WITH w AS (SELECT p_partkey AS k, list_distinct(string_split(p_name, ' ')) AS w FROM part),
s AS (SELECT a.k, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS x FROM w a JOIN w b ON b.k = a.k + 1)
SELECT k, round(x, 6) AS likeness, x < 0.45 AS diverges FROM s""")
def _likeness(spark, d):
    w = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_distinct(F.split("p_name", " ")).alias("w"))
    both = w.join(w.select((F.col("k") - 1).alias("k"), F.col("w").alias("v")), "k").select("k", D.jaccard(F.col("w"), F.col("v")).alias("x"))
    return both.select("k", F.round("x", 6).alias("likeness"), (F.col("x") < D.GROUPS["effect"]).alias("diverges"))


@query("a30_votes", """
WITH s AS (SELECT user_id, event_type AS label, sum(event_id % 3 + 1)::BIGINT AS votes, bool_or(event_id % 5 = 0) AS cited, min(event_id) AS first_seen FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, cited DESC, first_seen) AS k FROM s) SELECT user_id, label, votes FROM r WHERE k = 1""")
def _votes(spark, d):
    e = F.col("event_id")
    return D.votes(table(spark, d, "events").select("user_id", F.col("event_type").alias("label"), (e % 3 + 1).alias("votes"), (e % 5 == 0).alias("cited"), e.alias("at")), "user_id")


@query("a18_first_mode", """
WITH s AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_seen) AS k FROM s) SELECT user_id, event_type FROM r WHERE k = 1""")
def _mode(spark, d):
    return D.first_mode(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("w9_provenance", """
WITH s AS (SELECT DISTINCT l_orderkey, l_returnflag, list_position(['R', 'A'], l_returnflag) AS k FROM lineitem) SELECT l_orderkey, arg_min(l_returnflag, k) AS source FROM s WHERE k > 0 GROUP BY 1""")
def _provenance(spark, d):
    return D.provenance(table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("source")), "l_orderkey", ["R", "A"])


@query("j20_labelled_union", """
WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'semantic' ELSE 'index' END AS source FROM a FULL JOIN b ON a.k = b.k""")
def _labelled(spark, d):
    return D.labelled_union(table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k", ("both", "semantic", "index"))


@query("t10_distinct_groups", """
WITH g AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS m FROM orders GROUP BY 1) SELECT min(o_custkey) AS o_custkey, len(m) AS n FROM g GROUP BY m""")
def _groups(spark, d):
    return D.distinct_groups(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("a24_shared_prefixes", "SELECT substr(p_name, 1, 3) AS prefix, count(DISTINCT p_brand) AS groups FROM part WHERE length(p_name) >= 3 GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def _prefixes(spark, d):
    return D.shared_prefixes(table(spark, d, "part"), "p_brand", "p_name")


@query("t8_top_with_ties", """
WITH b AS (SELECT p_brand, p_type, max(p_size / 50) AS score FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS below FROM b WINDOW w AS (PARTITION BY p_brand ORDER BY score DESC, p_type))
SELECT p_brand, p_type, round(score, 6) AS score, rank, coalesce(score - below < 0.05, false) AS tie FROM r WHERE rank <= 5""")
def _top(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_type", (F.col("p_size") / 50).alias("score"))
    return D.top_with_ties(rows, "p_brand", "p_type", "score", 5).withColumn("score", F.round("score", 6))


@query("x15_clauses", r"""
WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[;:,]'), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '[A-Za-z]')) AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(c) AS n, md5(array_to_string(c, '|')) AS digest FROM c""")
def _clauses(spark, d):
    own = table(spark, d, "documents").where("text is not null").select("doc_id", X.clauses(F.col("text")).alias("c"))
    return own.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("digest"))


@query("x17_edit_distance", "SELECT a.p_partkey AS k, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _edit(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name")
    return p.join(p.select((F.col("k") - 1).alias("k"), F.col("p_name").alias("other")), "k").select("k", F.levenshtein("p_name", "other").cast("long").alias("distance"))


@query("n12_kmeans")
def _kmeans(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return V.kmeans(rows, "vec_id", 10)


@query("n8_donor_resolution")
def _donors(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(X.words(F.lower("text"))).alias("w")).distinct()
    hosts = words.where("char_length(w) > 3").select(F.col("w").alias("host"), F.substring("w", -2, 2).alias("target"))
    roots = words.where("char_length(w) < 6").select(F.col("w").alias("donor"), F.when(F.char_length("w") < 4, "dictionary").otherwise("sqlite").alias("source"))
    return resolve(hosts, roots)
