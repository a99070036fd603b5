"""Queries of evidence lookups: parts stand for clusters, orders for residual details, line items for definitions of clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vectors import cosine
from ..operators import lookups as L
from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


# payloads of definitions in the forms that they come in
_PAYLOAD = """CASE p_partkey % 8 WHEN 0 THEN '{"DEFINITION": "' || p_name || '", "REJECTED": "Yes"}' WHEN 1 THEN '```json' || chr(10) || '{"definition": " ' || p_type || ' ", "rejected": false}' || chr(10) || '```' WHEN 2 THEN ' ' || p_name || ' ' WHEN 3 THEN '' WHEN 4 THEN '{"DEFINITION": "", "x": 1}' WHEN 5 THEN '{"raw_text": "{\\"DEFINITION\\": \\"' || p_brand || '\\", \\"REJECTED\\": true}"}' WHEN 6 THEN NULL ELSE '{"evaluation": "good", "DEFINITION": "' || p_type || '"}' END"""
_DEF = """pl AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, {0} AS payload FROM part),
b AS (SELECT *, CASE WHEN regexp_extract(payload, '(?s)```(?:json)?\\s*(\\{{.*\\}})\\s*```', 1) <> '' THEN regexp_extract(payload, '(?s)```(?:json)?\\s*(\\{{.*\\}})\\s*```', 1) ELSE trim(payload) END AS body0 FROM pl),
b1 AS (SELECT *, CASE WHEN starts_with(body0, '{{') AND json_extract_string(CASE WHEN json_valid(body0) THEN body0 END, '$.raw_text') IS NOT NULL THEN json_extract_string(CASE WHEN json_valid(body0) THEN body0 END, '$.raw_text') ELSE body0 END AS body FROM b),
def AS (SELECT *, CASE WHEN starts_with(body, '{{') THEN nullif(trim(coalesce(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.DEFINITION'), json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.definition'))), '') ELSE nullif(body, '') END AS definition,
  coalesce(starts_with(body, '{{') AND lower(trim(coalesce(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.REJECTED'), json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.rejected')))) IN ('1', 'true', 'yes', 'y'), false) AS rejected FROM b1)""".format(_PAYLOAD)


def _payloads(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey") % 8
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) and not y.startswith("p_") else F.col(y) for y in x])
    payload = (
        F.when(k == 0, c('{"DEFINITION": "', "p_name", '", "REJECTED": "Yes"}')).when(k == 1, c('```json\n{"definition": " ', "p_type", ' ", "rejected": false}\n```')).when(k == 2, c(" ", "p_name", " "))
        .when(k == 3, F.lit("")).when(k == 4, F.lit('{"DEFINITION": "", "x": 1}')).when(k == 5, c('{"raw_text": "{\\"DEFINITION\\": \\"', "p_brand", '\\", \\"REJECTED\\": true}"}')).when(k == 6, F.lit(None))
        .otherwise(c('{"evaluation": "good", "DEFINITION": "', "p_type", '"}'))
    )
    return p.withColumn("payload", payload)


@query("f10_definition_payloads", f"WITH {_DEF} SELECT p_partkey, definition, rejected FROM def")
def _definitions(spark, d):
    return _payloads(spark, d).select("p_partkey", L.definition_payload(F.col("payload")).alias("x")).select("p_partkey", "x.*")


@query("f11_evaluations", """
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{"EVALUATION": "' || p_type || '"}' WHEN 1 THEN 'it says "Evaluation" : "' || p_brand || '" and more' WHEN 2 THEN 'nothing' ELSE '{"other": 1}' END AS s FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN json_extract_string(s, '$.EVALUATION') WHEN 1 THEN regexp_extract(s, '"(?i:evaluation)"\\s*:\\s*"([^"]+)"', 1) END AS evaluation FROM t""")
def _evaluations(spark, d):
    k = F.col("p_partkey") % 4
    s = F.when(k == 0, F.concat(F.lit('{"EVALUATION": "'), "p_type", F.lit('"}'))).when(k == 1, F.concat(F.lit('it says "Evaluation" : "'), "p_brand", F.lit('" and more'))).when(k == 2, "nothing").otherwise('{"other": 1}')
    return table(spark, d, "part").select("p_partkey", L.evaluation(s).alias("evaluation"))


@query("f12_fragments", """
WITH t AS (SELECT o_orderkey, o_orderpriority AS p, o_orderkey % 4 AS k FROM orders), x AS (SELECT o_orderkey, CASE k WHEN 0 THEN [p, 'b-' || p] WHEN 1 THEN [p] WHEN 2 THEN [] ELSE [] END AS f FROM t)
SELECT o_orderkey, array_to_string(list_filter(list_transform(f, lambda y: lower(regexp_replace(y, '[^A-Za-z]', '', 'g'))), lambda z: z <> ''), ',') AS fragments FROM x""")
def _fragments(spark, d):
    k = F.col("o_orderkey") % 4
    payload = F.when(k == 0, F.to_json(F.array("o_orderpriority", F.concat(F.lit("b-"), "o_orderpriority")))).when(k == 1, F.concat(F.lit('[{"text": "", "residual": "'), "o_orderpriority", F.lit('"}, {"other": 3}]'))).when(k == 2, "{broken")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(L.fragments(payload), ",").alias("fragments"))


@query("f5_latest_run", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders ORDER BY o_orderdate DESC, o_custkey DESC LIMIT 1)")
def _latest(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return L.of_run(rows.drop("created_at"), rows).select("o_orderkey", F.col("run_id").alias("o_custkey"))


@query("f9_evidence_mode", "SELECT p_partkey FROM part WHERE p_size % 2 = 0")
def _mode(spark, d):
    return L.evidence_mode(table(spark, d, "part").withColumn("kind", F.when(F.col("p_size") % 2 == 0, "residual").otherwise("cluster")), "residuals-only").select("p_partkey")


@query("f13_search_filter", "WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'the letter ' || p_name WHEN 1 THEN 'An Aethyr' ELSE p_name || ' newsletter' END AS g, p_size / 50 AS s FROM part) SELECT p_partkey FROM x WHERE p_partkey % 5 > 1 AND s >= 0.3")
def _filtered(spark, d):
    k = F.col("p_partkey") % 5
    rows = table(spark, d, "part").withColumn("g", F.when(k == 0, F.concat(F.lit("the letter "), "p_name")).when(k == 1, "An Aethyr").otherwise(F.concat("p_name", F.lit(" newsletter")))).withColumn("s", F.col("p_size") / 50)
    return L.searchable(rows, "g", "s", 0.3).select("p_partkey")


@query("f14_segments_of_token", "SELECT l_orderkey AS run_id, l_linenumber AS seg_index, l_partkey AS morph, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)::INT AS place FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lower(p_name) = lower((SELECT p_name FROM part WHERE p_partkey = 7))")
def _segments(spark, d):
    wanted = table(spark, d, "part").where("p_partkey = 7").first()["p_name"]  # a point lookup
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("seg_index"), F.col("l_partkey").alias("morph"), F.col("p_name").alias("token"), "l_extendedprice")
    return L.segments_of(rows, F.lit(wanted)).select("run_id", "seg_index", "morph", F.row_number().over(Window.orderBy("run_id", "seg_index", "morph", "l_extendedprice")).alias("place"))


_DETAILS = """dt AS (SELECT o_orderkey AS residual_id, o_custkey AS cluster_id, (floor(o_totalprice)::BIGINT % 100) / 100 AS residual_ratio, o_orderkey % 3 AS n, o_orderpriority AS f FROM orders)"""


@query("f17_singleton_candidates", f"""
WITH {_DETAILS}, t AS (SELECT * FROM dt JOIN customer ON c_custkey = cluster_id WHERE residual_ratio >= 0.35 AND n = 1 ORDER BY residual_ratio DESC, residual_id LIMIT 500)
SELECT residual_id, cluster_id, upper(trim(f)) AS fragment, residual_ratio, upper(c_mktsegment) AS root FROM t""")
def _singletons(spark, d):
    n = F.col("o_orderkey") % 3
    one = F.concat(F.lit('{"text": "'), "o_orderpriority", F.lit('"}'))
    payload = F.when(n == 0, "[]").when(n == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]")))
    details = table(spark, d, "orders").select(F.col("o_orderkey").alias("residual_id"), F.col("o_custkey").alias("cluster_id"), ((F.floor("o_totalprice") % 100) / 100).alias("residual_ratio"), payload.alias("uncovered_json"))
    return L.singleton_candidates(details, table(spark, d, "customer").select(F.col("c_custkey").alias("cluster_id"), F.col("c_mktsegment").alias("ngram")))


@query("f18_acceptable", f"WITH {_DEF} SELECT p_partkey FROM def WHERE definition IS NOT NULL AND NOT rejected")
def _acceptable(spark, d):
    return _payloads(spark, d).where(L.acceptable(F.col("payload"))).select("p_partkey")


@query("f19_flagged_morphs", f"WITH {_DEF} SELECT upper(trim(p_name)) AS morph, bool_or(definition IS NULL OR rejected) AS flagged FROM def GROUP BY 1")
def _flagged(spark, d):
    return L.flagged(_payloads(spark, d), "p_name", "payload")


@query("a15_accepted_definitions", f"WITH {_DEF} SELECT p_brand AS morph, lower(definition) AS definition, count(*) AS n, max(p_retailprice) AS score FROM def WHERE definition IS NOT NULL AND NOT rejected GROUP BY ALL")
def _accepted(spark, d):
    return L.accepted_definitions(_payloads(spark, d), "p_brand", "payload", "p_retailprice")


@query("j2_attested", "SELECT p_partkey AS cluster_id, l_orderkey, l_linenumber, l_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey")
def _attested(spark, d):
    return L.attested(table(spark, d, "part").select(F.col("p_partkey").alias("cluster_id")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("cluster_id"), "l_orderkey", "l_linenumber", "l_suppkey"))


def _profiles(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("root"), F.col("p_size").cast("long").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))


@query("j3_root_profiles", "SELECT s_suppkey, p_size::BIGINT AS profile_cluster, n FROM supplier LEFT JOIN (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) ON p_brand = 'Brand#' || (s_suppkey % 30)")
def _fan(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string")).alias("root"))
    return L.root_profiles(s, _profiles(spark, d), ["n"]).select("s_suppkey", "profile_cluster", "n")


@query("j4_cluster_profiles", "SELECT s_suppkey, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) ON p_brand = 'Brand#' || (s_suppkey % 30) AND p_size = s_suppkey % 60")
def _own(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string")).alias("root"), (F.col("s_suppkey") % 60).alias("cluster_id"))
    return L.root_profiles(s, _profiles(spark, d), ["n"], True).select("s_suppkey", "n")


@query("j8_unnested_evidence", "SELECT event_id, i AS place, item FROM (SELECT event_id, unnest([event_type, 'user ' || user_id]) AS item, unnest([0, 1])::INT AS i FROM events WHERE event_id % 3 > 0)")
def _unnested(spark, d):
    payload = F.when(F.col("event_id") % 3 > 0, F.to_json(F.struct(F.array("event_type", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("EVIDENCE")))).otherwise('{"EVIDENCE": []}')
    return L.unnested_evidence(table(spark, d, "events").withColumn("payload", payload), "event_id", "payload")


@query("j12_remaining", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 10)")
def _remaining(spark, d):
    return L.remaining(table(spark, d, "nation").select("n_nationkey"), table(spark, d, "supplier").where("s_suppkey < 10").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey")


_WORDS = "w AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark)"


def _bench_words(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.transform(words(F.col("text")), F.upper)).alias("word")).distinct()


@query("j15_substring_evidence", f"""
WITH {_WORDS}, e AS (SELECT upper(substr(word, 1, 3)) AS morph, count(*) AS n FROM w WHERE length(word) >= 3 GROUP BY 1),
s AS (SELECT word, i AS start, substr(word, i + 1, 3) AS morph FROM (SELECT word, unnest(range(0, length(word) - 2)) AS i FROM w WHERE length(word) >= 3)) SELECT word, start, morph, variant, n FROM s JOIN e USING (morph), (VALUES ('debate'), ('solo')) v(variant)""")
def _slices(spark, d):
    w = _bench_words(spark, d)
    e = w.where("length(word) >= 3").groupBy(F.substring("word", 1, 3).alias("morph")).agg(F.count(F.lit(1)).alias("n")).select("morph", "n", F.explode(F.array(F.lit("solo"), F.lit("debate"))).alias("variant"))
    return L.substring_evidence(w, e, 3, 3).withColumn("start", F.col("start").cast("long"))


@query("j16_alias_evidence", "SELECT s.n_name AS morph, 'NATION_' || (s.n_nationkey % 10) AS lookup, c AS n FROM nation s JOIN (SELECT 'NATION_' || n_nationkey AS m, count(*) AS c FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) ON m = 'NATION_' || (s.n_nationkey % 10)")
def _aliases(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.col("n_name").alias("surface"), F.concat(F.lit("NATION_"), (F.col("n_nationkey") % 10).cast("string")).alias("lookup"))
    e = n.join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("morph")).agg(F.count(F.lit(1)).alias("n"))
    return L.alias_evidence(a, e)


@query("j18_packet_pairs", """
WITH e AS (SELECT vec_id, label || '-' || (vec_id // 500) AS label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.label AS root, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS sim FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.05""")
def _packets(spark, d):
    e = table(spark, d, "embeddings").select(F.concat_ws("-", "label", F.expr("vec_id div 500")).alias("root"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return L.packet_pairs(e, "root", "vec_id", lambda a, b: cosine(F.col(f"{a}.v"), F.col(f"{b}.v")), 0.05).withColumn("sim", F.round("sim", 6))


@query("j19_enriched", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _enriched(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderkey").alias("nth"))
    return L.enriched(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "nth")


_DICT = "di AS (SELECT DISTINCT lower(word) AS normalized FROM w WHERE length(word) <= 4)"


def _dictionary(spark, d):
    return _bench_words(spark, d).where("length(word) <= 4").select(F.lower("word").alias("normalized")).distinct()


@query("j22_dictionary_morphs", f"""
WITH {_WORDS}, {_DICT}, s AS (SELECT word, lower(substr(word, i + 1, n)) AS normalized, min(i) AS start FROM (SELECT word, n, unnest(range(0, greatest(0, length(word) - n + 1))) AS i FROM w, range(1, 5) r(n)) GROUP BY ALL)
SELECT word, upper(normalized) AS morph, start FROM s JOIN di USING (normalized)""")
def _morphs(spark, d):
    return L.dictionary_morphs(_bench_words(spark, d), _dictionary(spark, d)).select("word", "morph", F.col("start").cast("long").alias("start"))


@query("j21_word_evidence", f"""
WITH {_WORDS}, {_DICT}, k AS (SELECT word, 'dictionary' AS kind, normalized AS text FROM w JOIN di ON normalized = lower(word) UNION ALL SELECT word, 'cluster', 'c' || length(word) FROM w WHERE ascii(word) % 3 = 0)
SELECT * FROM k UNION ALL SELECT word, 'neighbour', substr(word, 1, 2) FROM w WHERE word NOT IN (SELECT word FROM k)""")
def _evidence(spark, d):
    w = _bench_words(spark, d)
    sources = {"dictionary": _dictionary(spark, d).select(F.upper("normalized").alias("word"), F.col("normalized").alias("text")), "cluster": w.where(F.ascii("word") % 3 == 0).select("word", F.concat(F.lit("c"), F.length("word").cast("string")).alias("text"))}
    return L.word_evidence(w, sources, w.select("word", F.substring("word", 1, 2).alias("text")))


@query("j24_queue_missing", """
WITH q AS (SELECT p_name AS ngram, row_number() OVER (ORDER BY p_name) - 1 AS queue_index, 2 AS cycles FROM (SELECT DISTINCT p_name FROM part WHERE p_size < 10)), n AS (SELECT DISTINCT p_name AS ngram FROM part WHERE p_name NOT IN (SELECT ngram FROM q))
SELECT * FROM q UNION ALL SELECT ngram, (SELECT coalesce(max(queue_index), -1) FROM q) + row_number() OVER (ORDER BY ngram), 0 FROM n""")
def _queue(spark, d):
    p = table(spark, d, "part")
    q = p.where("p_size < 10").select(F.col("p_name").alias("ngram")).distinct().withColumn("queue_index", F.row_number().over(Window.orderBy("ngram")).cast("long") - 1).withColumn("cycles", F.lit(2).cast("long"))
    return L.queue_missing(q, p.select(F.col("p_name").alias("ngram")))


@query("j26_nearest_known", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS item, b.vec_id AS near, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id AND b.vec_id % 2 = 0 WHERE a.vec_id % 50 = 0)
SELECT item, near, round(sim, 6) AS sim, row_number() OVER (PARTITION BY item ORDER BY sim DESC, near)::INT AS place FROM p WHERE sim >= 0.1 QUALIFY place <= 10""")
def _nearest(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vec"))
    return L.nearest_known(e.where("item % 50 = 0"), e, e.where("item % 2 = 0").select("item"), least=0.1)  # a set of queries against all that is known.withColumn("sim", F.round("sim", 6))


@query("j28_bridge", """
WITH p AS (SELECT p_brand AS root, p_type AS name, sum(p_size)::BIGINT AS weight FROM part GROUP BY ALL), r AS (SELECT p_brand AS root, p_name AS name, count(*) AS weight FROM part GROUP BY ALL), b AS (SELECT DISTINCT p_brand AS root FROM part WHERE p_size > 25)
SELECT root, 'partner' AS kind, name, weight, row_number() OVER (PARTITION BY root ORDER BY weight DESC, name)::INT AS place FROM p JOIN b USING (root) QUALIFY place <= 6
UNION ALL SELECT root, 'residual', name, weight, row_number() OVER (PARTITION BY root ORDER BY weight DESC, name)::INT AS place FROM r JOIN b USING (root) QUALIFY place <= 5""")
def _bridge(spark, d):
    p = table(spark, d, "part")
    partners = p.groupBy(F.col("p_brand").alias("root"), F.col("p_type").alias("name")).agg(F.sum("p_size").alias("weight"))
    residuals = p.groupBy(F.col("p_brand").alias("root"), F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("weight"))
    return L.bridge(p.where("p_size > 25").select(F.col("p_brand").alias("root")).distinct(), partners, residuals)


@query("j29_window_glosses", """
WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), x AS (SELECT item_id, i, w[i] AS token FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM t))
SELECT item_id, coalesce(string_agg(token || ' ' || length(token), ' ' ORDER BY i) FILTER (length(token) > 4), '') AS glosses FROM x GROUP BY item_id""")
def _windows(spark, d):
    b = table(spark, d, "benchmark").select("item_id", words(F.lower("text")).alias("tokens"))
    g = b.select(F.explode("tokens").alias("token")).distinct().where("length(token) > 4").select("token", F.array("token", F.length("token").cast("string")).alias("words"))
    return L.window_glosses(b.withColumnRenamed("item_id", "window"), g).select(F.col("window").alias("item_id"), F.array_join("glosses", " ").alias("glosses"))


@query("a19_group_rank", "SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, 0.25 * l_quantity / 50 + 0.2 * l_discount * 10 + 0.15 * l_tax * 10 + 0.15 * l_linenumber / 7 + 0.1 * 0.5 + 0.1 * l_quantity / 100 + 0.05 * (l_partkey % 2) - 0.2 * (l_suppkey % 2)), 6)::DOUBLE AS rank FROM lineitem")
def _rank(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(L.group_rank(c("l_quantity") / 50, c("l_discount") * 10, c("l_tax") * 10, c("l_linenumber") / 7, F.lit(0.5), c("l_quantity") / 100, c("l_partkey") % 2, c("l_suppkey") % 2), 6).alias("rank"))


@query("a26_anchors", "SELECT upper(p_name) AS morph, count(*) AS uses, round(avg(p_size / 50), 6) AS cohesion FROM part GROUP BY 1 HAVING count(*) >= 3 AND avg(p_size / 50) >= 0.4")
def _anchors(spark, d):
    return L.anchors(table(spark, d, "part").withColumn("c", F.col("p_size") / 50), "p_name", "c").withColumn("cohesion", F.round("cohesion", 6))


@query("a28_review_counts", "SELECT count(*) AS total, count_if(p_size > 25) AS large, count_if(p_name LIKE '% ring') AS rings FROM part")
def _review(spark, d):
    return L.review_counts(table(spark, d, "part"), large=F.col("p_size") > 25, rings=F.col("p_name").endswith(" ring"))


@query("w12_first_of_tier", "SELECT p_partkey, p_type AS tier FROM part WHERE p_type IN ('PROMO', 'ECONOMY') QUALIFY row_number() OVER (PARTITION BY p_type, lower(p_name) ORDER BY p_retailprice DESC, p_partkey) = 1")
def _tiers(spark, d):
    return L.first_of_tier(table(spark, d, "part").withColumn("tier", F.col("p_type")), ["PROMO", "ECONOMY"], "p_name", [F.desc("p_retailprice"), "p_partkey"]).select("p_partkey", "tier")


@query("t6_best_candidates", "SELECT o_custkey, o_orderkey, round(o_totalprice / 1000 + o_orderkey % 5, 6) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 1000 + o_orderkey % 5, 9) DESC, o_orderkey)::INT AS place FROM orders QUALIFY place <= 3")
def _candidates(spark, d):
    return L.best_candidates(table(spark, d, "orders"), "o_custkey", F.col("o_totalprice") / 1000, F.col("o_orderkey") % 5, 3, "o_orderkey").select("o_custkey", "o_orderkey", F.round("total", 6).alias("total"), "place")


@query("t7_best_candidate", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders WHERE o_orderkey % 4 >= 2 GROUP BY o_custkey")
def _best(spark, d):
    return L.best_candidate(table(spark, d, "orders").withColumn("n", F.col("o_orderkey") % 4), "o_custkey", "o_totalprice", "n", 2, "o_orderkey")


@query("t9_queue_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_size % 3, p_partkey)::INT AS place FROM part")
def _order(spark, d):
    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.orderBy(F.col("p_size") % 3, "p_partkey")).alias("place"))


@query("t12_distinct_entries", "SELECT lower(p_name) AS canonical, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def _entries(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_name").alias("canonical")).agg(F.min("p_partkey").alias("p_partkey"))


@query("t2_first_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n <= 100")
def _first(spark, d):
    return table(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(100).select("l_orderkey", "l_linenumber", "l_partkey")


@query("u2_key_union", "WITH t AS (SELECT s_nationkey AS k, count(*) AS tf FROM supplier GROUP BY 1), d AS (SELECT c_nationkey AS k, count(*) AS df FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) SELECT coalesce(t.k, d.k) AS k, coalesce(tf, 0) AS tf, coalesce(df, 0) AS df FROM t FULL JOIN d ON t.k = d.k")
def _union(spark, d):
    t = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("tf"))
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("df"))
    return t.join(c, "k", "full_outer").fillna(0, ["tf", "df"])


@query("u5_merged_pool", "SELECT k, max(s) AS s FROM (SELECT o_custkey AS k, o_totalprice AS s FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_totalprice / 2 FROM orders WHERE o_orderkey % 3 = 0) GROUP BY k")
def _pool(spark, d):
    o = table(spark, d, "orders")
    return L.merged_pool(o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("s")), o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"), (F.col("o_totalprice") / 2).alias("s")), key=["k"], score="s")


@query("n44_chosen_notes", "WITH x AS (SELECT p_brand AS root, p_type AS partner, avg(p_size) / 50 AS delta_partner, avg(p_partkey % 10) / 20 AS delta_root, count(*) AS n_tokens FROM part GROUP BY ALL) SELECT root, partner, round(delta_partner - delta_root, 6) AS dominance FROM x WHERE n_tokens >= 3 AND delta_partner - delta_root >= 0.05 AND delta_partner >= 0.2 QUALIFY row_number() OVER (PARTITION BY root ORDER BY delta_partner - delta_root DESC, partner) = 1")
def _notes(spark, d):
    x = table(spark, d, "part").groupBy(F.col("p_brand").alias("root"), F.col("p_type").alias("partner")).agg((F.avg("p_size") / 50).alias("delta_partner"), (F.avg(F.col("p_partkey") % 10) / 20).alias("delta_root"), F.count(F.lit(1)).alias("n_tokens"))
    return L.chosen_note(x, "root", 0.05, 0.2, 3).select("root", "partner", F.round("dominance", 6).alias("dominance"))


@query("n45_seed_snapshots", "SELECT p_brand AS ngram, count(*) AS tf, array_to_string(list_sort(list_distinct(list(p_name)))[1:8], ',') AS canonicals, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) THEN 'has 50' END AS gloss FROM part GROUP BY p_brand")
def _seeds(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_brand", "ngram")
    out = L.seed_snapshots(p.groupBy("ngram").agg(F.count(F.lit(1)).alias("tf")), p.select("ngram", F.col("p_name").alias("canonical")), p.where("p_size = 50").select("ngram", F.lit("has 50").alias("gloss")).distinct())
    return out.withColumn("canonicals", F.array_join("canonicals", ","))


@query("k14_finished", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'skipped' ELSE 'completed' END AS status FROM orders")
def _finished(spark, d):
    return L.finished(table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "skipped").otherwise("pending").alias("status")))


@query("k16_skip_rows", "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'small' ELSE 'cheap' END AS reason_code FROM part WHERE p_size < 5 OR p_retailprice < 950")
def _skips(spark, d):
    return L.skip_rows(table(spark, d, "part"), {"small": F.col("p_size") < 5, "cheap": F.col("p_retailprice") < 950}).select("p_partkey", "reason_code")


@query("k17_noted", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'a,B' WHEN 1 THEN 'c,b' ELSE 'c' END AS partners, CASE n_nationkey % 3 WHEN 1 THEN 'note of b' ELSE '' END AS notes, n_nationkey % 3 = 1 AS changed FROM nation")
def _noted(spark, d):
    k = F.col("n_nationkey") % 3
    rows = table(spark, d, "nation").select("n_nationkey", F.when(k == 0, F.array(F.lit("a"), F.lit("B"))).otherwise(F.array(F.lit("c"))).alias("partners"), F.array().cast("array<string>").alias("notes"))
    notes = table(spark, d, "nation").where("n_nationkey % 3 < 2").select("n_nationkey", F.lit("b").alias("partner"), F.lit("note of b").alias("note"))
    return L.noted(rows, notes, "n_nationkey").select("n_nationkey", F.array_join("partners", ",").alias("partners"), F.array_join("notes", ",").alias("notes"), "changed")


@query("k18_lookup_text", """SELECT p_name || ': ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' [' || p_brand || '; x]' ELSE '' END AS text, '{"p_name":"' || p_name || '","p_type":"' || p_type || '","c":[' || CASE WHEN p_size % 2 = 0 THEN '"' || p_brand || '","x"' ELSE '' END || ']}' AS json FROM part""")
def _lookup(spark, d):
    p = table(spark, d, "part").withColumn("c", F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return L.lookup_text(p, "p_name", "p_type", "c").select("text", "json")


@query("y10_exported", """SELECT n_regionkey, '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS items FROM nation GROUP BY n_regionkey""")
def _exported(spark, d):
    return L.exported(table(spark, d, "nation"), ["n_regionkey"], "n_nationkey", ["n_nationkey", "n_name"])


@query("y11_diagonals", "WITH c AS (SELECT conv_id, turn AS r, length(role) AS k, role FROM conversations), x AS (SELECT *, 'falling' AS direction, k - r AS diagonal FROM c UNION ALL SELECT *, 'rising', k + r FROM c) SELECT conv_id, direction, diagonal::BIGINT AS diagonal, string_agg(role, ',' ORDER BY r, role) AS items FROM x GROUP BY ALL")
def _diagonals(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("r"), F.length("role").cast("long").alias("k"), "role")
    x = L.diagonals(c, "conv_id", "r", "k").groupBy("conv_id", "direction", "diagonal").agg(F.array_sort(F.collect_list(F.struct("r", "role"))).alias("x"))
    return x.select("conv_id", "direction", "diagonal", F.array_join(F.transform("x", lambda y: y["role"]), ",").alias("items"))


@query("y13_merged_maps", "SELECT event_id, event_type || ',' || CASE WHEN event_id % 2 = 0 THEN 'even' ELSE user_id::VARCHAR END AS shown FROM events")
def _maps(spark, d):
    a = F.create_map(F.lit("type"), F.col("event_type"), F.lit("by"), F.col("user_id").cast("string"))
    b = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("by"), F.lit("even")))
    return table(spark, d, "events").select("event_id", F.array_join(F.map_values(L.merged_maps(a, b)), ",").alias("shown"))


@query("j25_index_lookup", "SELECT DISTINCT lower(p_brand) AS ngram, p_name AS canonical FROM part WHERE lower(p_brand) IN (SELECT 'brand#' || (s_suppkey % 40) FROM supplier)")
def _indexed(spark, d):
    wanted = table(spark, d, "supplier").select(F.concat(F.lit("BRAND#"), (F.col("s_suppkey") % 40).cast("string")).alias("ngram"))
    return L.index_lookup(wanted, table(spark, d, "part").select(F.col("p_brand").alias("ngram"), F.col("p_name").alias("canonical")))


@query("j27_seed_history", "SELECT l_partkey AS ngram, o_orderkey AS run_id, o_orderpriority AS stage, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate, o_orderkey)::INT AS place FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey")
def _history(spark, d):
    seeds = table(spark, d, "lineitem").select(F.col("l_partkey").alias("ngram"), F.col("l_orderkey").alias("run_id")).distinct()
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("stage"), F.col("o_orderdate").alias("created_at"))
    return L.seed_history(seeds, runs).select("ngram", "run_id", "stage", "place")


@query("n46_memo_join", """
WITH p AS (SELECT conv_id, turn, sha256(upper(trim(regexp_replace(replace(text, 'ß', 'SS'), '\\s+', ' ', 'g')))) AS k FROM conversations), m AS (SELECT k, arg_min('answer ' || conv_id, conv_id) AS response FROM p WHERE conv_id % 2 = 0 GROUP BY k)
SELECT conv_id, turn, response, response IS NOT NULL AS known FROM p LEFT JOIN m USING (k)""")
def _memo(spark, d):
    from ..functions.text import canonical_space
    from ..operators.store import memoised

    p = table(spark, d, "conversations").select("conv_id", "turn", F.sha2(canonical_space(F.col("text")), 256).alias("prompt_hash"))
    memo = p.where("conv_id % 2 = 0").select("prompt_hash", F.concat(F.lit("answer "), F.col("conv_id").cast("string")).alias("response"), F.col("conv_id").alias("created_at"))
    return memoised(p, memo).select("conv_id", "turn", "response", "known")
