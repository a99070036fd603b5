"""Queries over the relational tables, ``events``, ``embeddings`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.vectors import cosine
from ..operators import graph, scoring, store
from ..operators import vectors as V
from ..operators.factorize import ridge
from ..operators.residual import weighted_coverage
from ..sources.tables import table
from ..streaming.events import running_lexicon, windowed

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _vec(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


_PLACES = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM e),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / size) AS u FROM n WHERE size > 0),
c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(u[i]) AS x FROM u, range(1, 65) t(i) GROUP BY ALL) GROUP BY label)"""


@query("n13_centroid_similarity", f"""
WITH {_PLACES}, s AS (SELECT vec_id, u.label, greatest(0, least(1, list_dot_product(u, c) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(c, c))))) AS sim FROM u JOIN c ON u.label = c.label)
SELECT vec_id, label, round(sim, 6) AS sim, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s""")
def _centroids(spark, d):
    return V.centroid_similarity(_vec(spark, d), "vec_id", "label").select("vec_id", "label", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("n20_cluster_cohesion", """
WITH v AS (SELECT p_partkey AS id, p_brand AS k, [p_size % 2, (p_size + 1) % 2, (p_partkey % 3 = 0)::INT]::DOUBLE[] AS v FROM part), p AS (SELECT a.k, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c FROM v a JOIN v b ON a.k = b.k AND a.id < b.id)
SELECT k, coalesce(round(avg(c) FILTER (c <> 0), 3), 0)::DOUBLE AS cohesion FROM v LEFT JOIN p USING (k) GROUP BY k""")
def _nonzero(spark, d):
    from ..operators.composition import cluster_cohesion

    v = table(spark, d, "part").select(F.col("p_brand").alias("k"), F.array((F.col("p_size") % 2).cast("double"), ((F.col("p_size") + 1) % 2).cast("double"), (F.col("p_partkey") % 3 == 0).cast("double")).alias("v"))
    return cluster_cohesion(v, "k", "v")


@query("n20_cohesion", """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.label, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS cohesion FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def _cohesion(spark, d):
    return V.cohesion(_vec(spark, d), "label").select("label", F.round("cohesion", 6).alias("cohesion"))


@query("n17_alignment", f"""
WITH {_PLACES}, s AS (SELECT vec_id, c.label, round(list_dot_product(u, c) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(c, c))), 9) AS sim FROM u, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS k FROM s) SELECT vec_id, label, round(sim, 6) AS sim FROM r WHERE k = 1""")
def _alignment(spark, d):
    from ..functions.vectors import unit

    own = _vec(spark, d).select("vec_id", "label", unit(F.col("vec")).alias("vec"))
    return V.best_alignment(own, "vec_id", V.mean_vectors(own, "label")).select("vec_id", "label", F.round("sim", 6).alias("sim"))


@query("n10_attribution", """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 65) t(i) GROUP BY ALL) GROUP BY label),
t AS (SELECT a.label AS a, b.label AS b, e.v AS p, a.m AS va, b.m AS vb FROM e JOIN m a ON a.label = e.label JOIN m b ON b.label = e.label + 1),
s AS (SELECT *, list_transform(list_zip(p, vb), lambda z: z[1] - z[2]) AS pb, list_transform(list_zip(p, va), lambda z: z[1] - z[2]) AS pa FROM t),
q AS (SELECT *, sqrt(list_dot_product(p, p)) AS np, sqrt(list_dot_product(va, va)) AS na, sqrt(list_dot_product(vb, vb)) AS nb, sqrt(list_dot_product(pa, pa)) AS npa, sqrt(list_dot_product(pb, pb)) AS npb FROM s)
SELECT a, b, round(avg(list_dot_product(p, va) / (np * na + 1e-9) - list_dot_product(pb, va) / (npb * na + 1e-9)), 6) AS delta_a,
  round(avg(list_dot_product(p, vb) / (np * nb + 1e-9) - list_dot_product(pa, vb) / (npa * nb + 1e-9)), 6) AS delta_b, count(*) AS n FROM q GROUP BY a, b""")
def _attribution(spark, d):
    e = _vec(spark, d)
    m = V.mean_vectors(e, "label")
    pairs = e.select(F.col("label").alias("a"), (F.col("label") + 1).alias("b"), F.col("vec").alias("p")).join(m.select(F.col("label").alias("a"), F.col("vec").alias("va")), "a").join(m.select(F.col("label").alias("b"), F.col("vec").alias("vb")), "b")
    return V.leave_one_out(pairs).select("a", "b", F.round("delta_a", 6).alias("delta_a"), F.round("delta_b", 6).alias("delta_b"), "n")


@query("m4_cosine_neighbours", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def _cosine(spark, d):
    e = _vec(spark, d)
    return e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("vec").alias("x")).join(e.select(F.col("vec_id").alias("b"), F.col("vec").alias("y")), "b").select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("sim"))


@query("n14_factorization")
def _factorization(spark, d):
    e = _vec(spark, d)
    counts = e.select(F.col("vec_id").alias("token"), F.explode(F.array("label", F.lit(99))).alias("item")).groupBy("token", "item").agg(F.count(F.lit(1)).alias("n"))
    return ridge(counts, e.select(F.col("vec_id").alias("token"), "vec")).select("item", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("y9_event_properties", """
SELECT event_type, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS with_k, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY event_type""")
def _props(spark, d):
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), F.sum("k").alias("sum_k"))


@query("w2_newest_event", """
WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id FROM r WHERE k = 1""")
def _newest(spark, d):
    return store.newest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("a8_role_profile", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS most FROM c)
SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts, CASE WHEN count_if(n = most) = 1 THEN min(event_type) FILTER (n = most) ELSE 'mixed' END AS profile FROM m GROUP BY user_id""")
def _profile(spark, d):
    from ..operators.evidence import role_profile

    out = role_profile(table(spark, d, "events"), "user_id", "event_type")
    return out.select("user_id", F.array_join(F.transform("counts", lambda x: F.concat(x["role"], F.lit(":"), x["n"].cast("string"))), ",").alias("counts"), "profile")


@query("w4_min_max", """
WITH t AS (SELECT user_id, event_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id))
SELECT user_id, event_id, round(CASE WHEN hi = lo THEN 1 ELSE (value - lo) / (hi - lo) END, 6) AS scaled FROM t""")
def _min_max(spark, d):
    return scoring.min_max(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "value", "scaled").select("user_id", "event_id", F.round("scaled", 6).alias("scaled"))


@query("a14_progress", """
WITH g AS (SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL)
SELECT user_id, count(*) AS runs, max(n) AS most, bool_or(n >= 3) AS complete, bool_and(n >= 3) AS all_complete FROM g GROUP BY user_id""")
def _progress(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("most"), F.bool_or(F.col("n") >= 3).alias("complete"), F.bool_and(F.col("n") >= 3).alias("all_complete"))


@query("stream_event_windows", """
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def _windows(spark, d):
    return windowed(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("a29_running_lexicon", """
SELECT event_type AS token, round(avg(value), 6) AS conf, count(*) AS n FROM events GROUP BY 1""")
def _lexicon(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("token"), F.col("value").alias("conf"), (F.col("event_id") % 2).alias("half"))
    state = running_lexicon(spark.createDataFrame([], "token string, conf double, n long"), e.where("half = 0"))
    return running_lexicon(state, e.where("half = 1")).select("token", F.round("conf", 6).alias("conf"), "n")


@query("a16_weighted_profile", """
WITH w AS (SELECT event_type, value, greatest(0.05, (user_id % 100) / 100) AS w FROM events), m AS (SELECT event_type, sum(w * value) / sum(w) AS mean FROM w GROUP BY 1)
SELECT w.event_type, round(any_value(mean), 6) AS mean, round(sum(w * (value - mean) * (value - mean)) / sum(w), 4) AS variance FROM w JOIN m ON w.event_type = m.event_type GROUP BY 1""")
def _weighted(spark, d):
    rows = table(spark, d, "events").select("event_type", "value", F.greatest(F.lit(0.05), (F.col("user_id") % 100) / 100).alias("w"))
    m = rows.groupBy("event_type").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"))
    both = rows.join(F.broadcast(m), "event_type")  # a row for each of the few event types
    return both.groupBy("event_type").agg(F.round(F.first("mean"), 6).alias("mean"), F.round(F.sum(F.col("w") * (F.col("value") - F.col("mean")) ** 2) / F.sum("w"), 4).alias("variance"))


@query("a21_correlation", "SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r, round(median(l_discount), 6) AS mid, round(avg(l_tax), 6) AS mean_tax FROM lineitem GROUP BY 1")
def _correlation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.coalesce(F.corr("l_quantity", "l_extendedprice"), F.lit(0.0)), 6).alias("r"), F.round(F.median("l_discount"), 6).alias("mid"), F.round(F.avg("l_tax"), 6).alias("mean_tax"))


@query("a12_weighted_coverage", """
WITH c AS (SELECT l_suppkey, sum(l_discount * l_quantity) / sum(l_quantity) AS coverage FROM lineitem GROUP BY 1) SELECT l_suppkey, round(coverage, 6) AS coverage, round(1 - coverage, 6) AS residual FROM c""")
def _coverage(spark, d):
    out = weighted_coverage(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity")
    return out.select("l_suppkey", F.round("coverage", 6).alias("coverage"), F.round("residual", 6).alias("residual"))


@query("a1_basket_pairs", """
WITH b AS (SELECT DISTINCT l_orderkey, l_partkey % 50 AS p, l_quantity AS q FROM lineitem), s AS (SELECT l_orderkey, p, max(q) AS q FROM b GROUP BY ALL)
SELECT x.p AS a, y.p AS b, count(*) AS n, round(avg(x.q - y.q), 4) AS delta FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.p < y.p GROUP BY ALL HAVING count(*) >= 3""")
def _basket(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 50).alias("p")).agg(F.max("l_quantity").alias("q"))
    # a row's own pairs: an order has a handful of lines
    items = s.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("p", "q"))).alias("i"))
    pairs = F.flatten(F.transform("i", lambda x, k: F.transform(F.filter("i", lambda y: y["p"] > x["p"]), lambda y: F.struct(x["p"].alias("a"), y["p"].alias("b"), (x["q"] - y["q"]).alias("delta")))))
    return items.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x.delta"), 4).alias("delta")).where("n >= 3")


@query("j1_evidence_join", """
SELECT n.n_name, count(*) AS orders, count(DISTINCT c.c_custkey) AS customers, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1""")
def _evidence(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    out = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("c_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j6_group_having", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) <= 5")
def _having(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")).where("n <= 5")


@query("j9_zip_join", """
WITH s AS (SELECT s_nationkey AS k, list(s_suppkey ORDER BY s_suppkey) AS ids FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, list(c_custkey ORDER BY c_custkey) AS roots FROM customer GROUP BY 1)
SELECT s.k, i AS pos, ids[i + 1] AS supp, roots[i + 1] AS cust FROM (SELECT s.k, ids, roots, unnest(range(0, least(len(ids), len(roots)))) AS i FROM s JOIN c ON s.k = c.k) s""")
def _zip(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("ids"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list("c_custkey")).alias("roots"))
    # padded with nulls to the longer array; both must be there
    out = s.join(c, "k").select("k", F.posexplode(F.arrays_zip("ids", "roots")).alias("pos", "z")).where("z.ids is not null and z.roots is not null")
    return out.select("k", F.col("pos").cast("long").alias("pos"), F.col("z.ids").alias("supp"), F.col("z.roots").alias("cust"))


@query("t1_limit_then_aggregate", """
WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS top FROM t GROUP BY 1""")
def _limit(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return t.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 2).alias("top"))


@query("k1_upsert", """
WITH t AS (SELECT s_suppkey AS id, s_name AS name, 0 AS v FROM supplier), s AS (SELECT s_suppkey * 2 AS id, 'new' AS name, 1 AS v FROM supplier) SELECT id, name, v FROM s UNION ALL SELECT id, name, v FROM t WHERE id NOT IN (SELECT id FROM s)""")
def _upsert(spark, d):
    s = table(spark, d, "supplier")
    return store.upsert(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(0).alias("v")), s.select((F.col("s_suppkey") * 2).alias("id"), F.lit("new").alias("name"), F.lit(1).alias("v")), ["id"])


@query("k5_coalesce_upsert", """
WITH t AS (SELECT s_suppkey AS id, s_name AS name, 'old' AS note FROM supplier), s AS (SELECT s_suppkey * 2 AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'seen' END AS note FROM supplier)
SELECT coalesce(s.id, t.id) AS id, coalesce(s.name, t.name) AS name, CASE WHEN s.id IS NOT NULL THEN s.note ELSE t.note END AS note FROM t FULL JOIN s ON t.id = s.id""")
def _coalesce(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    new = s.select((k * 2).alias("id"), F.when(k % 2 == 0, F.lit("new")).alias("name"), F.when(k % 3 == 0, F.lit("seen")).alias("note"))
    return store.coalesce_upsert(s.select(k.alias("id"), F.col("s_name").alias("name"), F.lit("old").alias("note")), new, ["id"], ("note",))


@query("k15_increment", """
WITH t AS (SELECT n_nationkey AS k, 2 AS c FROM nation WHERE n_nationkey < 20), s AS (SELECT c_nationkey AS k, count(*) AS m FROM customer WHERE c_nationkey > 3 GROUP BY 1) SELECT coalesce(t.k, s.k) AS k, coalesce(c, 0) + coalesce(m, 0) AS c FROM t FULL JOIN s ON t.k = s.k""")
def _increment(spark, d):
    t = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.lit(2).alias("c"))
    return store.increment(t, table(spark, d, "customer").where("c_nationkey > 3").select(F.col("c_nationkey").alias("k")), "k", "c")


@query("n23_components", """
SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS component FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey) > 1""")
def _components(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    edges = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.lag("s_suppkey").over(w).alias("b")).where("b is not null")
    return graph.connect(edges)


@query("n28_weighted_score", """
WITH s AS (SELECT p_partkey, (p_size % 10) / 10 AS beam, (p_size % 7) / 7 AS quality, least(1, p_retailprice / 2000) AS coverage, (p_partkey % 5) / 5 AS acceptance, 1 / (1 + ln(1 + greatest(p_size - 1, 0))) AS specificity, CASE WHEN p_size <= 1 THEN 0 ELSE least(1, ln(1 + p_size - 1) / ln(9)) END AS ambiguity FROM part)
SELECT p_partkey, round((0.2 * beam + 0.2 * quality + 0.2 * coverage + 0.15 * acceptance + 0.15 * specificity - 0.1 * ambiguity) / 1.1, 6) AS score FROM s""")
def _score(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    parts = {"beam": (size % 10) / 10, "quality": (size % 7) / 7, "coverage": F.least(F.lit(1.0), F.col("p_retailprice") / 2000), "acceptance": (F.col("p_partkey") % 5) / 5, "specificity": S.specificity(size), "ambiguity": S.ambiguity(size), "coherence": F.lit(None).cast("double")}
    return p.select("p_partkey", *[v.alias(k) for k, v in parts.items()]).select("p_partkey", F.round(scoring.weighted(), 6).alias("score"))


@query("n27_hard_filters", """
WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS support, floor(o_totalprice / 10000) AS coverage, (o_orderkey % 4) / 4 AS specificity FROM orders), m AS (SELECT *, max(coverage) OVER (PARTITION BY o_custkey) AS top FROM s WHERE support > 0)
SELECT o_custkey, o_orderkey, coverage::BIGINT AS coverage FROM m WHERE coverage = top AND specificity > 0""")
def _filters(spark, d):
    s = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3).alias("support"), F.floor(F.col("o_totalprice") / 10000).alias("coverage"), ((F.col("o_orderkey") % 4) / 4).alias("specificity"))
    return scoring.best_covering(s, "o_custkey").select("o_custkey", "o_orderkey", "coverage")


@query("n22_triage", """
WITH c AS (SELECT p_partkey, p_size % 9 AS n, (p_size % 11) / 25 AS coh, (p_partkey % 5) / 10 AS inc, (p_partkey % 7) / 15 AS scat, p_partkey % 2 AS dp FROM part), f AS (SELECT *, greatest(0.05, least(0.95, CASE WHEN n <= 0 THEN 0.23 WHEN n <= 3 THEN 0.30 WHEN n <= 5 THEN 0.27 ELSE 0.23 END)) AS floor FROM c),
s AS (SELECT *, (coh < floor - 0.10)::INT + (dp = 0 AND n >= 5)::INT + (inc >= 0.18)::INT + (scat >= 0.33)::INT AS strikes FROM f)
SELECT p_partkey, CASE WHEN scat >= 0.45 THEN 'extreme_scatter' WHEN inc >= 0.45 THEN 'extreme_incompatible' WHEN n <= 3 AND coh < floor - 0.10 AND (inc >= 0.18 OR scat >= 0.33) THEN 'small_and_loose' WHEN n >= 4 AND coh < floor AND (inc >= 0.18 OR scat >= 0.33) THEN 'loose' WHEN n > 3 AND strikes >= 2 THEN 'two_strikes' END AS reason FROM s""")
def _triage(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 9).alias("n"), ((F.col("p_size") % 11) / 25).alias("coh"), ((F.col("p_partkey") % 5) / 10).alias("inc"), ((F.col("p_partkey") % 7) / 15).alias("scat"), (F.col("p_partkey") % 2).alias("dp"))
    return p.select("p_partkey", scoring.triage(F.col("coh"), S.cohesion_floor(F.col("n"), F.lit(3)), F.col("n"), F.col("inc"), F.col("scat"), F.col("dp")).alias("reason"))


@query("f6_accepted_documents", """
SELECT d.source, count(*) AS n, sum(d.n_chars)::BIGINT AS chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) GROUP BY 1""")
def _accepted(spark, d):
    good = table(spark, d, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return table(spark, d, "documents").join(good, "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("a25_coverage_deltas", """
WITH c AS (SELECT l_suppkey AS k, avg(l_discount) FILTER (l_linenumber = 1) AS base, avg(l_discount) AS now FROM lineitem GROUP BY 1) SELECT k, round(now - base, 6) AS delta FROM c WHERE base IS NOT NULL""")
def _deltas(spark, d):
    line = table(spark, d, "lineitem")
    c = line.groupBy(F.col("l_suppkey").alias("k")).agg(F.avg(F.when(F.col("l_linenumber") == 1, F.col("l_discount"))).alias("base"), F.avg("l_discount").alias("now"))
    return c.where("base is not null").select("k", F.round(F.col("now") - F.col("base"), 6).alias("delta"))
