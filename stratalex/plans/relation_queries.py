"""Queries of joins, ranks and summaries that are compositions of built-in operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


@query("j5_two_left_joins", "SELECT o_orderkey, coalesce(c_name, s_name, 'none') AS named FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_orderkey % 100")
def _two(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100).alias("k"))
    return o.join(c, "o_custkey", "left").join(s, "k", "left").select("o_orderkey", F.coalesce("c_name", "s_name", F.lit("none")).alias("named"))


@query("j7_lower_key_default", "SELECT p_partkey, coalesce(n_nationkey, 9223372036854775807)::BIGINT AS place FROM part LEFT JOIN nation ON lower(n_name) = lower('Nation_' || (p_partkey % 40))")
def _lower(spark, d):
    n = table(spark, d, "nation").select(F.lower("n_name").alias("k"), "n_nationkey")
    p = table(spark, d, "part").select("p_partkey", F.lower(F.concat(F.lit("Nation_"), F.col("p_partkey") % 40)).alias("k"))
    return p.join(n, "k", "left").select("p_partkey", F.coalesce(F.col("n_nationkey").cast("long"), F.lit(2**63 - 1)).alias("place"))


@query("j11_unknown_words", r"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), k AS (SELECT DISTINCT lower(trim(unnest(string_split(p_name, ' ')))) AS word FROM part) SELECT word FROM w ANTI JOIN k USING (word)""")
def _unknown(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.join(table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).select(F.lower(F.trim("word")).alias("word")), "word", "left_anti")


@query("j17_pairs_in_row", """
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) SELECT a.w AS l, b.w AS r, count(*) AS n FROM w a JOIN w b ON a.p_partkey = b.p_partkey AND a.i < b.i GROUP BY ALL""")
def _pairs(spark, d):
    w = table(spark, d, "part").select(F.posexplode(F.split("p_name", " ")).alias("i", "l"), F.split("p_name", " ").alias("w"))
    return w.select("l", F.explode(F.slice("w", F.col("i") + 2, 1 << 20)).alias("r")).groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))


@query("j23_longest_anchor", """
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), u AS (SELECT w, count(*) AS uses FROM w GROUP BY 1), r AS (SELECT p_partkey, w, row_number() OVER (PARTITION BY p_partkey ORDER BY length(w) DESC, uses DESC, w DESC) AS k FROM w JOIN u USING (w)) SELECT p_partkey, w AS anchor FROM r WHERE k = 1""")
def _anchor(spark, d):
    w = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    uses = w.groupBy("w").agg(F.count(F.lit(1)).alias("uses"))
    return w.join(uses, "w").groupBy("p_partkey").agg(F.max_by("w", F.struct(F.char_length("w"), "uses", "w")).alias("anchor"))


@query("a20_mean_and_median", "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS middle FROM events GROUP BY 1")
def _middle(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("middle"))


@query("a22_correlation", "SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 6) AS r FROM lineitem GROUP BY 1")
def _corr(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.coalesce(F.corr("l_quantity", "l_extendedprice"), F.lit(0.0)), 6).alias("r"))


@query("a23_two_sided_delta", """
WITH s AS (SELECT l_partkey AS k, l_discount - l_tax AS x FROM lineitem UNION ALL SELECT l_suppkey, l_discount - l_tax FROM lineitem), g AS (SELECT k, round(avg(abs(x)), 6) AS delta, count(*) AS n FROM s GROUP BY 1) SELECT * FROM g ORDER BY delta DESC, k LIMIT 20""")
def _delta(spark, d):
    s = table(spark, d, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("k"), F.abs(F.col("l_discount") - F.col("l_tax")).alias("x"))
    return s.groupBy("k").agg(F.round(F.avg("x"), 6).alias("delta"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("delta"), "k").limit(20)


@query("w1_member_number", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS place FROM part")
def _place(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.lower("p_name"), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("w8_best_of_key", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE k = 1")
def _best(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query("f7_valid_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_valid(props) AND trim(props) <> ''")
def _valid(spark, d):
    rows = table(spark, d, "events").where("trim(props) <> '' and try_parse_json(props) is not null")
    return rows.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("f16_inverse_lookup", "SELECT DISTINCT s_suppkey AS morph, l_orderkey AS token FROM supplier JOIN lineitem ON l_suppkey = s_suppkey")
def _inverse(spark, d):
    tokens = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("morph"), F.col("l_orderkey").alias("token"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("morph")).join(tokens, "morph").distinct()


@query("a10_length_histogram", "SELECT count(*) FILTER (n = 0) AS zero, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multi FROM (SELECT len(list_filter(string_split(p_name, ' '), lambda x: x > 'm')) AS n FROM part)")
def _lengths(spark, d):
    n = F.size(F.filter(F.split("p_name", " "), lambda x: x > "m"))
    return table(spark, d, "part").agg(*[F.count_if(c).alias(k) for k, c in (("zero", n == 0), ("single", n == 1), ("multi", n > 1))])


@query("a11_recurrence", "SELECT lower(event_type) AS span, count(*) AS n, round(avg(value), 6) AS residual, round(avg(event_id % 7 / 7), 6) AS coverage FROM events GROUP BY 1")
def _recurrence(spark, d):
    return table(spark, d, "events").groupBy(F.lower("event_type").alias("span")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("residual"), F.round(F.avg(F.col("event_id") % 7 / 7), 6).alias("coverage"))


@query("j9_zipped_arrays", """
WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS w, string_split(p_type, ' ') AS t FROM part), z AS (SELECT p_partkey, w, t, unnest(range(1, least(len(w), len(t)) + 1)) AS i FROM a) SELECT p_partkey, i AS place, w[i] AS l, t[i] AS r FROM z""")
def _zipped(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("l"), F.split("p_type", " ").alias("r"))
    both = a.withColumn("n", F.least(F.size("l"), F.size("r"))).select("p_partkey", F.posexplode(F.arrays_zip(F.slice("l", F.lit(1), F.col("n")).alias("l"), F.slice("r", F.lit(1), F.col("n")).alias("r"))).alias("i", "z"))
    return both.select("p_partkey", (F.col("i") + 1).cast("long").alias("place"), F.col("z.l"), F.col("z.r"))
