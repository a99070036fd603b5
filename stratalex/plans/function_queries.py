"""Queries of single functions and small operators, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..functions import vectors as V
from ..operators import donors, residual, scoring, store
from ..operators import lookups as L
from ..operators import ngrams as N
from ..operators.vectors import mean_vectors
from ..sources import corpus, files
from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


@query("x2_alphabet_only", "SELECT item_id, regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-IK-VX-Z]', '', 'g') AS letters FROM benchmark")
def _alphabet(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.alphabet_only(F.col("text")).alias("letters"))


@query("x3_plain_letters", "SELECT doc_id, regexp_replace(strip_accents(text), '[^A-Za-z]', '', 'g') AS letters FROM documents")
def _plain(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(X.normal_form("NFKD")(F.col("text")), r"\p{M}|[^A-Za-z]", "").alias("letters"))


@query("x5_occurrences", "SELECT item_id, coalesce(array_to_string(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, 3) = 'ere'), ','), '') AS at_ere, len(list_filter(range(0, length(text)), lambda i: substr(lower(text), i + 1, 2) = 'th')) AS n_th FROM benchmark")
def _occurrences(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.occurrences(F.col("text"), F.lit("ere")), ",").alias("at_ere"), F.size(X.occurrences(F.lower("text"), F.lit("th"))).cast("long").alias("n_th"))


@query("x6_start_positions", """
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark), g AS (SELECT word, substr(word, i + 1, 2) AS gram, i FROM (SELECT word, unnest(range(0, length(word) - 1)) AS i FROM w WHERE length(word) > 1))
SELECT gram, word, string_agg(i, ',' ORDER BY i) AS starts FROM g GROUP BY ALL""")
def _starts(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.transform(X.words(F.col("text")), F.lower)).alias("word")).distinct()
    return N.membership(w.withColumn("n", F.lit(1)), 2, 2).toDF("gram", "word", "starts").select("gram", "word", F.array_join("starts", ",").alias("starts"))


@query("x8_slices", """
WITH t AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), x AS (SELECT item_id, j - 1 AS word_index, w[j] AS word FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS j FROM t))
SELECT item_id, word_index::INT AS word_index, i::INT AS start, (i + n)::INT AS "end", substr(word, i + 1, n) AS gram FROM (SELECT *, unnest(range(0, greatest(0, length(word) - n + 1))) AS i FROM x, (VALUES (3), (4)) v(n))""")
def _slices(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.posexplode(X.words(F.col("text"))).alias("word_index", "word"))
    return w.select("item_id", "word_index", F.explode(X.char_ngrams(F.col("word"), 3, 4)).alias("x")).select("item_id", "word_index", F.col("x.start").alias("start"), (F.col("x.start") + F.char_length("x.gram")).alias("end"), F.col("x.gram").alias("gram"))


@query("x9_words", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS n, array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ') AS words FROM documents")
def _tokens(spark, d):
    w = X.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(w, " ").alias("words"))


@query("x10_window_tokens", "WITH t AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z'']+') AS w FROM benchmark) SELECT item_id, i / 3 AS nth, array_to_string(w[i + 1:i + 5], ' ') AS win FROM (SELECT item_id, w, unnest(range(0, len(w) - 4, 3)) AS i FROM t WHERE len(w) >= 5)")
def _window_tokens(spark, d):
    w = F.regexp_extract_all("text", F.lit("[A-Za-z']+"), F.lit(0))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(X.windows(w, 5, 3)).alias("nth", "win")).select("item_id", F.col("nth").cast("double").alias("nth"), F.array_join("win", " ").alias("win"))


@query("x16_canonical_space", "SELECT conv_id, turn, upper(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'ß', 'SS')) AS spaced FROM conversations")
def _spaced(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.canonical_space(F.col("text")).alias("spaced"))


@query("x25_terms", "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '[,/;]|(?:\\bor\\b)'), lambda x: trim(x)), lambda x: x <> ''))), '|') AS terms FROM benchmark")
def _terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(X.terms(F.col("text"))), "|").alias("terms"))


@query("x21_graphemes", "SELECT item_id, len(string_split(text, '')) AS n FROM benchmark")
def _graphemes(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(X.graphemes(F.col("text"))).cast("long").alias("n"))


_COUNTS = "c AS (SELECT s_nationkey AS k, count(*) AS a FROM supplier GROUP BY 1), e AS (SELECT c_nationkey AS k, count(*) AS b, count(*) FILTER (c_custkey % 2 = 0) AS pairs FROM customer GROUP BY 1), t AS (SELECT k, a + b AS a, b, pairs, (SELECT count(*) FROM customer) * 2 AS n FROM c JOIN e USING (k))"


def _counts(spark, d):
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("s"))
    c = table(spark, d, "customer")
    b = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b"), F.count_if(F.col("c_custkey") % 2 == 0).alias("both"))
    return a.join(b, "k").join(F.broadcast(c.agg((F.count(F.lit(1)) * 2).alias("n")))).withColumn("a", F.col("s") + F.col("b"))  # one row


@query("m1_pmi", f"WITH {_COUNTS} SELECT k, round(log2(pairs * n / (a * b)), 6) AS pmi FROM t WHERE pairs > 0 AND a * b > 0")
def _pmi(spark, d):
    return _counts(spark, d).where("both > 0").select("k", F.round(S.pmi(F.col("both"), F.col("a"), F.col("b"), F.col("n")), 6).alias("pmi"))


_XLX = "CASE WHEN {0} > 0 THEN ({0}) * ln({0}) ELSE 0 END"
_LLR = " + ".join(_XLX.format(x) for x in ("pairs::DOUBLE", "(a - pairs)::DOUBLE", "(b - pairs)::DOUBLE", "(n - a - b + pairs)::DOUBLE"))


@query("m2_log_likelihood", f"WITH {_COUNTS} SELECT k, round(2 * ({_LLR} - {_XLX.format('a::DOUBLE')} - {_XLX.format('(n - a)::DOUBLE')} - {_XLX.format('b::DOUBLE')} - {_XLX.format('(n - b)::DOUBLE')} + {_XLX.format('n::DOUBLE')}), 5) AS llr FROM t")
def _llr(spark, d):
    return _counts(spark, d).select("k", F.round(S.log_likelihood(F.col("both"), F.col("a"), F.col("b"), F.col("n")), 5).alias("llr"))


@query("m3_safe_divide", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END, 6)::DOUBLE AS ratio FROM lineitem")
def _safe(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.safe_divide(F.col("l_tax"), F.col("l_discount")), 6).alias("ratio"))


@query("m5_plain_cosine", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def _cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("m8_smoothed", "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), v AS (SELECT count(DISTINCT p_type) AS v FROM part) SELECT p_brand, p_type, round((n + 0.5) / (sum(n) OVER (PARTITION BY p_brand) + 0.5 * v), 6)::DOUBLE AS p FROM c, v")
def _smoothed(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part")
    c = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(p.agg(F.countDistinct("p_type").alias("v"))))  # one row
    return c.select("p_brand", "p_type", F.round(S.smoothed(F.col("n"), F.sum("n").over(Window.partitionBy("p_brand")), F.col("v")), 6).alias("p"))


@query("m14_clamp", "SELECT c_custkey, least(1, greatest(-1, c_acctbal / 5000))::DOUBLE AS x FROM customer")
def _clamp(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.clamp(F.col("c_acctbal") / 5000, -1.0, 1.0).alias("x"))


@query("m16_cohesion_floor", "WITH b AS (SELECT p_partkey, p_size AS n, length(p_name) % 8 AS g FROM part) SELECT p_partkey, round(greatest(0.05, least(0.95, CASE WHEN n <= 0 THEN 0.23 WHEN n <= 3 THEN 0.30 WHEN n <= 5 THEN 0.27 WHEN n <= 10 THEN 0.23 ELSE 0.18 END + CASE WHEN g <= 2 THEN -0.05 WHEN g >= 5 THEN 0.05 ELSE 0 END)), 6)::DOUBLE AS floor FROM b")
def _floor(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.cohesion_floor(F.col("p_size"), F.length("p_name") % 8), 6).alias("floor"))


@query("n29_specificity_ambiguity", "SELECT p_partkey, round(CASE WHEN p_size % 12 <= 0 THEN 0.5 ELSE 1 / (1 + ln(p_size % 12)) END, 6)::DOUBLE AS specificity, round(CASE WHEN p_size % 12 <= 1 THEN 0 ELSE least(1, ln(p_size % 12) / ln(9)) END, 6)::DOUBLE AS ambiguity FROM part")
def _specificity(spark, d):
    n = F.col("p_size") % 12
    return table(spark, d, "part").select("p_partkey", F.round(S.specificity(n), 6).alias("specificity"), F.round(S.ambiguity(n), 6).alias("ambiguity"))


@query("a2_marginals", "WITH c AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY ALL) SELECT item, sum(n)::BIGINT AS n FROM (SELECT a AS item, n FROM c UNION ALL SELECT b, n FROM c) GROUP BY item")
def _marginals(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.explode(F.array("a", "b")).alias("item"), "n").groupBy("item").agg(F.sum("n").alias("n"))


@query("a3_total_and_means", "SELECT count(*) AS n, sum(l_quantity) AS total, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem")
def _means(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"))


@query("a5_gram_df", "WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark), g AS (SELECT DISTINCT word, substr(word, i + 1, 3) AS gram FROM (SELECT word, unnest(range(0, length(word) - 2)) AS i FROM w WHERE length(word) > 2)) SELECT gram, count(*) AS df FROM g GROUP BY gram")
def _df(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.transform(X.words(F.col("text")), F.lower)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return N.index(w, 3, 3).select("gram", "df")


@query("w5_best_covering", "WITH c AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderkey % 3 AS support, floor(o_totalprice / 50000) AS coverage, o_orderkey % 5 AS specificity FROM orders), s AS (SELECT * FROM c WHERE support > 0), t AS (SELECT * FROM s QUALIFY coverage = max(coverage) OVER (PARTITION BY k)) SELECT k, id FROM t WHERE specificity > 0")
def _covering(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("support"), F.floor(F.col("o_totalprice") / 50000).alias("coverage"), (F.col("o_orderkey") % 5).alias("specificity"))
    return scoring.best_covering(c, "k").select("k", "id")


@query("u3_key_intersection", "SELECT s_nationkey AS k FROM supplier WHERE s_suppkey % 3 = 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_custkey % 7 = 0")
def _both(spark, d):
    return table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k")).intersect(table(spark, d, "customer").where("c_custkey % 7 = 0").select("c_nationkey"))


@query("u4_key_difference", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0")
def _difference(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_suppkey % 4 = 0").select("s_nationkey"))


@query("u6_merged_evidence", "SELECT p_brand AS morph, p_name AS text, max(p_retailprice) AS score FROM part GROUP BY ALL")
def _merged(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("morph"), F.col("p_name").alias("text"), F.col("p_retailprice").alias("score"), "p_partkey")
    return L.merged_pool(p.where("p_partkey % 2 = 0").drop("p_partkey"), p.where("p_partkey % 2 = 1").drop("p_partkey"), key=["morph", "text"], score="score")


@query("y1_ordered_distinct", "WITH x AS (SELECT item_id, i, w[i] AS t FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark))), f AS (SELECT item_id, t, min(i) AS i FROM x GROUP BY ALL) SELECT item_id, string_agg(t, ' ' ORDER BY i) AS words FROM f GROUP BY item_id")
def _distinct(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(X.words(F.lower("text"))), " ").alias("words"))


@query("y2_vector_difference", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))), 6) AS size FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def _subtracted(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return both.select("vec_id", F.round(F.aggregate(V.subtract(F.col("v"), F.col("w")), F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("size"))


@query("y3_mean_vectors", "SELECT label, i::INT AS place, round(avg(embedding[i + 1]::DOUBLE), 6) AS x FROM embeddings, range(0, 64) r(i) GROUP BY ALL")
def _mean(spark, d):
    return mean_vectors(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("vec").alias("place", "x")).withColumn("x", F.round("x", 6))


@query("y4_unit_vectors", "WITH e AS (SELECT vec_id, [embedding[1] * (vec_id % 3), embedding[2] * (vec_id % 3)]::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS x, round(v[2] / sqrt(list_dot_product(v, v)), 6) AS y FROM e WHERE vec_id % 3 > 0")
def _units(spark, d):
    e = table(spark, d, "embeddings")
    v = F.transform(F.slice("embedding", 1, 2), lambda x: (x * (F.col("vec_id") % 3)).cast("double"))
    return e.select("vec_id", V.unit(v).alias("u")).where("u is not null").select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("x"), F.round(F.get("u", F.lit(1)), 6).alias("y"))


@query("y6_coverage_without_root", """
WITH t AS (SELECT p_partkey AS id, length(p_name) AS size, p_size % 5 AS a, p_size % 9 AS b FROM part) SELECT id, round(len(list_filter(range(0, size), lambda i: (i >= a AND i < a + 3) OR (b % 2 = 0 AND i >= b AND i < b + 2))) / size, 6) AS coverage FROM t""")
def _without(spark, d):
    from ..operators.refresh import breakdown, without_root

    a, b = F.col("p_size") % 5, F.col("p_size") % 9
    segment = lambda s, n, c: F.struct(s.cast("int").alias("s"), (s + n).cast("int").alias("e"), c.alias("canonical"))
    parts = F.array(segment(a, 3, F.lit("kept")), segment(b, 2, F.when(b % 2 == 0, "other").otherwise("Root")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(breakdown(F.col("p_name"), without_root(parts, F.lit("root")))["coverage"], 6).alias("coverage"))


@query("n7_removals", """
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS host FROM benchmark), o AS (SELECT host, i, row_number() OVER (PARTITION BY host ORDER BY i) - 1 AS nth FROM (SELECT host, unnest(range(0, length(host) - 1)) AS i FROM w WHERE length(host) > 1) WHERE substr(host, i + 1, 2) = 'er')
SELECT host, nth::INT AS nth, left(host, i) || substr(host, i + 3) AS residual FROM o""")
def _removals(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.transform(X.words(F.col("text")), F.lower)).alias("host")).distinct().withColumn("root", F.lit("er"))
    return residual.subtract(w).select("host", "nth", "residual")


@query("j14_other_hosts", "WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark), r AS (SELECT w AS residual FROM w WHERE length(w) = 3) SELECT residual, w AS host FROM r JOIN w ON contains(w, residual) AND w <> residual")
def _hosts(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.transform(X.words(F.col("text")), F.lower)).alias("word")).distinct()
    known = w.where("length(word) = 3").select(F.col("word").alias("morph"))
    return L.substring_evidence(w, known.select(F.upper("morph").alias("morph")), 3, 3).select(F.lower("morph").alias("residual"), F.col("word").alias("host")).where("residual <> host").distinct()


@query("t3_donor_rank", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END, length(p_name) DESC, p_name, p_partkey)::INT AS place FROM part")
def _donors(spark, d):
    from pyspark.sql import Window

    source = F.when(F.col("p_type") == "PROMO", "dictionary").when(F.col("p_type") == "SMALL", "sqlite").otherwise("x")
    order = Window.partitionBy("p_brand").orderBy(donors._trust(source), F.desc(F.length("p_name")), "p_name", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(order).alias("place"))


@query("t5_match_order", "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_type), lower(p_name), p_partkey)::INT AS place FROM part")
def _order(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.orderBy(F.lower("p_type"), F.lower("p_name"), "p_partkey")).alias("place"))


@query("t11_distinct_citations", """SELECT p_brand, count(DISTINCT '{"location":"' || p_type || '","context":"' || p_name || '"}') AS n, min('{"location":"' || p_type || '","context":"' || p_name || '"}') AS first FROM part GROUP BY p_brand""")
def _citations(spark, d):
    cited = F.to_json(F.struct(F.col("p_type").alias("location"), F.col("p_name").alias("context")))
    return table(spark, d, "part").groupBy("p_brand").agg(F.countDistinct(cited).alias("n"), F.min(cited).alias("first"))


@query("k2_replace_partition", "SELECT l_orderkey AS run, l_linenumber AS seq, 'old' AS note FROM lineitem WHERE l_orderkey % 3 > 0 UNION ALL SELECT DISTINCT l_orderkey, 0, 'new' FROM lineitem WHERE l_orderkey % 3 = 0")
def _replaced(spark, d):
    old = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("seq"), F.lit("old").alias("note"))
    new = old.where("run % 3 = 0").select("run", F.lit(0).alias("seq"), F.lit("new").alias("note")).distinct()
    return store.replace_partition(old, new, ["run"])


@query("k4_insert_or_ignore", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 12 UNION ALL SELECT n_nationkey, 'late' FROM nation WHERE n_nationkey >= 12")
def _ignored(spark, d):
    n = table(spark, d, "nation")
    return store.insert_or_ignore(n.where("n_nationkey < 12").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), n.select(F.col("n_nationkey").alias("k"), F.lit("late").alias("name")), ["k"])


@query("k12_common_columns", "SELECT c_custkey AS k, c_name AS name FROM customer")
def _common(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), "c_acctbal")
    return store.common_columns(c, spark.createDataFrame([], "other int, k long, name string"))


@query("f2_float_lists", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN value + 1 END AS total FROM events")
def _floats(spark, d):
    k, v = F.col("event_id") % 3, F.col("value").cast("string")
    text = F.when(k == 0, F.concat(F.lit("["), v, F.lit(", 1.0]"))).when(k == 1, F.concat(v, F.lit(",1"))).otherwise(F.concat(v, F.lit(",bad")))
    return table(spark, d, "events").select("event_id", F.aggregate(files.floats(text), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("f3_string_lists", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '+' || p_type WHEN 1 THEN p_name || '+' || p_type ELSE p_name END AS items FROM part")
def _strings(spark, d):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.to_json(F.array("p_name", "p_type"))).when(k == 1, F.concat("p_name", F.lit(" | "), "p_type", F.lit("|"))).otherwise(F.concat(F.lit(", "), "p_name", F.lit(" ,")))
    return table(spark, d, "part").select("p_partkey", F.array_join(files.strings(text), "+").alias("items"))


@query("f4_composites", "SELECT p_name AS token, p_type AS gold, round(CASE WHEN p_size % 2 = 0 THEN p_retailprice / 7000 ELSE 0 END, 4) AS error FROM part")
def _composites(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("word"), F.col("p_type").alias("gold_gloss"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") / 7000).alias("reconstruction_error"))
    return corpus.composites(p).select("token", "gold", "error")


@query("f8_plain_payloads", "SELECT p_partkey FROM part WHERE p_partkey % 4 = 0")
def _payloads(spark, d):
    k = F.col("p_partkey") % 4
    rows = table(spark, d, "part").withColumn("s", F.when(k == 0, ' {"a": 1}').when(k == 1, "[ERROR] {x}").when(k == 2, "Error: {").otherwise("plain"))
    return L.json_like(rows, "s").select("p_partkey")


@query("f15_segments_with_spans", "SELECT l_orderkey AS run_id, l_linenumber AS seg_index, l_partkey AS span_start, l_suppkey AS span_end, l_tax AS score FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def _spans(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders").where("o_custkey = 7").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    rows = rows.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("seg_index"), F.col("l_partkey").alias("span_start"), F.col("l_suppkey").alias("span_end"), F.col("l_tax").alias("score"), F.lit("Naz").alias("token"))
    return L.segments_of(rows, F.lit("nAZ")).drop("token")


@query("s6_paragraph_tokens", "WITH p AS (SELECT doc_id, i - 1 AS paragraph, t[i] AS p FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n'), lambda x: trim(x) <> '') AS t FROM documents))) SELECT doc_id, paragraph::INT AS paragraph, array_to_string(list_filter(list_transform(regexp_extract_all(p, '[A-Za-z]+'), lambda x: regexp_replace(upper(x), '[^A-IK-VX-Z]', '', 'g')), lambda x: x <> ''), ' ') AS tokens FROM p")
def _paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(corpus.paragraph_tokens(F.col("text"))).alias("paragraph", "t")).select("doc_id", "paragraph", F.array_join("t", " ").alias("tokens"))


@query("s12_trusted_seeds", "SELECT DISTINCT upper(t) AS token FROM (SELECT p_name AS t FROM part WHERE p_size = 1 UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part) WHERE length(t) <= 7")
def _seeds(spark, d):
    p = table(spark, d, "part")
    entries = p.select(F.lit(None).cast("string").alias("canonical"), F.get(F.split("p_name", " "), F.lit(0)).alias("normalized"), F.transform(F.slice(F.split("p_name", " "), 2, 9), lambda x: F.struct(x.alias("value"))).alias("alternates"))
    return corpus.trusted_seeds(p.where("p_size = 1").select(F.col("p_name").alias("token")), entries)
