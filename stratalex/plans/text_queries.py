"""Queries over ``documents``, ``benchmark``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..operators import ngrams as N
from ..operators import residual as R
from ..operators.collocation import collocations
from ..operators.store import newest
from ..sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df, *cols, places: int = 6):
    return df.select(*[F.round(c, places).alias(c) if c in cols else c for c in df.columns])


def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", X.words(F.lower("text")).alias("w"))


def types(spark, d):
    return tokens(spark, d).select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def neighbours(spark, d):
    return tokens(spark, d).select(F.explode(X.pairs_in_order(F.col("w"))).alias("p")).groupBy("p.l", "p.r").agg(F.count(F.lit(1)).alias("n"))


_TOK = "tok AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)"
_TYPES = f"{_TOK}, types AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM tok) GROUP BY word)"
_PAIRS = f"{_TOK}, pairs AS (SELECT p[1] AS l, p[2] AS r, count(*) AS n FROM (SELECT unnest(list_zip(w[1:len(w) - 1], w[2:])) AS p FROM tok WHERE len(w) > 1) GROUP BY ALL)"


def _x(e: str) -> str:
    return f"(CASE WHEN ({e}) > 0 THEN ({e}) * ln({e}) ELSE 0 END)"


@query("n11_collocations", f"""
WITH {_PAIRS},
c AS (SELECT l, r, n AS count_ab FROM pairs WHERE n >= 5),
m AS (SELECT item, sum(n) AS n FROM (SELECT l AS item, count_ab AS n FROM c UNION ALL SELECT r, count_ab FROM c) GROUP BY item),
j AS (SELECT l, r, count_ab, a.n::BIGINT AS count_a, b.n::BIGINT AS count_b, (SELECT sum(count_ab) FROM c)::DOUBLE AS t
      FROM c JOIN m a ON a.item = l JOIN m b ON b.item = r)
SELECT l, r, count_ab, count_a, count_b, round(log2(count_ab * t / (count_a::DOUBLE * count_b)), 6) AS pmi,
  round(2 * ({_x('count_ab::DOUBLE')} + {_x('(count_a - count_ab)::DOUBLE')} + {_x('(count_b - count_ab)::DOUBLE')} + {_x('t - count_a - count_b + count_ab')}
  - {_x('count_a::DOUBLE')} - {_x('t - count_a')} - {_x('count_b::DOUBLE')} - {_x('t - count_b')} + {_x('t')}), 6) AS llr,
  round(count_ab / count_a - count_ab / count_b, 6) AS asymmetry
FROM j""")
def _collocations(spark, d):
    return rounded(collocations(neighbours(spark, d), 5), "pmi", "llr", "asymmetry")


@query("a4_ngram_index", f"""
WITH {_TYPES}, g AS (SELECT word, n, k, unnest(range(1, length(word) - k + 2)) AS i FROM types, (SELECT unnest([2, 3, 4]) AS k))
SELECT substr(word, i, k) AS gram, sum(n)::BIGINT AS tf, count(DISTINCT word) AS df FROM g GROUP BY 1""")
def _index(spark, d):
    return N.index(types(spark, d))


@query("x7_ngram_membership", """
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
g AS (SELECT word, k, unnest(range(1, length(word) - k + 2)) AS i FROM t, (SELECT unnest([2, 3, 4]) AS k))
SELECT substr(word, i, k) AS gram, word, string_agg((i - 1)::VARCHAR, ',' ORDER BY i) AS starts FROM g GROUP BY 1, 2""")
def _membership(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(X.words(F.lower("text"))).alias("word")).distinct().withColumn("n", F.lit(1))
    return N.membership(words).withColumn("starts", F.array_join("starts", ","))


@query("a6_neighbour_entropy", f"""
WITH {_PAIRS}, p AS (SELECT l, n, n / sum(n) OVER (PARTITION BY l) AS p FROM pairs)
SELECT l AS item, sum(n)::BIGINT AS freq, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY l HAVING sum(n) >= 20""")
def _entropy(spark, d):
    out = N.neighbour_entropy(neighbours(spark, d), "l").where("freq >= 20")
    return out.select(F.col("l").alias("item"), "freq", (F.round("entropy", 6) + 0.0).alias("entropy"))


@query("a7_positions", f"""
WITH {_TOK}, r AS (SELECT len(w) AS size, unnest(w) AS item, generate_subscripts(w, 1) AS i FROM tok)
SELECT item, count(*) FILTER (i = 1) AS initial, count(*) FILTER (i > 1 AND i < size) AS medial, count(*) FILTER (i = size) AS final FROM r GROUP BY item""")
def _positions(spark, d):
    return N.positions(tokens(spark, d), "w")


@query("w3_adjacency", f"""
WITH {_PAIRS}, items AS (SELECT word AS item, count(*) AS freq FROM (SELECT unnest(w) AS word FROM tok) GROUP BY word),
s AS (SELECT sum(freq) AS m, count(*) AS v FROM items), a AS (SELECT *, sum(n) OVER (PARTITION BY l) AS after FROM pairs)
SELECT l, r, n, round((n + 0.5) / (after + 0.5 * v), 6) AS p, round(log2(n * m / (x.freq::DOUBLE * y.freq)), 6) AS pmi
FROM a, s, items x, items y WHERE n >= 3 AND x.item = l AND y.item = r""")
def _adjacency(spark, d):
    items = types(spark, d).select(F.col("word").alias("item"), F.col("n").alias("freq"))
    return rounded(N.adjacency(neighbours(spark, d), items, 3), "p", "pmi")


@query("m6_language_divergence", """
WITH c AS (SELECT lang AS key, unnest(regexp_extract_all(lower(text), '[a-z]')) AS item FROM documents),
n AS (SELECT key, item, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT key, item, n / sum(n) OVER (PARTITION BY key) AS p FROM n),
k AS (SELECT DISTINCT key FROM p), i AS (SELECT DISTINCT item FROM p),
j AS (SELECT a.key AS a, b.key AS b, coalesce(x.p, 0) AS pa, coalesce(y.p, 0) AS pb, (coalesce(x.p, 0) + coalesce(y.p, 0)) / 2 AS m
  FROM k a JOIN k b ON a.key < b.key, i LEFT JOIN p x ON x.key = a.key AND x.item = i.item LEFT JOIN p y ON y.key = b.key AND y.item = i.item)
SELECT a, b, round(sum(CASE WHEN pa > 0 THEN pa * log2((pa + 1e-12) / (m + 1e-12)) ELSE 0 END) / 2 + sum(CASE WHEN pb > 0 THEN pb * log2((pb + 1e-12) / (m + 1e-12)) ELSE 0 END) / 2, 6) AS divergence FROM j GROUP BY ALL""")
def _divergence(spark, d):
    letters = table(spark, d, "documents").select(F.col("lang").alias("key"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]"), F.lit(0))).alias("item")).groupBy("key", "item").agg(F.count(F.lit(1)).alias("n"))
    dist = letters.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("key"))).select("key", "item", "p")
    keys = dist.select("key").distinct()
    pairs = keys.select(F.col("key").alias("a")).join(keys.select(F.col("key").alias("b")), F.col("a") < F.col("b"))
    return rounded(N.js_divergence(dist, pairs), "divergence")


@query("w6_token_windows", """
WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM benchmark)
SELECT item_id, (i / 4)::INTEGER AS nth, array_to_string(w[i + 1:i + 8], ' ') AS win FROM (SELECT item_id, w, unnest(range(0, len(w) - 7, 4)) AS i FROM t)""")
def _windows(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)).alias("w"))
    return w.select("item_id", F.posexplode(X.windows(F.col("w"), 8, 4)).alias("nth", "win")).withColumn("win", F.array_join("win", " "))


@query("x1_string_functions", """
WITH b AS (SELECT item_id, text, replace(text, 'ß', 'SS') AS upper_text FROM benchmark)
SELECT item_id, lower(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, regexp_replace(upper(upper_text), '[^A-IK-VX-Z]', '', 'g') AS restricted,
  len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 2) = 'th')) AS n_th, upper(trim(regexp_replace(upper_text, '\\s+', ' ', 'g'))) AS spaced,
  len(list_filter(list_transform(regexp_split_to_array(text, '[;:,]'), lambda x: trim(x)), lambda x: regexp_matches(x, '[A-Za-z]'))) AS n_clauses, levenshtein(regexp_replace(text, '[^a-z ]', '', 'g'), regexp_replace(text, '[^b-z]', '', 'g')) AS distance
FROM b""")
def _strings(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select(
        "item_id", X.letters_only(t).alias("letters"), X.alphabet_only(t).alias("restricted"), F.size(X.occurrences(t, F.lit("th"))).cast("long").alias("n_th"), X.canonical_space(t).alias("spaced"),
        F.size(X.clauses(t)).cast("long").alias("n_clauses"), F.levenshtein(F.regexp_replace(t, "[^a-z ]", ""), F.regexp_replace(t, "[^b-z]", "")).cast("long").alias("distance"),
    )


@query("x1_whole_distance", """
WITH t AS (SELECT item_id, regexp_replace(text, '[^a-z ]', '', 'g') AS t FROM benchmark)
SELECT a.item_id, levenshtein(a.t, b.t) AS distance FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def _whole_distance(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^a-z ]", "").alias("t"))
    return t.join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("other")), "item_id").select("item_id", F.levenshtein("t", "other").cast("long").alias("distance"))


@query("x4_collapse_repeats", """
WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string([r[i] FOR i IN range(1, len(r) + 1) IF i = 1 OR r[i] <> r[i - 1]], '>') AS roles FROM t""")
def _collapse(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", F.array_join(X.collapse_repeats(F.transform("r", lambda x: x["role"])), ">").alias("roles"))


@query("x11_spelling_variants", """
WITH t AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark),
a AS (SELECT word, word AS v FROM t UNION SELECT word, replace(word, 'I', 'Y') FROM t UNION SELECT word, replace(word, 'U', 'V') FROM t),
b AS (SELECT word, v FROM a UNION SELECT word, replace(v, 'I', 'Y') FROM a UNION SELECT word, replace(v, 'U', 'V') FROM a)
SELECT word, v AS variant FROM b""")
def _variants(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(X.words(F.col("text"))).alias("word")).select(F.upper("word").alias("word")).distinct()
    return words.select("word", F.explode(X.replaced_variants(F.col("word"), [("I", "Y"), ("U", "V")])).alias("variant"))


@query("a27_top_terms", f"""
WITH {_TOK}, t AS (SELECT lang, unnest(w) AS term FROM tok), c AS (SELECT lang, term, count(*) AS n FROM t WHERE length(term) > 2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS k FROM c) SELECT lang, term, n, k FROM r WHERE k <= 12""")
def _top_terms(spark, d):
    c = tokens(spark, d).select("lang", F.explode("w").alias("term")).where(F.length("term") > 2).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term")).cast("long")).where("k <= 12")


@query("m12_tfidf", """
WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark), c AS (SELECT item_id, term, count(*) AS n FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT item_id, c.term, round(n / sum(n) OVER (PARTITION BY item_id) * (ln((1 + (SELECT count(DISTINCT item_id) FROM c)) / (1 + df)) + 1), 6) AS weight FROM c JOIN df ON c.term = df.term""")
def _tfidf(spark, d):
    c = table(spark, d, "benchmark").select("item_id", F.explode(X.words(F.lower("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))
    df = c.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = c.agg(F.countDistinct("item_id").alias("total"))
    w = F.col("n") / F.sum("n").over(Window.partitionBy("item_id")) * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)
    return c.join(df, "term").join(F.broadcast(total)).select("item_id", "term", F.round(w, 6).alias("weight"))


@query("j13_containment", """
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), n AS (SELECT word AS needle FROM t WHERE length(word) BETWEEN 3 AND 4)
SELECT word, needle FROM t JOIN n ON contains(word, needle) AND word <> needle""")
def _containment(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(X.words(F.lower("text"))).alias("word")).distinct()
    # an equi-join on the words' own n-grams stands for the containment predicate
    grams = words.select("word", F.explode(F.array_distinct(F.transform(X.char_ngrams(F.col("word"), 3, 4), lambda g: g["gram"]))).alias("needle"))
    return grams.join(words.select(F.col("word").alias("needle")), "needle").where("word <> needle").select("word", "needle")


@query("j10_attested_words", """
WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT word, word IN (SELECT word FROM b) AS attested FROM t WHERE length(word) >= 8""")
def _attested(spark, d):
    b = table(spark, d, "benchmark").select(F.explode(X.words(F.lower("text"))).alias("word")).distinct()
    t = types(spark, d).select("word").where(F.length("word") >= 8)
    return t.join(b, "word", "left_semi").withColumn("attested", F.lit(True)).union(t.join(b, "word", "left_anti").withColumn("attested", F.lit(False)))


@query("u1_vocabulary_sets", """
WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations)
SELECT (SELECT count(*) FROM (SELECT * FROM b UNION SELECT * FROM c)) AS n_union, (SELECT count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM c)) AS n_both, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM c)) AS n_only""")
def _sets(spark, d):
    b, c = (table(spark, d, t).select(F.explode(X.words(F.lower("text"))).alias("word")).distinct() for t in ("benchmark", "conversations"))
    n = lambda x, k: x.agg(F.count(F.lit(1)).alias(k))
    return n(b.union(c).distinct(), "n_union").join(n(b.intersect(c), "n_both")).join(n(b.subtract(c), "n_only"))


@query("n6_subtraction", """
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS host FROM benchmark), r AS (SELECT unnest(['th', 'er', 'an', 'inin']) AS root),
o AS (SELECT host, root, unnest(range(1, length(host) - length(root) + 2)) AS i FROM t, r), m AS (SELECT * FROM o WHERE substr(host, i, length(root)) = root),
c AS (SELECT host, root, unnest(range(1, length(host) + 1)) AS k FROM (SELECT DISTINCT host, root FROM m)),
a AS (SELECT host, root, coalesce(string_agg(substr(host, k, 1), '' ORDER BY k) FILTER (NOT EXISTS (SELECT 1 FROM m WHERE m.host = c.host AND m.root = c.root AND k >= m.i AND k < m.i + length(m.root))), '') AS removed_all FROM c GROUP BY ALL)
SELECT m.host, m.root, row_number() OVER (PARTITION BY m.host, m.root ORDER BY i) - 1 AS nth, i - 1 AS start, i - 1 + length(m.root) AS "end",
  substr(m.host, 1, i - 1) || substr(m.host, i + length(m.root)) AS residual, removed_all FROM m JOIN a ON a.host = m.host AND a.root = m.root""")
def _subtraction(spark, d):
    hosts = table(spark, d, "benchmark").select(F.explode(X.words(F.lower("text"))).alias("host")).distinct()
    return R.subtract(hosts.withColumn("root", F.explode(F.array(*[F.lit(x) for x in ("th", "er", "an", "inin")]))))


@query("a13_top_fragments", """
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS fragment FROM conversations)
SELECT fragment, count(*) AS freq, sum(length(fragment))::BIGINT AS total_len FROM t GROUP BY 1 ORDER BY freq DESC, total_len DESC, fragment LIMIT 25""")
def _fragments(spark, d):
    return R.top_fragments(table(spark, d, "conversations").select(F.explode(X.words(F.lower("text"))).alias("fragment")), 25)


@query("y5_span_coverage", """
WITH w AS (SELECT item_id, length(text) AS size, unnest(range(1, length(text) + 1)) AS i, text FROM benchmark),
m AS (SELECT item_id, size, i, EXISTS (SELECT 1 FROM (SELECT unnest(['the', 'he ', 'and', 'tion']) AS p) WHERE position(p IN substr(text, greatest(1, i - length(p) + 1), least(i, length(p)) + length(p) - 1)) > 0) AS c FROM w)
SELECT item_id, count(*) FILTER (c) AS covered, count(*) AS size FROM m GROUP BY item_id""")
def _coverage(spark, d):
    t = F.col("text")
    spans = F.concat(*[_spans(t, p) for p in ("the", "he ", "and", "tion")])
    rows = table(spark, d, "benchmark").select("item_id", F.char_length("text").alias("size"), spans.alias("spans"))
    return rows.select("item_id", R.covered(F.col("size"), F.col("spans")).cast("long").alias("covered"), F.col("size").cast("long").alias("size"))


def _spans(text, part: str):
    size = len(part)
    return F.transform(X.occurrences(text, F.lit(part)), lambda i: F.struct(i.alias("s"), (i + size).alias("e")))


@query("w7_linked_turns", """
SELECT conv_id, turn, lag(turn) OVER w AS prev, lead(turn) OVER w AS next, row_number() OVER w AS pos FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _linked(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("prev"), F.lead("turn").over(w).alias("next"), F.row_number().over(w).cast("long").alias("pos"))


@query("y12_reassembly", """
SELECT conv_id, string_agg(role || ': ' || text, ' | ' ORDER BY turn) AS dialogue, count(*) AS n FROM conversations GROUP BY conv_id""")
def _whole_reassembly(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t")))).alias("p"), F.count(F.lit(1)).alias("n"))
    return rows.select("conv_id", F.array_join(F.transform("p", lambda x: x["t"]), " | ").alias("dialogue"), "n")


@query("w11_running_budget", """
WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[^ ]+')) AS n FROM conversations), r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS running FROM t)
SELECT conv_id, turn, n, running::BIGINT AS running FROM r WHERE running <= 75""")
def _budget(spark, d):
    from ..operators.scoring import running_prefix

    rows = table(spark, d, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))).cast("long").alias("n"))
    return running_prefix(rows, "conv_id", ["turn"], "n", 75)


@query("page_titles", """
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, contains(lower(html), '<script') AS scripted FROM pages""")
def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).cast("long").alias("n_paragraphs"), F.lower("html").contains("<script").alias("scripted"))


@query("a9_segment_histogram", """
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, item_id FROM benchmark), c AS (SELECT item_id, count(DISTINCT word) AS n FROM t GROUP BY item_id)
SELECT count(*) FILTER (n = 0) AS zero, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multi, count(*) AS tokens FROM c""")
def _histogram(spark, d):
    c = table(spark, d, "benchmark").select("item_id", F.explode(X.words(F.lower("text"))).alias("word")).groupBy("item_id").agg(F.countDistinct("word").alias("n"))
    return c.agg(F.count_if(F.col("n") == 0).alias("zero"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multi"), F.count(F.lit(1)).alias("tokens"))


@query("n46_prompt_memo", """
SELECT sha256(upper(trim(regexp_replace(replace(text, 'ß', 'SS'), '\\s+', ' ', 'g')))) AS key, count(*) AS n, min(conv_id) AS first_conv FROM conversations GROUP BY 1""")
def _memo(spark, d):
    return table(spark, d, "conversations").select(F.sha2(X.canonical_space(F.col("text")), 256).alias("key"), "conv_id").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_conv"))


@query("t4_best_of_source", """
WITH r AS (SELECT lang, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT lang, source, doc_id, n_chars FROM r WHERE k = 1""")
def _best(spark, d):
    return newest(table(spark, d, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")])


@query("m13_jaccard_neighbours", """
WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def _jaccard(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(X.words(F.lower("text"))).alias("w"))
    return t.alias("x").join(t.select((F.col("item_id") - 1).alias("before"), F.col("item_id").alias("b"), F.col("w").alias("v")), F.col("item_id") == F.col("before")).select(F.col("item_id").alias("a"), "b", F.round(S.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query("n1_beam_segmentation")
def _segmentation(spark, d):
    from ..operators.segment import segment

    words = table(spark, d, "benchmark").select(F.explode(X.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = words.select("word", F.explode(F.array_distinct(F.transform(X.char_ngrams(F.col("word"), 2, 7), lambda g: g["gram"]))).alias("gram"))
    known = words.select(F.col("word").alias("gram"), F.lit(True).alias("attested"))
    total = words.agg(F.count(F.lit(1)).alias("total"))  # one row
    rows = own.join(N.index(words, 2, 7), "gram").join(known, "gram", "left").fillna(False, ["attested"]).join(F.broadcast(total))
    return segment(rows).withColumn("segments", F.array_join("segments", "+"))
