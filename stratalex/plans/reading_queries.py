"""Queries of readings, alignments of evidence and fuzzy lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as E
from ..operators import functional as U
from ..operators import readings as R
from ..operators.lookup import fuzzy
from ..sources.tables import table
from .phrase_queries import _PROFILES, _ROLES, _pick, _sql

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_LABELS = ("noun_like", "Verb phrase", "modifier", "relational operator", "uncertain", "?")
_FAMILIES = ("noun", "predicate", "modifier", "relational", "mixed", "unknown")
_AXES = ("prefix", "suffix", "free", "infix", "other")
_STATES = ("stable", "needs_review", "split_recommended", "provisional")
_WORDS = ("BUILDING", " machinery", "", "HOUSE")


@query("m17_transitions", f"""
WITH t AS (SELECT user_id, event_id, {_sql(_FAMILIES, 'event_id')} AS f, (event_id % 7) / 7 AS c FROM events),
n AS (SELECT *, lead(f) OVER w AS g, lead(c) OVER w AS d, lead(event_id) OVER w AS next FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, least(1.0, (c + d) / 2) AS sure, CASE f || ' ' || g WHEN 'modifier noun' THEN 1.1 WHEN 'relational predicate' THEN 1.25 WHEN 'predicate noun' THEN 0.85 WHEN 'predicate mixed' THEN 0.85 WHEN 'noun relational' THEN 0.7 WHEN 'relational noun' THEN 0.75
  WHEN 'noun predicate' THEN 0.55 WHEN 'noun noun' THEN 0.2 ELSE CASE WHEN 'mixed' IN (f, g) THEN 0.05 ELSE -0.65 END END::DOUBLE AS base FROM n WHERE next IS NOT NULL)
SELECT user_id, event_id, next, CASE WHEN sure > 0 AND 'unknown' NOT IN (f, g) THEN round(least(1.4, greatest(-0.8, base * (0.35 + 0.65 * sure))), 4) ELSE 0 END::DOUBLE AS score FROM b""")
def _transitions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    t = table(spark, d, "events").select("user_id", "event_id", R.family(_pick("event_id", *_LABELS)).alias("f"), ((F.col("event_id") % 7) / 7).alias("c"))
    both = t.select("user_id", "event_id", F.lead("event_id").over(w).alias("next"), "f", "c", F.lead("f").over(w).alias("g"), F.lead("c").over(w).alias("d"))
    return both.where("next is not null").select("user_id", "event_id", "next", R.transition(*map(F.col, "fgcd")).alias("score"))


@query("n38_phrase_beam")
def _beam(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("at"), F.char_length(F.coalesce("text", F.lit(""))).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("choice"))
    mark = turns.withColumn("k", F.col("at") * 3 + F.col("choice") + F.col("n"))
    return R.phrase_beam(
        mark.select(
            "conv_id", "at", "choice", ((F.col("n") * (F.col("choice") + 3) % 17) / 4).alias("score"), ((F.col("k") % 5) / 5).alias("confidence"), ((F.col("k") % 3) / 3).alias("coherence"),
            F.array_repeat(F.lit("a"), (F.col("k") % 6).cast("int")).alias("parts"), F.when(F.col("k") % 4 > 0, "said").alias("definition"), (F.col("k") % 2 == 0).alias("provisional"), (F.col("k") % 7 == 0).alias("rescued"),
            _pick("k", *_LABELS).alias("label"), _pick("k", *_ROLES).alias("role"), _pick("k", *_PROFILES).alias("profile"),
        ), "conv_id",
    )


@query("w10_fewer_parts")
def _fewer(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_size").alias("word"), k, ((k % 23) / 40).alias("score"), (k % 5 + 1).alias("parts"), (k % 3).alias("singles"))
    return R.tie_break(rows, "word", "p_partkey")


@query("x18_fuzzy_lookup")
def _fuzzy(spark, d):
    needles = table(spark, d, "documents").select(F.explode(X.words(F.lower("text"))).alias("needle"))
    return fuzzy(needles, table(spark, d, "part").select(F.explode(X.words(F.lower("p_name"))).alias("word")))


@query("n24_conflicts", f"""
WITH p AS (SELECT p_partkey AS k, (p_partkey % 11) / 11 AS a, (p_partkey % 7) / 7 AS b, (p_size % 5) / 5 AS c, string_split(p_name, ' ') AS w, {_sql(_AXES, 'p_size')} AS r FROM part),
x AS (SELECT *, greatest(a, b, c) AS v, CASE WHEN a >= b AND a >= c THEN 1 WHEN b >= c THEN 2 ELSE 3 END AS axis FROM p),
s AS (SELECT x.*, y.w AS w2, y.r AS r2, y.axis AS axis2, y.v AS v2 FROM x JOIN x y ON y.k = x.k + 1)
SELECT k, concat_ws(',', CASE WHEN axis <> axis2 AND abs(v - v2) >= 0.35 THEN 'attachment_divergence' END, CASE WHEN len(list_intersect(w, w2)) / len(list_distinct(list_concat(w, w2))) < 0.45 AND w[1] <> w2[1] THEN 'effect_domain_divergence' END,
  CASE WHEN list_sort([r, r2]) = ['prefix', 'suffix'] THEN 'mixed_role_evidence' END, CASE WHEN w[1] = w2[2] OR w2[1] = w[2] THEN 'negative_contrast_conflict' END) AS flags FROM s""")
def _conflicts(spark, d):
    k, s, w, none = F.col("p_partkey"), F.col("p_size"), F.split("p_name", " "), F.lit(None).cast("long")
    axes = F.struct(((k % 11) / 11).alias("prefix"), ((k % 7) / 7).alias("suffix"), ((s % 5) / 5).alias("free"), *[none.alias(f"observed_{a}") for a in E.AXES])
    own = F.struct(axes.alias("attachment"), F.slice(w, 1, 1).alias("positive"), F.slice(w, 2, 1).alias("contrast"), F.array(w).alias("effects"), F.array(_pick("p_size", *_AXES)).alias("roles"))
    rows = table(spark, d, "part").select(k.alias("k"), own.alias("a"))
    both = rows.join(rows.select((F.col("k") - 1).alias("k"), F.col("a").alias("b")), "k")
    return both.select("k", F.array_join(E.conflicts(F.col("a"), F.col("b")), ",").alias("flags"))


@query("n26_alignment", f"""
WITH g AS (SELECT c_custkey AS m, c_custkey * 3 + g AS group_id, c_mktsegment AS label, (c_custkey + g) % 5 AS cl, (c_custkey % 10) / 10 AS pre, CASE WHEN g = 1 THEN (c_custkey % 4) / 4 END AS suf, c_custkey % 3 AS op, g AS os,
  {_sql(('a', 'b'), '(c_custkey + g)')} AS t, (c_custkey + g) % 13 / 10 AS rank_score, {_sql(_STATES, '(c_custkey + g)')} AS status FROM customer, range(3) r(g)),
p AS (SELECT o_orderkey, o_custkey AS m, {_sql(_AXES, 'o_orderkey')} AS role, o_orderkey % 5 AS cl, upper(trim({_sql(_WORDS, 'o_orderkey')})) AS word, {_sql(('a', 'b', 'c'), 'o_orderkey')} AS t FROM orders),
s AS (SELECT o_orderkey, group_id, label, status, 0.45::DOUBLE * (p.cl = g.cl)::INT + 0.25::DOUBLE * (word <> '' AND contains(label, word))::INT
  + 0.15::DOUBLE * CASE role WHEN 'prefix' THEN pre WHEN 'suffix' THEN coalesce(suf, CASE WHEN op + os > 0 THEN os / (op + os) END, 0) ELSE 0 END + 0.1::DOUBLE * CASE WHEN p.t = g.t THEN 1 ELSE 1 / 3 END + 0.05::DOUBLE * least(1, rank_score)
  - CASE status WHEN 'needs_review' THEN 0.08 WHEN 'split_recommended' THEN 0.12 WHEN 'provisional' THEN 0.02 ELSE 0 END::DOUBLE AS x FROM p JOIN g USING (m)),
k AS (SELECT o_orderkey, group_id, label, round(greatest(0, least(1, x)), 4)::DOUBLE AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, label, group_id) AS rank FROM k)
SELECT o_orderkey, group_id, score, rank FROM r WHERE rank <= 2""")
def _alignment(spark, d):
    c, g = F.col("c_custkey"), F.col("g")
    none, number = F.lit(None).cast("double"), F.lit(0).cast("long")
    axes = F.struct(((c % 10) / 10).alias("prefix"), F.when(g == 1, (c % 4) / 4).alias("suffix"), none.alias("free"), none.alias("infix"), (c % 3).alias("observed_prefix"), g.alias("observed_suffix"), number.alias("observed_free"), number.alias("observed_infix"))
    groups = table(spark, d, "customer").select(c, "c_mktsegment", F.explode(F.sequence(number, F.lit(2).cast("long"))).alias("g")).withColumn("n", c + g)
    groups = groups.select(
        c.alias("morph"), (c * 3 + g).alias("group_id"), F.col("c_mktsegment").alias("label"), F.array(F.col("n") % 5).alias("clusters"), F.array("c_mktsegment").alias("words"), F.array("c_mktsegment").alias("examples"),
        axes.alias("attachment"), F.array(_pick("n", "a", "b"), F.lit("d")).alias("terms"), (F.col("n") % 13 / 10).alias("rank_score"), _pick("n", *_STATES).alias("status"),
    )
    o = F.col("o_orderkey")
    parts = table(spark, d, "orders").select(o, F.col("o_custkey").alias("morph"), _pick("o_orderkey", *_AXES).alias("role"), F.array(o % 5).alias("clusters"), _pick("o_orderkey", *_WORDS).alias("word"), F.array(_pick("o_orderkey", "a", "b", "c"), F.lit("d")).alias("terms"))
    return E.align(parts, groups, "o_orderkey", 1)


@query("a17_attachments", """
WITH r AS (SELECT p_brand, p_size % 5 + 1 AS w, (p_partkey % 11) / 11 AS a, (p_partkey % 7) / 7 AS b, (p_size % 9) / 9 AS c, (p_partkey % 13) / 13 AS d, p_partkey % 50 AS n, p_size AS m, p_partkey % 3 AS k FROM part)
SELECT p_brand, round(sum(a * w) / sum(w), 4) AS prefix, round(sum(b * w) / sum(w), 4) AS suffix, round(sum(c * w) / sum(w), 4) AS free, round(sum(d * w) / sum(w), 4) AS productivity, max(n)::BIGINT AS observed_prefix, max(m)::BIGINT AS observed_suffix, max(k)::BIGINT AS observed_infix, 0::BIGINT AS observed_free,
  round(max(k) / (max(n) + max(m) + max(k)), 4) AS infix FROM r GROUP BY 1""")
def _attachments(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select(
        "p_brand", (s % 5 + 1).alias("weight"), ((k % 11) / 11).alias("prefix"), ((k % 7) / 7).alias("suffix"), ((s % 9) / 9).alias("free"), ((k % 13) / 13).alias("productivity"),
        (k % 50).alias("observed_prefix"), s.alias("observed_suffix"), (k % 3).alias("observed_infix"), F.lit(None).cast("long").alias("observed_free"), F.col("p_type").alias("estimated"),
    )
    return U.attachments(rows, "p_brand").drop("estimated")


@query("n37_word_functions")
def _functions(spark, d):
    """Parts of a name as morphs; a morph's profile is made of its checksum."""
    name = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("at", "morph"))
    draw = lambda k: (F.crc32(F.concat(F.upper("morph"), F.lit(f"/{k}"))) % 101) / 101
    whole = lambda k: (draw(k) * 9).cast("long")
    some = name.select("morph").distinct().where(draw("known") > 0.1)
    profiles = some.select(
        "morph", *[draw(c).alias(c) for c in ("nounness", "modifier", "verbness", "authority", "instability", "ambiguity", "prefix", "suffix", "infix", "free")], *[whole(f"observed_{p}").alias(f"observed_{p}") for p in U.PLACES],
        F.array(F.when(draw("e") > 0.7, "prefix-like").otherwise("plain")).alias("estimated"), F.when(draw("t") > 0.6, "a relation of Sequence").alias("terms"),
    )
    morphs = name.withColumn("support", _pick("at", "cluster", "attested", "residual", "other", "hypothesis")).withColumn("quality", F.when(F.col("at") == 1, 0.4))
    return U.functions(U.parts(morphs, profiles, "p_partkey"), "p_partkey")
