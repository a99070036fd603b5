import math
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import stats, text
from stratalex.functions.vectors import cosine, unit
from stratalex.operators import enrichment, graph, ngrams, residual, scoring, segment, store
from stratalex.operators import vectors as V
from stratalex.operators.collocation import collocations
from stratalex.operators.composition import cluster_cohesion
from stratalex.operators.factorize import ridge
from stratalex.streaming.events import running_lexicon, windowed


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("host,root,starts,residuals,removed", [
    ("NAZPSAD", "NAZ", [0], ["PSAD"], "PSAD"),
    ("ANAZNAZ", "NAZ", [1, 4], ["ANAZ", "ANAZ"], "A"),
    ("NazPsad", "naz", [0], ["Psad"], "Psad"),
    ("NAZNMPSADNI", "ZNI", [], [], None),
    ("NAZNMPSADNI", "N", [0, 3, 9], ["AZNMPSADNI", "NAZMPSADNI", "NAZNMPSADI"], "AZMPSADI"),
    ("ANANA", "ANA", [0, 2], ["NA", "AN"], ""),
])
def test_subtraction(spark, host, root, starts, residuals, removed):
    rows = residual.subtract(spark.createDataFrame([(host, root)], "host string, root string")).orderBy("nth").collect()
    assert [r["start"] for r in rows] == starts and [r["residual"] for r in rows] == residuals
    assert all(r["removed_all"] == removed for r in rows)


def test_coverage(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in ((4, 6), (0, 3), (1, 4))])
    assert one(spark, residual.covered(F.lit(10), spans)) == 6
    assert [(g["s"], g["e"]) for g in one(spark, residual.gaps(F.lit(10), spans))] == [(6, 10)]


def test_strings(spark):
    assert one(spark, text.letters_only(F.lit(" A-B 1! "))) == "ab"
    assert one(spark, text.occurrences(F.lit("anana"), F.lit("ana"))) == [0, 2]
    assert one(spark, text.occurrences(F.lit(""), F.lit("ana"))) == []
    assert [g["gram"] for g in one(spark, text.char_ngrams(F.lit("abc"), 2, 4))] == ["ab", "bc", "abc"]
    assert one(spark, text.collapse_repeats(F.array(*map(F.lit, "aabba")))) == ["a", "b", "a"]
    assert one(spark, text.replaced_variants(F.lit("YU"), [("Y", "I"), ("U", "V")])) == ["YU", "IU", "IV", "YV"]
    assert one(spark, text.windows(F.array(*map(F.lit, "abcde")), 2, 2)) == [["a", "b"], ["c", "d"]]
    assert one(spark, text.terms(F.lit("Light, fire / fire or dawn"))) == ["light", "fire", "dawn"]


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    for a, b, want in (((1, 0), (1, 0), 1), ((1, 0), (0, 1), 0), ((1, 0), (-1, 0), -1), ((0, 0), (1, 0), 0)):
        assert one(spark, cosine(v(*a), v(*b))) == pytest.approx(want)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 1.0])], "k int, vec array<double>")
    assert V.cohesion(rows, "k").first()["cohesion"] == pytest.approx((0 + 2 * math.sqrt(0.5)) / 3)


def test_cluster_cohesion_of_many_rows(spark):
    vectors = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, -1.0], [0.0, 0.0], [2.0, 0.5]]
    few = [(k, vectors[(i * i + k) % 6]) for k in range(3) for i in range(20)] + [(3, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0])]
    got = {r["k"]: r["cohesion"] for r in cluster_cohesion(spark.createDataFrame(few, "k int, vec array<double>"), "k").collect()}

    def cos(a, b):
        size = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    for k in range(3):
        own = [v for key, v in few if key == k]
        each = [c for i, a in enumerate(own) for b in own[:i] if (c := cos(a, b))]
        assert got[k] == pytest.approx(sum(each) / len(each), abs=6e-4)
    assert got[3] == got[4] == got[None] == 0
    # half a million rows in one cluster, by pairs 10^11: an array of them all, or their pairs, would end no test
    many = spark.range(500_000).selectExpr("1 as k", "if(id % 2 = 0, array(1D, 0D), array(1D, 1D)) as vec")
    assert cluster_cohesion(many, "k").first()["cohesion"] == pytest.approx(0.5 + math.sqrt(0.5) / 2, abs=6e-4)


def test_nearest_against_all_pairs(spark, monkeypatch):
    """Against a plain join, over several blocks: with copies, vectors without a direction, null ones, null places, other lengths, ids of strings."""
    rng = random.Random(5)
    vec = lambda n=4: [float(rng.randrange(-3, 4)) for _ in range(n)]
    rows = [(i, vec(), vec(), 0.5, 0.3 if i % 2 else 0.45) for i in range(40)] + [(40, vec(3), vec(3), 0.5, 0.3), (41, None, vec(), 0.5, 0.3)]
    senses = [(f"s{i}", vec()) for i in range(150)] + [(f"t{i}", [1.0, 2.0, -1.0, 0.0]) for i in range(60)] + [("u", None), ("v", [0.0] * 4), ("w", [1.0, None, 1.0, 1.0]), ("x", vec(3)), (None, vec()), ("y", [math.nan, 1.0, 1.0, 1.0])]
    words = spark.createDataFrame(rows, "item long, vec array<double>, anchor_vec array<double>, before double, after double")
    known = spark.createDataFrame(senses, "sense string, sense_vec array<double>")
    d = words.select("item", unit(F.zip_with("vec", "anchor_vec", lambda a, b: a - b)).alias("d"), (F.col("before") - F.col("after") >= 0.1).alias("accepted")).where("d is not null")
    pairs = d.crossJoin(known).select("item", "sense", F.round(cosine(F.col("d"), F.col("sense_vec")), 9).alias("sim"), "accepted")
    want = pairs.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sim"), "sense"))).where("place <= 5").collect()
    monkeypatch.setattr(V, "BLOCK", 64)
    got = enrichment.delta_senses(words, known).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 150
    none = known.where("false")
    assert enrichment.delta_senses(words, none).count() == enrichment.delta_senses(words.where("false"), known).count() == 0


def test_delta_senses_of_a_larger_dictionary(spark):
    """64 million pairs of 64 places, which expressions over arrays would take minutes for."""
    vec = lambda seed: F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin((F.col("id") + seed) * i * i))
    words = spark.range(8000).select(F.col("id").alias("item"), vec(1).alias("vec"), vec(7).alias("anchor_vec"), F.lit(0.5).alias("before"), F.lit(0.3).alias("after"))
    began = time.monotonic()
    got = enrichment.delta_senses(words, spark.range(8000).select(F.col("id").alias("sense"), vec(3).alias("sense_vec")))
    assert got.groupBy("item").count().where("count = 5").count() == 8000
    assert time.monotonic() - began < 60


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 9), (9, 8)]
    got = {r["node"]: r["component"] for r in graph.connect(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8}


def test_collocations(spark):
    got = collocations(spark.createDataFrame([("a", "b", 4), ("a", "c", 2)], "l string, r string, n long"), 2).orderBy("r").collect()
    assert [(r["count_a"], r["count_b"]) for r in got] == [(6, 4), (6, 2)]
    assert got[0]["pmi"] == pytest.approx(math.log2(4 * 6 / (6 * 4))) and got[0]["asymmetry"] == pytest.approx(4 / 6 - 1)


def test_index_and_entropy(spark):
    got = {r["gram"]: (r["tf"], r["df"]) for r in ngrams.index(spark.createDataFrame([("aaa", 2), ("aab", 1)], "word string, n long"), 2, 2).collect()}
    assert got == {"aa": (5, 2), "ab": (1, 1)}
    e = ngrams.neighbour_entropy(spark.createDataFrame([("a", "x", 1), ("a", "y", 1)], "l string, r string, n long"), "l").first()
    assert e["entropy"] == pytest.approx(1.0)
    p = {r["item"]: (r["initial"], r["medial"], r["final"]) for r in ngrams.positions(spark.createDataFrame([(["a"],), (["a", "b", "c"],)], "w array<string>"), "w").collect()}
    assert p == {"a": (2, 0, 1), "b": (0, 1, 0), "c": (0, 0, 1)}


def test_segmentation():
    index = {g: (3, 1, True) for g in ("naz", "psad", "ps", "ad", "nazp", "sad")}
    assert segment.beam("nazpsad", index, 6)[0][1] in {("naz", "psad"), ("naz", "ps", "ad"), ("nazp", "sad")}
    assert segment.beam("", index, 6) == [] and segment.beam("zzz", index, 6) == []
    assert segment.covers("debuheka", {"de", "bu", "he", "ka"}) == [("de", "bu", "he", "ka")]
    assert segment.breakable("nazad", {"naz", "ad"}) and not segment.breakable("nazx", {"naz", "ad"})
    assert segment.isolatable("adnazps", "naz", {"ad", "ps"}) and not segment.isolatable("adnazpx", "naz", {"ad", "ps"})
    assert segment.splits("abcd") == [("ab", "cd"), ("abcd",)]
    assert segment.greedy_clusters([([1.0, 0.0], 1), ([0.0, 1.0], 1), ([0.9, 0.1], 1)]) == [0, 1, 0]


def test_segment_by_word(spark):
    rows = spark.createDataFrame([("nazps", g, 3, 1, True) for g in ("naz", "ps", "na", "zps")], "word string, gram string, tf long, df long, attested boolean")
    got = segment.segment(rows, 10).orderBy("rank").collect()
    assert {tuple(r["segments"]) for r in got} == {("naz", "ps"), ("na", "zps")} and [r["rank"] for r in got] == [1, 2]


def test_store(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, note string")
    s = spark.createDataFrame([(2, None, None), (3, "c", "z")], "id int, name string, note string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(store.coalesce_upsert(t, s, ["id"], ("note",))) == [(1, "a", "x"), (2, "b", None), (3, "c", "z")]
    assert [r[0] for r in rows(store.insert_or_ignore(t, s, ["id"]))] == [1, 2, 3]
    assert rows(store.upsert(t, s.where("id = 3"), ["id"])) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]


def test_scores(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0)], "k int, v double")
    assert [r["s"] for r in scoring.min_max(rows, "k", "v", "s").orderBy("k", "v").collect()] == [0.0, 1.0, 1.0]
    assert one(spark, stats.cohesion_floor(F.lit(4), F.lit(2))) == pytest.approx(0.22)
    assert one(spark, stats.pmi(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == pytest.approx(math.log2(1e-9))


def test_ridge(spark):
    counts = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "token int, item string, n long")
    targets = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "token int, vec array<double>")
    got = {r["item"]: r["vec"] for r in ridge(counts, targets, 0.05).collect()}
    assert got["a"] == pytest.approx([1 / 1.05, 0]) and got["b"] == pytest.approx([0, 2 / 1.05])


def test_lexicon_in_batches(spark):
    state = running_lexicon(spark.createDataFrame([], "token string, conf double, n long"), spark.createDataFrame([("a", 1.0), ("a", 0.0)], "token string, conf double"))
    state = running_lexicon(state, spark.createDataFrame([("a", 0.5), ("b", 1.0)], "token string, conf double"))
    assert {r["token"]: (r["conf"], r["n"]) for r in state.collect()} == {"a": (0.5, 3), "b": (1.0, 1)}


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'x' as event_type, 1.0D as value union all select timestamp'2024-01-01 00:50:00', 'x', 2.0D")
    rows.write.parquet(str(tmp_path / "in"))
    q = windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["total"]) for r in spark.table("w").collect()] == [(2, 3.0)]


def test_replace_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (3, 5):
        store.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_segment_query_against_every_cover(spark):
    """On short words the beam drops nothing, so its best cover is the best of all."""
    from stratalex.plans import text_queries

    got = {r["word"]: r for r in text_queries.QUERIES["n1_beam_segmentation"](spark, "/root/testdata/sf0.001").where("rank = 1 and length(word) between 2 and 6").collect()}
    words = [r["word"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("explode(regexp_extract_all(lower(text), '[a-z]+', 0)) as word").distinct().collect()]
    tf, df = {}, {}
    counts = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("explode(regexp_extract_all(lower(text), '[a-z]+', 0)) as word").groupBy("word").count().collect():
        counts[r["word"]] = r["count"]
    for w, n in counts.items():
        grams = [w[i : i + k] for k in range(2, 8) for i in range(len(w) - k + 1)]
        for g in grams:
            tf[g] = tf.get(g, 0) + n
        for g in set(grams):
            df[g] = df.get(g, 0) + 1
    for w, r in got.items():
        covers = [c for c in segment.splits(w, 2) if c]
        score = lambda c: sum(segment.segment_score(g, sum(map(len, c[:k])), sum(map(len, c[: k + 1])), len(w), tf[g], df[g], len(words), g in counts) for k, g in enumerate(c))  # noqa: B023, E731
        assert r["score"] == pytest.approx(max(map(score, covers)), abs=1e-5), w
    assert len(got) > 50
