import json

import pytest
from pyspark.sql import functions as F

from stratalex.operators import decision, phrases
from stratalex.operators import vectors as V
from stratalex.sources import files


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("left,right,expect", [
    (("conjunction", "noun"), ("plain", "noun"), ("coordination/apposition", "left_to_right", 0.9)),
    (("plain", "noun"), ("plain", "relational"), ("relational_attachment", "right_to_left", 1.2)),
    (("plain", "noun"), ("plain", "noun"), ("coordination/apposition", "left_to_right", 0.4)),
    ((None, None), (None, None), ("coordination/apposition", "left_to_right", 0.1)),
])
def test_relation(spark, left, right, expect):
    lit = lambda x: F.lit(x).cast("string")
    assert tuple(one(spark, phrases.relation(lit(left[0]), lit(right[0]), lit(left[1]), lit(right[1])))) == expect


@pytest.mark.parametrize("chunks,draft", [
    (["and", "and", "fire"], "and fire"), (["in her", "her light"], "in her light"), (["fire", "fire"], "fire fire"), (["", None, "that", "", "that"], "that"), ([], ""), (["her", "her her", "sun"], "her sun"),
])
def test_skeleton(spark, chunks, draft):
    df = spark.createDataFrame([(chunks,)], "c array<string>")
    assert df.select(phrases.skeleton(F.col("c")).alias("x")).first()["x"] == draft


def test_contradiction(spark):
    pairs = [("light", "dark"), ("up", "down"), ("in", "out")]
    assert one(spark, decision.contradiction(F.lit("Light and dark, up or downward"), pairs)) == pytest.approx(0.2)
    assert one(spark, decision.contradiction(F.lit("light dark up down in out"), pairs)) == 0.5
    assert one(spark, decision.contradiction(F.lit("light dark"), pairs, compat_zero=True)) == 0
    assert one(spark, decision.contradiction(F.lit(None).cast("string"), pairs)) == 0


def test_votes(spark):
    rows = spark.createDataFrame([(1, "a", 2, False, 1), (1, "b", 2, True, 2), (2, "x", 1, False, 5), (2, "y", 1, False, 4), (3, None, 9, True, 1)], "item int, label string, votes int, cited boolean, at int")
    assert {(r["item"], r["label"], r["votes"]) for r in decision.votes(rows, "item").collect()} == {(1, "b", 2), (2, "y", 1)}


def test_merge_verdict(spark):
    some = F.array(F.lit("x"))
    got = [one(spark, decision.merge_verdict(F.lit(s), c)) for s, c in ((0.7, some), (0.8, some), (0.8, F.array()), (0.9, some))]
    assert got == ["apart", "rejected", "merged", "merged"]


def test_kmeans(spark):
    rows = spark.createDataFrame([(i, [1.0, i * 0.01] if i < 5 else [i * 0.01, -1.0]) for i in range(10)] + [(10, [0.0, 0.0])], "id int, vec array<double>")
    got = {r["id"]: r["cluster"] for r in V.kmeans(rows, "id", 2).collect()}
    assert len(got) == 10 and len({got[i] for i in range(5)}) == 1 and {got[i] for i in range(5)} != {got[i] for i in range(5, 10)}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n[1]\n{"a": 2, "b": "x"}\n{"a": \n')
    got = files.json_lines(spark, str(tmp_path / "a.jsonl"), "a int, b string").orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, None), (2, "x")]


def test_dictionary(spark, tmp_path):
    listed = [{"word": "Ab", "definition": "one", "canon_word": True, "pos": "noun", "context_tags": ["t"], "senses": [{"sense_id": 7, "definition": "s1"}, {"definition": "s2"}]}, {"word": "No", "canon_word": False}, {"word": "ab ", "definition": "two", "context_tags": ["t", "u"], "alternates": [{"value": "aab", "confidence": 0.5}]}]
    (tmp_path / "l.json").write_text(json.dumps(listed, indent=1))
    (tmp_path / "k.json").write_text(json.dumps({"Naz": {"definition": "pillar"}}))
    entries = files.dictionary(spark, str(tmp_path / "l.json"))
    assert {r["word"] for r in entries.collect()} == {"Ab", "ab "}
    assert {r["word"] for r in files.dictionary(spark, str(tmp_path / "k.json")).collect()} == {"Naz"}
    assert {(r["word"], r["definition"], r["sense_id"]) for r in files.senses(entries).collect()} == {("Ab", "s1", 7), ("Ab", "s2", 2), ("ab", "two", 1)}
    [m] = files.merged(entries).collect()
    assert (m["normalized"], m["words"], m["definitions"], m["tags"], m["alternates"], m["pos"]) == ("ab", ["Ab", "ab "], ["one", "two"], ["t", "u"], ["aab"], "noun")


def test_grid(spark, tmp_path):
    (tmp_path / "leaf.json").write_text(json.dumps({"artifact": {"kind": "grid", "name": "g"}, "grid_lines": ["A| |B ^[90]", "[LACUNA]|[NULL]|c"]}))
    (tmp_path / "none.json").write_text(json.dumps({"artifact": {"kind": "grid", "name": "h"}, "grid_lines": []}))
    got = files.grid_cells(files.leaves(spark, str(tmp_path))).orderBy("line", "cell").collect()
    assert [(r["token"], r["orientation"], r["state"]) for r in got] == [("A", None, "text"), (None, None, "blank"), ("B", 90, "text"), (None, None, "lacuna"), (None, None, "blank"), ("c", None, "text")]


def test_lists_and_sinks(spark, tmp_path):
    assert one(spark, files.floats(F.lit("[1, 2.5]"))) == [1.0, 2.5] and one(spark, files.floats(F.lit("1,x"))) is None
    assert one(spark, files.strings(F.lit("a| b,,c"))) == ["a", "b", "c"] and one(spark, files.strings(F.lit('["a", " "]'))) == ["a"]
    files.write_csv(spark.createDataFrame([(2, "b"), (1, "a")], "n int, t string"), str(tmp_path / "o"), ["n"])
    assert [r["t"] for r in spark.read.csv(str(tmp_path / "o"), header=True).orderBy("n").collect()] == ["a", "b"]


def test_command_line(spark, tmp_path, capsys):
    from stratalex.__main__ import main

    main(["list"])
    assert "n35_decision_score" in capsys.readouterr().out.split()
    main(["run", "n35_decision_score", "/root/testdata/sf0.001", str(tmp_path / "o"), "--format", "json"])
    assert spark.read.json(str(tmp_path / "o")).columns == ["p_partkey", "score"]
