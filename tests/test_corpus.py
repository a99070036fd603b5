"""Scans of corpora, metrics, rules and profiles."""

import json

import pytest

from stratalex.sources import corpus


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_corpus(spark, tmp_path):
    (tmp_path / "t.txt").write_text('Ol sonf, "vors" g.\n\nGoho-Iad balt;\n  \nJW zir\n')
    assert rows(corpus.corpus(spark, str(tmp_path / "t.txt"))) == [(0, 0, "OL"), (0, 1, "SONF"), (0, 2, "VORS"), (0, 3, "G"), (1, 0, "GOHO"), (1, 1, "IAD"), (1, 2, "BALT"), (2, 0, "ZIR")]


@pytest.mark.parametrize("text, n", [('[{"from": "a"}, 3]', 1), ('{"rules": [{"from": "a"}, {"from": "b"}]}', 2), ("{broken", 0), ('{"x": 1}', 0), ('"text"', 0)])
def test_rules(spark, tmp_path, text, n):
    (tmp_path / "r.json").write_text(text)
    assert len(corpus.rules(spark, str(tmp_path / "r.json"))) == n


def test_table_or_empty(spark):
    assert corpus.table_or_empty(spark, "no_such_table", "a int, b string").columns == ["a", "b"]
    spark.range(2).createOrReplaceTempView("some_view")
    assert corpus.table_or_empty(spark, "some_view", "id long").count() == 2


def test_metrics(spark, tmp_path):
    lines = ['{"coverage_ratio": 0.5, "token": "a", "recon_error": 0.2}', "", "not json", '{"coverage_ratio_mean": 0.7, "residual_ratio": 0.3, "normalized": "b", "confidence": 0.9}', '{"token": "a", "recon_error": 0.4}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    means, errors = corpus.metrics(spark, str(tmp_path / "m.jsonl"))
    assert tuple(means.first()) == pytest.approx((0.6, 0.3, 0.9))
    assert rows(errors) == [("a", 0.4), ("b", 0.3)]


def test_trusted_seeds(spark):
    manual = spark.createDataFrame([(" manual ",), ("",)], "token string")
    entries = spark.createDataFrame([("Naz", "naz", [("nazaz",)]), ("ab", None, None), ("long word", "toolongforit", None)], "canonical string, normalized string, alternates array<struct<value:string>>")
    assert rows(corpus.trusted_seeds(manual.limit(0), entries)) == [("AB",), ("NAZ",), ("NAZAZ",)]
    assert rows(corpus.trusted_seeds(manual, entries, most=3)) == [("AB",), ("NAZ",)]
    known = spark.createDataFrame([("naz",)], "ngram string")
    assert rows(corpus.trusted_seeds(manual, entries, known)) == [("MANUAL",), ("NAZ",)]


def test_gloss_tokens(spark, tmp_path):
    entries = [{"word": "Ol", "definition": "to make", "key_citations": [{"location": "1", "context": "I make it"}]}, {"normalized": "zir", "definition": " ", "senses": [{"sense_id": 1, "definition": "I am"}]}, {"word": "ol", "definition": "maker"}]
    (tmp_path / "d.json").write_text(json.dumps(entries))
    assert rows(corpus.gloss_tokens(spark, str(tmp_path / "d.json"))) == [("ol", ["maker"], []), ("zir", ["i", "am"], [])]


def test_profiles(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yml").write_text("profiles:\n  - name: Poetic\n    head_terms: [light]\n  - name: plain\n    motif_terms: [a]\n")
    (tmp_path / "g.yml").write_text("plain:\n  motif_terms: [b, c]\n")
    got = corpus.profiles(spark, [{"name": "default", "head_terms": ["x"]}, {"name": "poetic"}], str(tmp_path / "m.yml"), str(tmp_path / "g.yml"))
    assert rows(got) == [("default", ["x"], [], "built-in"), ("plain", [], ["b", "c"], "generated"), ("poetic", ["light"], [], "manual")]
    (tmp_path / "d.yml").write_text("headword_to_domains:\n  River: [water, nature]\n  the: [x]\nheadword_stopwords: [The]\n")
    domains, stop = corpus.domain_config(spark, str(tmp_path / "d.yml"))
    assert rows(domains) == [("river", "NATURE"), ("river", "WATER")] and stop == ["the"]


def test_composites(spark):
    got = corpus.composites(spark.createDataFrame([("w", "g", 0.123456), (None, "x", 1.0)], "word string, gold_gloss string, error double"))
    assert rows(got) == [("w", None, "g", 0.1235, None)]
    assert rows(corpus.composites(spark.createDataFrame([("t",)], "token string"))) == [("t", None, None, 0.0, None)]
