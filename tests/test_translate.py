"""Translations of words, and the commands over them."""

import json
import math

import pytest

from stratalex.operators import scoring
from stratalex.operators.translate import translations

SENSES = [("naz", 1, "pillar"), ("psad", 1, "root meaning pride"), ("psad", 2, "pride"), ("ps", 1, "in"), ("ad", 1, "the digits 19"), ("nazpsad", 1, "sword"), ("x", 1, " "), ("na", 1, "lord"), ("zpsad", 1, "edge")]


def _score(parts, bonus, penalty=0.0):
    n = {p: sum(s.upper() == p and d.strip() != "" for s, _, d in SENSES) for p in parts}
    size = sum(map(len, parts))
    specific = sum(len(p) / (1 + math.log1p(n[p] - 1)) for p in parts) / size
    vague = sum(len(p) * (0 if n[p] <= 1 else min(1, math.log1p(n[p] - 1) / math.log1p(8))) for p in parts) / size
    w = {k: scoring.WEIGHTS[k] for k in ("coverage", "specificity", "ambiguity")}
    return (w["coverage"] + w["specificity"] * specific + w["ambiguity"] * vague) / sum(map(abs, w.values())) + bonus(parts) - penalty


@pytest.mark.parametrize("strategy", ["prefer-fewer", "prefer-balance", "other"])
def test_translations(spark, strategy):
    variance = lambda p: sum((len(x) - sum(map(len, p)) / len(p)) ** 2 for x in p) / len(p)
    bonus = {"prefer-fewer": lambda p: -0.5 * len(p), "prefer-balance": lambda p: 0.5 * sum(len(x) ** 2 for x in p) / sum(map(len, p)) ** 2 - 0.2 * variance(p), "other": lambda p: 0.0}[strategy]
    senses = spark.createDataFrame(SENSES, "normalized string, sense_id int, definition string")
    words = spark.createDataFrame([("NazPsad",), ("nazpsad",), ("zzz",), (None,), ("",)], "word string")
    got = translations(words, senses, strategy, top=10).orderBy("rank").collect()
    want = {("NAZPSAD",): 0.0, ("NAZ", "PSAD"): 0.0, ("NAZ", "PS", "AD"): 4.0, ("NA", "ZPSAD"): 0.0}
    want = {"+".join(p): _score(p, bonus, n) for p, n in want.items()}
    assert {r["word"] for r in got} == {"NAZPSAD"} and (got[0]["analysis"], got[0]["reading"], got[0]["score"]) == ("dictionary_exact", "sword", 200.0)
    assert {r["pieces"]: r["score"] for r in got[1:]} == pytest.approx(want, abs=1e-6)
    assert {r["pieces"]: r["reading"] for r in got}["NAZ+PSAD"] == "pillar; pride"
    blind = translations(words, senses, strategy, whole_words=False).collect()
    assert {r["pieces"] for r in blind} == set(want) - {"NAZPSAD"}


def test_commands(spark, tmp_path):
    from stratalex.__main__ import main

    entries = [{"word": w, "normalized": w, "canon_word": True, "definition": d} for w, _, d in SENSES if w in ("naz", "ps", "ad", "na")]
    (tmp_path / "d.json").write_text(json.dumps(entries))
    spark.createDataFrame([("NAZPS",)], "word string").write.parquet(f"{tmp_path}/w")
    main(["translate-word", f"{tmp_path}/w", f"{tmp_path}/d.json", f"{tmp_path}/t"])
    assert [r["pieces"] for r in spark.read.parquet(f"{tmp_path}/t").collect()] == ["NAZ+PS"]
    main(["preanalyze", f"{tmp_path}/d.json", f"{tmp_path}/s", "--most", "2"])
    assert {r["token"] for r in spark.read.parquet(f"{tmp_path}/s").collect()} == {"PS", "AD", "NA"}
    spark.createDataFrame([("naz", "NAZPSAD", [(0, 3, "naz"), (0, 7, "nazpsad")])], "root string, word string, segments array<struct<s:int,e:int,canonical:string>>").write.parquet(f"{tmp_path}/r")
    main(["refresh", f"{tmp_path}/r", f"{tmp_path}/o"])
    r = spark.read.parquet(f"{tmp_path}/o").first()
    assert (round(r["coverage"], 6), round(r["residual"], 6), r["uncovered"]) == (round(3 / 7, 6), round(4 / 7, 6), ["PSAD"])
    spark.createDataFrame([("ab", ["a", "a", "b"]), ("c", ["c"])], "token string, morphs array<string>").write.parquet(f"{tmp_path}/m")
    spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "morph string, vec array<double>").write.parquet(f"{tmp_path}/v")
    main(["composite", f"{tmp_path}/m", f"{tmp_path}/v", f"{tmp_path}/c", "--size", "2"])
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/c").collect()] == [("ab", ["a", "b"], [0.5, 0.5])]
