import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from stratalex.operators import evidence, lookup, readings
from stratalex.plans import registry
from stratalex.sources import files

DATA = "/root/testdata/sf0.001"


def subsequence(a, b):
    """Longest common subsequence by the table of all prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row[-1]


def close(needles, words, least=70, most=10):
    out = set()
    for n in needles:
        hits = [(-200 * c / (len(n) + len(w)), w) for w in words if 200 * (c := subsequence(n, w)) >= least * (len(n) + len(w))]
        out |= {(n, w, round(-r, 6), k) for k, (r, w) in enumerate(sorted(hits)[:most], 1)}
    return out


def rows(df):
    return {tuple(round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()}


@pytest.mark.parametrize("least", [40, 70, 100])
def test_fuzzy(spark, least):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
    needles, words = {word() for _ in range(60)}, {word() for _ in range(80)}
    a = spark.createDataFrame([(x,) for x in [*needles, None, "", next(iter(needles))]], "needle string")
    b = spark.createDataFrame([(x,) for x in [*words, None, ""]], "word string")
    assert rows(lookup.fuzzy(a, b, least, 4)) == close(needles, words, least, 4)
    assert not rows(lookup.fuzzy(a.limit(0), b, least))


def test_fuzzy_query(spark):
    import re

    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    needles = {w for r in docs for w in re.findall("[A-Za-z]+", (r["text"] or "").lower())}
    words = {w for r in spark.read.parquet(f"{DATA}/part.parquet").collect() for w in re.findall("[A-Za-z]+", r["p_name"].lower())}
    assert rows(registry.queries()["x18_fuzzy_lookup"](spark, DATA)) == close(needles, words)


def candidates(spark):
    rng, out = random.Random(3), []
    for phrase, at, choice in itertools.product(range(6), range(3), range(2)):
        label = rng.choice(["noun", "Verb", "modifier", "operator", "mixed", "?", None])
        out.append((phrase, at, choice, rng.random() * 4, rng.random(), rng.random(), ["a"] * rng.randint(0, 5), rng.choice(["x", "", None]), rng.random() < 0.5, rng.random() < 0.3, label, rng.choice(["noun", "verb", "relational", None]), rng.choice(["plain", "conjunction", "relative"])))
    return spark.createDataFrame(out, "phrase long, at long, choice long, score double, confidence double, coherence double, parts array<string>, definition string, provisional boolean, rescued boolean, label string, role string, profile string")


def test_beam_finds_the_best_of_all(spark):
    """Eight parses a phrase fit the beam, so it has to agree with all of them in order."""
    df = candidates(spark)
    marked = df.select("*", readings.own_worth().alias("worth"), readings.open_reading().alias("open"), F.coalesce(readings.family(F.col("label")), F.lit("unknown")).alias("family")).collect()
    got = rows(readings.phrase_beam(df, "phrase", 8))
    for phrase in range(6):
        own = [[r.asDict() for r in marked if r["phrase"] == phrase and r["at"] == at] for at in range(3)]
        every = [(sum(c["worth"] - 1.5 * c["open"] for c in p) + sum(readings.link(a, b) for a, b in itertools.pairwise(p)), tuple(c["choice"] for c in p)) for p in itertools.product(*own)]
        expect = sorted((round(s, 6) for s, _ in every), reverse=True)
        mine = sorted((r for r in got if r[0] == phrase), key=lambda r: r[1])
        assert [r[2] for r in mine] == pytest.approx(expect, abs=1e-5)
        assert {(r[2], r[3]) for r in mine} == {(round(s, 6), c) for s, c in every}
    assert rows(readings.phrase_beam(df.limit(0), "phrase")) == set()


def test_transition_is_the_same_in_both_forms(spark):
    some = [(a, b, x, y) for a in ("noun", "predicate", "modifier", "relational", "mixed", "unknown") for b in ("noun", "predicate", "mixed") for x in (0.0, 0.43) for y in (0.0, 1.0)]
    df = spark.createDataFrame(some, "a string, b string, x double, y double")
    got = [r[0] for r in df.select(readings.transition(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).collect()]
    assert got == pytest.approx([readings._transition({"family": a, "confidence": x}, {"family": b, "confidence": y}) for a, b, x, y in some], abs=1.01e-4)


def test_tie_break(spark):
    df = spark.createDataFrame([("w", 1, 1.0, 4, 0), ("w", 2, 0.95, 2, 0), ("w", 3, 0.94, 1, 0), ("w", 4, 0.5, 1, 0), ("v", 9, None, None, None), ("v", 8, 0.0, 0, 0)], "word string, r int, score double, parts long, singles long")
    got = {(r["word"], r["r"]): (r["rank"], r["moved"]) for r in readings.tie_break(df, "word", "r").collect()}
    assert got == {("w", 3): (1, True), ("w", 2): (2, True), ("w", 1): (3, False), ("w", 4): (4, False), ("v", 8): (1, False), ("v", 9): (2, False)}
    wide = [{"score": 1.0, "parts": 4, "singles": 3}, {"score": 0.8, "parts": 1, "singles": 0}]
    assert [r["parts"] for r in readings.fewer_parts(wide, margin=0.3)] == [4, 1] and [r["parts"] for r in readings.fewer_parts(wide, margin=0.3, clear=0.5)] == [1, 4]


def test_conflicts(spark):
    kind = "struct<attachment:struct<prefix:double,suffix:double,free:double,observed_prefix:long,observed_suffix:long,observed_free:long>,positive:array<string>,contrast:array<string>,effects:array<array<string>>,roles:array<string>>"
    a = ((0.9, 0.1, None, None, None, None), ["fire"], [], [["burn"]], ["prefix"])
    b = ((None, None, None, 0, 3, 1), ["sea"], ["fire"], [["wet"], ["burn", "sea", "far"]], ["suffix"])
    c = ((0.9, None, None, 1, 1, 1), None, None, None, None)
    d = ((None, None, None, 1, 4, 5), [], None, [], [])
    df = spark.createDataFrame([(1, a, b), (2, a, c), (3, c, d), (4, None, None), (5, d, a)], f"k int, a {kind}, b {kind}")
    got = {r[0]: r[1] for r in df.select("k", evidence.conflicts(F.col("a"), F.col("b"))).collect()}
    assert got == {1: ["effect_domain_divergence", "mixed_role_evidence", "negative_contrast_conflict"], 2: [], 3: ["attachment_divergence"], 4: [], 5: ["attachment_divergence"]}


def test_dictionary_forms(spark, tmp_path):
    cite = {"location": "K1", "context": "c"}
    listed = [
        {"word": "Ⅳ", "normalized": "IV", "definition": " four ", "commentary": "x", "key_citations": [cite], "senses": []},
        {"word": "iv", "definition": "top", "canon_word": True, "context_tags": [" T", ""], "senses": [{"sense_id": 0, "definition": "s", "confidence": 0.5, "key_citations": [cite]}, {"definition": " "}]},
        {"word": "ⅳ", "key_citations": [cite], "pos": "noun", "commentary": "x"}, {"word": " "},
    ]
    (tmp_path / "l.json").write_text(json.dumps(listed))
    entries = files.dictionary(spark, str(tmp_path / "l.json"))
    [m] = files.merged(entries).collect()
    assert (m["normalized"], m["tags"], m["commentary"], m["pos"], m["canon_word"], len(m["citations"])) == ("iv", ["t"], "x", "noun", True, 1)
    assert [tuple(s) for s in m["senses"]] == [("s", 0.5)]
    flat = sorted((r["canonical"], [*r["alternates"]], [tuple(s) for s in r["senses"]]) for r in files.flat(entries).collect())
    assert flat == [("iv", [], [("top", 1.0), ("s", 0.5)]), ("iv", ["ⅳ"], [("four", 1.0)]), ("ⅳ", [], [])]
    assert sorted((r["definition"], r["sense_id"], r["citations"] is not None, r["canon"]) for r in files.senses(entries).collect()) == [("four", 1, True, False), ("s", 1, True, True), ("top", 2, False, True)]


@pytest.mark.parametrize("raw,expect", [
    ("abc", ("abc", False, None, False, False, False)), ("Ab?c*,.", ("Abc", False, ",.", True, True, True)), ("a! [SIC] ", ("a", True, "!", False, False, False)),
    ("a,b. ;", ("a,b", False, ".;", False, False, False)), ("é", ("é", False, None, False, False, False)), ("?", ("", False, "?", False, False, False)),
])
def test_flags(spark, raw, expect):
    df = spark.createDataFrame([(raw, None)], "raw string, meta map<string,string>")
    assert tuple(files._peeled(df, "raw", []).first()) == expect


def test_leaf_metadata(spark, tmp_path):
    leaf = {"artifact": {"kind": "square", "name": "g", "meta": {"lacuna_token": "#", "intentionally_empty": "-", "uncertain_marker": "~"}}, "grid_lines": ["#|-|null|A~^[-45]|b?. ^90|..."], "blocks": ["one two,  three*"]}
    (tmp_path / "leaf.json").write_text(json.dumps(leaf))
    leaves = files.leaves(spark, str(tmp_path))
    got = [(r["state"], r["token"], r["orientation"], r["uncertain"]) for r in files.grid_cells(leaves).orderBy("cell").collect()]
    assert got[3:] == [("text", "A", -45, True), ("text", "b", 90, False), ("blank", None, None, False)]
    assert [g[0] for g in got[:3]] == ["lacuna", "blank", "blank"]
    assert [(r["token"], r["trail_punct"], r["bold"]) for r in files.prose_tokens(leaves).orderBy("place").collect()] == [("one", None, False), ("two", ",", False), ("three", None, True)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, ["x"]), ('a"', None, [])], "name string, n int, tags array<string>")
    files.write_yaml(df, str(tmp_path / "y"), "name")
    assert "".join(sorted(p.read_text() for p in (tmp_path / "y").glob("part-*"))) == '"a\\"": {"tags":[]}\n"b": {"n":1,"tags":["x"]}\n'
    files.write_html(spark, {"A & B": df.orderBy("name"), "none": df.limit(0)}, str(tmp_path / "h"), "<t>")
    page = "".join(p.read_text() for p in (tmp_path / "h").glob("part-*"))
    assert "<h1>&lt;t&gt;</h1>" in page and "<td>b</td><td>1</td>" in page and "no rows" in page


def test_functions(spark):
    import math

    from stratalex.operators import functional

    rng, unit = random.Random(8), lambda x: max(0.0, min(1.0, x))
    profiles = {}
    for m in "ABCDEF":
        profiles[m] = {k: rng.random() for k in ("nounness", "modifier", "verbness", "authority", "instability", "ambiguity", "prefix", "suffix", "infix", "free")} | {f"observed_{p}": rng.randint(0, 3) * (m != "B") for p in functional.PLACES}
        profiles[m] |= {"estimated": ["Prefix-like"] if m in "AC" else [], "terms": "clause relation; negationless" if m in "AD" else None}
    words = [[rng.choice("ABCDEFG") + "X" * rng.randint(0, 0) for _ in range(rng.randint(1, 5))] for _ in range(40)]
    prof = spark.createDataFrame([(m, *p.values()) for m, p in profiles.items()], "morph string, " + ", ".join(f"{k} {'double' if i < 10 else 'long' if i < 14 else 'array<string>' if i < 15 else 'string'}" for i, k in enumerate(profiles["A"])))
    morphs = spark.createDataFrame([(w, i, m.lower(), "residual" if i % 2 else None, 0.9 if m == "E" else None) for w, ms in enumerate(words) for i, m in enumerate(ms)] + [(99, 0, "", None, None), (99, 1, None, None, None)], "word long, at int, morph string, support string, quality double")
    got = {r["word"]: r for r in functional.functions(functional.parts(morphs, prof, "word"), "word").collect()}
    assert set(got) == set(range(40))
    seen = set()
    for w, ms in enumerate(words):
        s = []
        for i, m in enumerate(ms):
            if m not in profiles:
                s.append((m, False, 0.5, 0.0, 0.0, 0.0, 0.0, 0.75, "unknown", (0, 0, 0)))
                continue
            p = profiles[m]
            place = "free" if len(ms) == 1 else "prefix" if i == 0 else "suffix" if i == len(ms) - 1 else "infix"
            n = sum(p[f"observed_{x}"] for x in functional.PLACES)
            share = p[f"observed_{place}"] / n if n else 0
            fit = 0.55 * p[place] + 0.45 * share if share else p[place]
            quality, steady = 0.9 if m == "E" else 0.75 if i % 2 else 0.2, 1 - p["instability"]
            op = unit(0.65 * p["modifier"] + (0.4 if m in "AD" else 0) + (0.15 if m in "AC" else 0))
            head = unit(0.22 * quality + 0.2 * max(p["nounness"], p["verbness"]) + 0.17 * steady + 0.16 * fit + 0.15 * p["authority"] + 0.1 * math.log(2) / math.log(8) - 0.18 * op)
            mod = unit(0.45 * p["modifier"] + 0.2 * op + 0.18 * fit + 0.1 * quality + 0.07 * steady)
            doubt = 0.45 * p["ambiguity"] + 0.35 * p["instability"] + 0.2 * (1 - p["authority"])
            role = "uncertain" if doubt >= 0.72 else "operator" if op >= 0.58 and op >= head + 0.04 else "modifier" if mod >= 0.55 and mod >= head else "uncertain" if head < 0.42 else "predicate_head" if p["verbness"] > p["nounness"] else "nominal_head"
            s.append((m, True, fit, p["authority"], head, mod, op, doubt, role, tuple(p[a] for a in functional.AXES)))
        order = sorted(s, key=lambda x: -x[4])
        heads = [x[0] for x in order if x[4] >= max(0.45, order[0][4] - 0.08)][:2]
        ops = [x[0] for x in s if x[6] >= 0.55 and x[0] not in heads]
        mods = [x[0] for x in s if x[5] >= 0.5 and x[0] not in heads and x[0] not in ops]
        weights = [(0.35 + 0.45 * x[4] + 0.2 * x[3]) * {"operator": 0.65, "modifier": 0.65, "unknown": 0.3}.get(x[8], 1.0) for x in s]
        noun, modifier, verb = (sum(a * x[9][k] for a, x in zip(weights, s)) / sum(weights) for k in range(3))
        mean = lambda k: sum(x[k] for x in s) / len(s)  # noqa: B023, E731
        local, penalty = sum(x[4] for x in order[:2]) / len(order[:2]), unit(mean(7) + 0.15 * sum(not x[1] for x in s) / len(s))
        top = sorted((noun, modifier, verb), reverse=True)
        gap = top[0] - top[1]
        sure = unit(0.35 * local + 0.25 * mean(3) + 0.25 * mean(2) + 0.15 * unit(gap + 0.25) - 0.3 * penalty)
        both, lead, told = 0.3 * sure + 0.15 * bool(mods) + 0.1 * bool(ops), order[0][8] == "operator", []
        if heads:
            told.append(("predicate_head_with_modification", 0.45 * verb + both) if verb >= noun else ("nominal_head_with_modification", 0.45 * noun + both))
        if ops or lead:
            told.append(("relational_operator", 0.3 * modifier + 0.25 * sure + (0.25 if lead or not heads else 0.05)))
        if mods:
            told.append(("modifier_operator", 0.55 * modifier + 0.25 * sure + 0.1))
        if gap < 0.16 or not told:
            told.append(("mixed_or_uncertain", 0.65 - gap + 0.2 * (1 - sure)))
        label, score = max(told, key=lambda x: unit(x[1]))
        r = got[w]
        seen.add(label)
        assert (r["inferred"], r["heads"], r["operators"], r["modifiers"]) == (label, heads, ops, mods)
        assert r["uncertain"] == sorted({x[0] for x in s if not x[1] or x[7] >= 0.55 or x[2] <= 0.25})
        raw = max(-1.0, min(1.0, 1.1 * (local - 0.5) + 0.6 * (mean(2) - 0.5) + 0.6 * (sure - 0.5) - 0.35 * penalty))
        assert (r["score"], r["confidence"], r["raw"]) == pytest.approx((unit(score), sure, raw), abs=1e-4)
    assert len(seen) >= 3


def test_commands(spark, tmp_path):
    from stratalex.__main__ import main

    spark.createDataFrame([("colour",)], "needle string").write.parquet(str(tmp_path / "n"))
    spark.createDataFrame([("color",), ("dog",)], "word string").write.parquet(str(tmp_path / "w"))
    main(["fuzzy", str(tmp_path / "n"), str(tmp_path / "w"), str(tmp_path / "f")])
    assert [r["word"] for r in spark.read.parquet(str(tmp_path / "f")).collect()] == ["color"]
    (tmp_path / "d.json").write_text(json.dumps([{"word": "Na-z", "definition": "x", "canon_word": False}, {"word": "Ol", "alternates": [{"value": "onaz"}], "canon_word": True}, {"word": "Ti"}]))
    for given, expect in ((["--alternates", "1"], ["Na-z", "Ol"]), ([], ["Na-z"]), (["--canon-only", "1", "--alternates", "1"], ["Ol"])):
        out = str(tmp_path / f"g{len(given)}")
        main(["find-ngram", str(tmp_path / "d.json"), out, "--ngram", "N az!", *given, "--format", "json"])
        assert sorted(r["word"] for r in spark.read.json(out).collect()) == expect


def test_queries_without_sql(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").collect()
    parts = read("part")
    words = {}
    for r in parts:
        k = r["p_partkey"]
        words.setdefault(f"{r['p_brand']} {r['p_size']}", []).append({"k": k, "score": (k % 23) / 40, "parts": k % 5 + 1, "singles": k % 3})
    expect = {(w, r["k"], n, r["moved"]) for w, own in words.items() for n, r in enumerate(readings.fewer_parts(sorted(own, key=lambda r: (-r["score"], r["k"]))), 1)}
    assert rows(registry.queries()["w10_fewer_parts"](spark, DATA)) == expect
    turns = {}
    for r in read("conversations"):
        turns.setdefault(r["conv_id"], set()).add(r["turn"])
    found = {}
    for c, rank, score, choices in rows(registry.queries()["n38_phrase_beam"](spark, DATA)):
        found.setdefault(c, []).append((rank, score, choices))
    assert set(found) == set(turns) and all(len(p[2]) == len(turns[c]) and set(p[2]) <= {0, 1, 2} for c, ps in found.items() for p in ps)
    assert all([p[0] for p in sorted(ps)] == [1, 2, 3] and sorted((p[1] for p in ps), reverse=True) == [p[1] for p in sorted(ps)] for ps in found.values())
    got = registry.queries()["n37_word_functions"](spark, DATA).collect()
    assert sorted(r["p_partkey"] for r in got) == sorted(r["p_partkey"] for r in parts) and len({r["inferred"] for r in got}) >= 3
