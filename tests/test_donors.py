import random

from stratalex.operators.donors import BRANCHES, DEPTH, resolve

TRUST = {"dictionary": 0, "sqlite": 1}


def brute(host, target, roots):
    out = []

    def cuts(token, donor):
        at = [i for i in range(len(token) - len(donor) + 1) if token.startswith(donor, i)]
        for nth, i in enumerate(at):
            yield nth, 0, "single_occurrence", token[:i] + token[i + len(donor):]
        if len(at) > 1:
            gone = {i + k for i in at for k in range(len(donor))}
            yield 0, 1, "remove_all_occurrences", "".join(c for i, c in enumerate(token) if i not in gone)

    def walk(token, depth):
        if token == target and token:
            return
        ended = "empty_token" if not token else "empty_target" if not target else "max_depth_reached" if depth > DEPTH else None
        found = {}
        if not ended:
            for donor, source in roots.items():
                if donor != token and donor in token:
                    for nth, late, variant, rest in cuts(token, donor):
                        if rest and target in rest:
                            found.setdefault((donor, variant, rest), ((rest != target, TRUST.get(source, 2), -len(donor), donor, len(rest), nth, late), source))
            rows = sorted((v[0], k, v[1]) for k, v in found.items())
            if any(len(k[0]) > 1 for _, k, _ in rows):
                rows = [r for r in rows if len(r[1][0]) > 1]
            ended = None if rows else "no_viable_donor"
        if ended:
            out.append((host, target, depth, token, None, None, None, None, ended))
            return
        for _, (donor, variant, rest), source in rows[:BRANCHES]:
            out.append((host, target, depth, token, donor, source if depth else "host_subtraction", rest, variant, "resolved" if rest == target else "residual_extracted"))
            walk(rest, depth + 1)

    walk(host, 0)
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda a, b: "".join(rng.choice("abn") for _ in range(rng.randint(a, b)))
    roots = {word(1, 3): rng.choice(["dictionary", "sqlite", "other"]) for _ in range(9)}
    hosts = sorted({(h, h[-2:]) for h in (word(3, 9) for _ in range(12))})
    want = [r for h, t in hosts for r in brute(h, t, roots)]
    got = resolve(spark.createDataFrame(hosts * 2, "host string, target string"), spark.createDataFrame(list(roots.items()), "donor string, source string"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and len(want) > 50


def test_ends(spark):
    roots = spark.createDataFrame([("ab", "dictionary"), (None, "sqlite")], "donor string, source string")
    hosts = spark.createDataFrame([("ABX", "x"), (None, "x"), ("abx", None), ("x", "x"), ("qqx", "x")], "host string, target string")
    got = {(r["host"], r["target"], r["reason"]) for r in resolve(hosts, roots).collect()}
    assert got == {("abx", "x", "resolved"), ("", "x", "empty_token"), ("abx", "", "empty_target"), ("qqx", "x", "no_viable_donor")}
    assert resolve(hosts.limit(0), roots).count() == 0
