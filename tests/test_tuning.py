"""Auto-tuned clustering against plain versions."""

import itertools

import numpy as np
import pytest

from stratalex.operators import tuning as T


def _clouds(seed, n=8, k=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=4) * 3 + rng.normal(size=(n, 4)) * 0.2 for _ in range(k)])


def test_complete_linkage():
    x = np.random.default_rng(1).normal(size=(12, 3))
    d = T.distances(x)
    for t in (0.2, 0.6, 1.1):
        groups = [{k} for k in range(len(x))]
        while len(groups) > 1:
            h, a, b = min((max(d[i, j] for i in g for j in h), k, m) for (k, g), (m, h) in itertools.combinations(enumerate(groups), 2))
            if h >= t:
                break
            groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] | groups[b]]
        got = T.cut(T.complete_linkage(d), len(x), t)
        assert {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got.tolist())} == {frozenset(g) for g in groups}


def test_measures():
    x = _clouds(2)
    labels, d = np.repeat([0, 1, 2], 8), T.distances(x)
    points = []
    for i in range(len(x)):
        means = {k: np.mean([d[i, j] for j in range(len(x)) if labels[j] == k and j != i]) for k in range(3)}
        a, b = means[labels[i]], min(v for k, v in means.items() if k != labels[i])
        points.append((b - a) / max(a, b))
    assert T.silhouette(d, labels) == pytest.approx(np.mean(points))
    c = [x[labels == k].mean(axis=0) for k in range(3)]
    s = [np.mean([np.linalg.norm(p - c[k]) for p in x[labels == k]]) for k in range(3)]
    assert T.davies_bouldin(x, labels) == pytest.approx(np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)]))
    between = sum(8 * np.sum((c[k] - x.mean(axis=0)) ** 2) for k in range(3)) / 2
    within = sum(np.sum((p - c[labels[i]]) ** 2) for i, p in enumerate(x)) / (len(x) - 3)
    assert T.calinski_harabasz(x, labels) == pytest.approx(between / within)


def test_the_best_is_taken(spark):
    x = _clouds(3)
    d = T.distances(x)
    scores = []
    for m, p, clusters in T.configurations(x, d):
        clusters = [c for c in clusters if len(c) >= 2]
        if clusters and (s := T.objective(x, d, clusters)) is not None:
            scores.append((s, m, p))
    rows = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", 1, [1.0, 0.0]), ("c", 1, [0.0, 0.0]), ("c", 2, [1.0, 0.0])], "k string, i long, v array<double>")
    got = T.tuned_clusters(rows, "k", "i", "v").collect()
    best = [r for r in got if r["key"] == "a"]
    assert best[0]["score"] == pytest.approx(min(s for s, _, _ in scores))
    assert {frozenset(r["members"]) for r in best} == {frozenset(range(k, k + 8)) for k in (0, 8, 16)}
    assert sorted((r["key"], r["method"], r["members"]) for r in got if r["key"] != "a") == [("b", "none", [1]), ("c", "none", [1, 2])]
