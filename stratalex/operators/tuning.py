"""Auto-tuned clustering of a word's definitions: many methods and thresholds, the best by one objective.

An n-gram has some dozens of definitions, a few hundred at most, so its vectors are gathered in one row and worked on by numpy. The grid and the weights are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLDS = [x / 100 for x in range(50, 81)]
NEIGHBOURS, FUZZY = range(3, 13), range(3, 20)


def distances(x: np.ndarray) -> np.ndarray:
    """Cosine distances; 1 to a vector without a direction, 0 to itself."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n > 0, n, 1)
    out = np.clip(1 - u @ u.T, 0, 2)
    np.fill_diagonal(out, 0)
    return out


def linked(near: np.ndarray) -> np.ndarray:
    """Component of each point of a boolean adjacency matrix, numbered in the order of their first points."""
    out = np.full(len(near), -1)
    for k in range(len(near)):
        if out[k] < 0:
            label = out.max() + 1
            todo = [k]
            out[k] = label
            while todo:
                new = np.flatnonzero(near[todo.pop()] & (out < 0))
                out[new] = label
                todo += new.tolist()
    return out


def complete_linkage(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (height, a, b) of clusters named by their least points, nearest first, by the greatest distance between members."""
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    out = []
    for _ in range(len(d) - 1):
        a, b = divmod(int(d.argmin()), len(d))
        a, b = min(a, b), max(a, b)
        out.append((float(d[a, b]), a, b))
        both = np.maximum(d[a], d[b])
        d[a, :], d[:, a] = both, both
        d[b, :], d[:, b], d[a, a] = np.inf, np.inf, np.inf
    return out


def cut(merges: list[tuple[float, int, int]], n: int, height: float) -> np.ndarray:
    """Labels after the merges below ``height``."""
    root = list(range(n))
    for h, a, b in merges:
        if h < height:
            root = [a if r == b else r for r in root]
    return np.unique(root, return_inverse=True)[1]


def fuzzy(x: np.ndarray, k: int, m: float = 2.0, rounds: int = 200) -> np.ndarray:
    """Label of the greatest membership by fuzzy c-means, from centers taken at even steps."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)] + 1e-9 * np.arange(k)[:, None]
    for _ in range(rounds):
        d = np.maximum(np.linalg.norm(x[:, None] - c[None], axis=2), 1e-12)
        u = 1 / (d ** (2 / (m - 1)) * (d ** (-2 / (m - 1))).sum(axis=1, keepdims=True))
        new = (u**m).T @ x / (u**m).sum(axis=0)[:, None]
        if np.abs(new - c).max() < 1e-6:
            break
        c = new
    return u.argmax(axis=1)


def _groups(labels: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(labels == k) for k in np.unique(labels)]


def configurations(x: np.ndarray, d: np.ndarray) -> Iterator[tuple[str, float, list[np.ndarray]]]:
    """(method, parameter, clusters): clusters may share points where the method lets them."""
    n, merges = len(x), complete_linkage(d)
    for t in THRESHOLDS:
        yield "agglomerative", t, _groups(cut(merges, n, t))
    for t in THRESHOLDS:
        near = d <= t
        alone = near.sum(axis=1) < 2  # points without a neighbour are one group
        yield "dbscan", t, _groups(np.where(alone, -1, linked(near)))
    for t in THRESHOLDS:
        near = (d < t) & (d > 0)
        yield "graph", t, _groups(linked(near))
        yield "ego", t, [np.concatenate([[k], np.flatnonzero(near[k])]) for k in range(n)]
    for k in NEIGHBOURS:
        if k < n:
            yield "knn", k, [np.lexsort((np.arange(n), d[i]))[: k + 1] for i in range(n)]
    for k in FUZZY:
        if k <= n:
            yield "fuzzy", k, _groups(fuzzy(x, k))


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean over the points; 0 for one alone in its cluster."""
    known = np.unique(labels)
    sums = np.stack([d[:, labels == k].sum(axis=1) for k in known], axis=1)
    sizes = np.array([(labels == k).sum() for k in known])
    own = np.searchsorted(known, labels)
    rows = np.arange(len(labels))
    inside = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[rows, own] = np.inf
    outside = means.min(axis=1)
    return float(np.where(sizes[own] > 1, (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-12), 0.0).mean())


def _centers(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known, own, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    return np.stack([x[labels == k].mean(axis=0) for k in known]), own, sizes


def davies_bouldin(x: np.ndarray, labels: np.ndarray) -> float:
    c, own, _ = _centers(x, labels)
    spread = np.array([np.linalg.norm(x[own == k] - c[k], axis=1).mean() for k in range(len(c))])
    apart = np.linalg.norm(c[:, None] - c[None], axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(apart > 0, (spread[:, None] + spread[None]) / apart, 0.0)
    np.fill_diagonal(ratio, 0)
    return float(ratio.max(axis=1).mean())


def calinski_harabasz(x: np.ndarray, labels: np.ndarray) -> float:
    c, own, sizes = _centers(x, labels)
    between = (sizes * ((c - x.mean(axis=0)) ** 2).sum(axis=1)).sum()
    within = ((x - c[own]) ** 2).sum()
    return float(between * (len(x) - len(c)) / (within * (len(c) - 1))) if within > 0 else 1.0


def size_penalty(sizes: list[int]) -> float:
    n, a, sd = len(sizes), float(np.mean(sizes)), float(np.std(sizes))
    count = (3 - n) / 3 if n < 3 else (n - 35) / 35 if n > 35 else 0.0
    mean = (6 - a) / 6 if a < 6 else (a - 18) / 18 if a > 18 else 0.0
    return count + 1.3 * mean + 0.4 * sd / a


def objective(x: np.ndarray, d: np.ndarray, clusters: list[np.ndarray]) -> float | None:
    """The less the better; null for fewer than two clusters of two points. Where clusters share a point, the last one has it."""
    labels = np.full(len(x), -1)
    for k, c in enumerate(clusters):
        labels[c] = k
    if len(set(labels.tolist()) - {-1}) < 2 or len(np.unique(labels)) > len(x) - 1:
        return None
    return -silhouette(d, labels) + davies_bouldin(x, labels) - 0.1 * np.log10(calinski_harabasz(x, labels) + 1) + size_penalty([len(c) for c in clusters])


def tuned(x: np.ndarray) -> tuple[str, float, float | None, list[list[int]]]:
    """method, parameter, objective and clusters of the best configuration, the first of equal ones; all in one cluster if none is fit."""
    best: tuple = ("none", 0.0, None, [list(range(len(x)))])
    if len(x) >= 2:
        d = distances(x)
        for method, parameter, clusters in configurations(x, d):
            clusters = [c for c in clusters if len(c) >= 2]
            score = objective(x, d, clusters) if clusters else None
            if score is not None and (best[2] is None or score < best[2]):
                best = (method, float(parameter), score, [c.tolist() for c in clusters])
    return best


def tuned_clusters(rows: DataFrame, key: str, item: str, vec: str) -> DataFrame:
    """key, method, parameter, score, cluster, members (items): the best clusters of each key's vectors, which are gathered in one row, in the order of their items."""
    own = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col(item).cast("long").alias("i"), F.col(vec).cast("array<double>").alias("v")))).alias("x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, x in zip(f["key"], f["x"]):
                method, parameter, score, clusters = tuned(np.array([list(r["v"]) for r in x], float))
                out += [(k, method, parameter, score, n, [int(x[i]["i"]) for i in c]) for n, c in enumerate(clusters)]
            yield pd.DataFrame(out, columns=["key", "method", "parameter", "score", "cluster", "members"])

    return own.mapInPandas(run, "key string, method string, parameter double, score double, cluster int, members array<long>")
