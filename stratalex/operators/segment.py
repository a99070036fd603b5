"""Segmentation: bounded searches over one word at a time, run by word in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_ngrams

#: Fixed values of the segment score.
LENGTH_BONUS, START_BONUS, END_BONUS, ATTESTED, PER_SEGMENT = 0.75, 0.6, 0.6, 10.0, 0.35
SINGLETONS = {"l": 0.25, "i": 0.75}


def segment_score(gram: str, start: int, end: int, size: int, tf: int, df: int, total: int, attested: bool, defs: int = 0) -> float:
    n = len(gram)
    score = math.log1p(tf) * math.log(total / (df + 1)) + LENGTH_BONUS * max(0, n - 1)
    score += START_BONUS * (start == 0) + END_BONUS * (end == size) + ATTESTED * attested - PER_SEGMENT
    score -= 0.0 if n > 1 else SINGLETONS.get(gram.lower(), 8.0)
    score -= 0.5 * math.log1p(tf) + 0.5 * math.log1p(defs)
    return score - (min(6.0, 0.3 * (defs - 15)) if n == 1 and defs > 15 else 0.0)


def beam(word: str, index: dict[str, tuple[int, int, bool]], total: int, least: int = 1, most: int = 7, width: int = 15) -> list[tuple[float, tuple[str, ...]]]:
    """Full covers of ``word`` by index entries, best first; ties keep the order in which they arose."""
    paths: list[tuple[float, int, tuple[str, ...]]] = [(0.0, 0, ())]
    done: list[tuple[float, tuple[str, ...]]] = []
    while paths:
        grown = []
        for score, at, parts in paths:
            for n in range(least, most + 1):
                gram = word[at : at + n]
                if len(gram) == n and gram in index:
                    tf, df, attested = index[gram]
                    grown.append((score + segment_score(gram, at, at + n, len(word), tf, df, total, attested), at + n, (*parts, gram)))
        done += [(s, p) for s, at, p in grown if at == len(word)]
        paths = sorted((g for g in grown if g[1] < len(word)), key=lambda g: -g[0])[:width]
    return sorted(done, key=lambda x: -x[0])


def covers(word: str, pieces: set[str], most: int = 100) -> list[tuple[str, ...]]:
    """Every full cover of ``word`` by ``pieces``, fewest pieces first, by dynamic programming over ends."""
    at: dict[int, list[tuple[str, ...]]] = {0: [()]}
    for end in range(1, len(word) + 1):
        at[end] = sorted((p + (word[s:end],) for s in range(end) if word[s:end] in pieces for p in at[s]), key=lambda p: (len(p), p))[: 5 * most]
    return at[len(word)][:most] if word else []


def breakable(word: str, pieces: set[str]) -> bool:
    ok = [True] + [False] * len(word)
    for end in range(1, len(word) + 1):
        ok[end] = any(ok[s] and word[s:end] in pieces for s in range(end))
    return ok[-1]


def isolatable(word: str, root: str, pieces: set[str]) -> bool:
    """Whether an occurrence of ``root`` leaves a prefix and a suffix that ``pieces`` cover."""
    return any(word[s : s + len(root)] == root and breakable(word[:s], pieces) and breakable(word[s + len(root) :], pieces) for s in range(len(word) - len(root) + 1))


def splits(word: str, least: int = 2) -> list[tuple[str, ...]]:
    """All ways to cut ``word`` into pieces of ``least`` characters or more."""
    if not word:
        return [()]
    return [(word[:k], *rest) for k in range(least, len(word) + 1) for rest in splits(word[k:], least)]


def attested_covers(words: DataFrame, pieces: DataFrame, least: int = 1, most: int = 100) -> DataFrame:
    """word, rank, pieces: the full covers of each of ``words`` (word) by ``pieces`` (piece), the fewest pieces first, ``most`` at most (the feature's limit).

    Only pieces that stand in a word are gathered with it, in one row, so a row is bounded by its word's length.
    """
    return _with_pieces(words, pieces, least).mapInPandas(lambda frames: (_cover_rows(f, most) for f in frames), "word string, rank int, pieces array<string>")


def coverable(words: DataFrame, pieces: DataFrame, least: int = 1) -> DataFrame:
    """word, covered: whether ``pieces`` cover all of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"word": f["word"], "covered": [breakable(w, set(p)) for w, p in zip(f["word"], f["pieces"])]})

    return _with_pieces(words, pieces, least).mapInPandas(run, "word string, covered boolean")


def isolatable_roots(hosts: DataFrame, pieces: DataFrame, least: int = 1) -> DataFrame:
    """host, root, isolatable: whether an occurrence of ``root`` leaves a prefix and a suffix that ``pieces`` cover; hosts: host, root."""
    own = _with_pieces(hosts.select(F.col("host").alias("word")).distinct(), pieces, least)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"host": f["host"], "root": f["root"], "isolatable": [isolatable(h, r, set(p)) for h, r, p in zip(f["host"], f["root"], f["pieces"])]})

    return hosts.join(own, hosts["host"] == own["word"]).select("host", "root", "pieces").mapInPandas(run, "host string, root string, isolatable boolean")


def all_splits(words: DataFrame, least: int = 2, longest: int = 20) -> DataFrame:
    """word, pieces: every way to cut a word into pieces of ``least`` characters or more. Their number doubles with each few letters, so a longer word than ``longest`` is refused."""
    if words.where(F.char_length("word") > longest).limit(1).count():
        raise ValueError(f"a word has more than {longest} characters")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(w, list(p)) for w in f["word"] for p in splits(w, least) if p]
            yield pd.DataFrame(rows, columns=["word", "pieces"])

    return words.select("word").mapInPandas(run, "word string, pieces array<string>")


def _with_pieces(words: DataFrame, pieces: DataFrame, least: int) -> DataFrame:
    """word, pieces: the pieces of ``least`` characters or more that stand in each word."""
    known = pieces.where(F.char_length("piece") >= least).select("piece").distinct()
    longest = known.agg(F.max(F.char_length("piece"))).first()[0] or least
    grams = words.select("word", F.explode(F.array_distinct(F.transform(char_ngrams(F.col("word"), least, longest), lambda x: x["gram"]))).alias("piece"))
    found = grams.join(known, "piece").groupBy("word").agg(F.collect_list("piece").alias("pieces"))
    return words.select("word").distinct().join(found, "word", "left").select("word", F.coalesce("pieces", F.array().cast("array<string>")).alias("pieces"))


def _cover_rows(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    rows = [(w, k, list(c)) for w, p in zip(frame["word"], frame["pieces"]) for k, c in enumerate(covers(w, set(p), most), 1)]
    return pd.DataFrame(rows, columns=["word", "rank", "pieces"])


def definition_beam(candidates: DataFrame, width: int = 6, target: float = 0.45, radius: float = 0.20) -> DataFrame:
    """word, choices (one candidate's number for each morph), score: the best definitions put together for each word.

    candidates: word, place (of the morph), choice, vector (unit length, null without a definition), quality, anchor (of the morph), contradiction (of
    the choice). A word's candidates are gathered in one row: as many as its morphs have definitions.
    """
    own = candidates.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", (-F.col("quality")).alias("order"), "choice", "vector", "quality", "anchor", "contradiction"))).alias("c"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            best = [_best_definitions(c, width, target, radius) for c in f["c"]]
            yield pd.DataFrame({"word": f["word"], "choices": [b[0] for b in best], "score": [round(b[1], 6) for b in best]})

    return own.mapInPandas(run, "word string, choices array<long>, score double")


def _best_definitions(rows, width: int, target: float, radius: float) -> tuple[list[int], float]:
    places = sorted({r["place"] for r in rows})
    beams: list[tuple[float, list]] = [(0.0, [])]
    for p in places:
        grown = [(_combined([*held, r], target, radius), [*held, r]) for _, held in beams for r in rows if r["place"] == p]
        beams = sorted(grown, key=lambda x: -x[0])[:width]
    score, held = beams[0]
    return [int(r["choice"]) for r in held], score


def _combined(held: list, target: float, radius: float) -> float:
    vectors = [r["vector"] for r in held if r["vector"] is not None]
    near = [max(0.0, min(1.0, 1 - abs(sum(x * y for x, y in zip(a, b)) - target) / radius)) for k, a in enumerate(vectors) for b in vectors[k + 1 :]]
    mean = lambda x: sum(x) / len(x) if x else 0.0
    return 0.45 * mean(near) + 0.30 * mean([r["anchor"] for r in held]) + 0.15 * mean([r["quality"] for r in held]) - 0.10 * mean([r["contradiction"] for r in held])


def segment(candidates: DataFrame, total: int | None = None, width: int = 15, best: int = 5) -> DataFrame:
    """word, rank, segments, score from candidate entries (word, gram, tf, df, attested), the best covers of each word.

    ``total`` are the words of the index, or a column of that name has them.

    Only the entries that occur in a word are gathered with it, so a group is bounded by its length.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        word = pdf["word"].iloc[0]
        known = {g: (int(t), int(d), bool(a)) for g, t, d, a in zip(pdf["gram"], pdf["tf"], pdf["df"], pdf["attested"])}
        found = beam(word, known, int(pdf["total"].iloc[0]), width=width)[:best]
        return pd.DataFrame({"word": [word] * len(found), "rank": range(1, len(found) + 1), "segments": [list(p) for _, p in found], "score": [round(s, 6) for s, _ in found]})

    if total is not None:
        candidates = candidates.withColumn("total", F.lit(total))
    return candidates.groupBy("word").applyInPandas(run, "word string, rank int, segments array<string>, score double")


def greedy_clusters(rows: Iterator[tuple[list[float], float]], least: float = 0.8) -> list[int]:
    """Cluster of each (unit vector, score), in order: joins the best running mean of cosine ``least`` or more."""
    means: list[tuple[list[float], int]] = []
    out = []
    for v, _ in rows:
        sims = [sum(a * b for a, b in zip(v, m)) / (math.sqrt(sum(b * b for b in m)) or 1.0) for m, _ in means]
        best = max(range(len(sims)), key=lambda k: sims[k], default=-1)
        if best >= 0 and sims[best] >= least:
            m, n = means[best]
            means[best] = ([(x * n + y) / (n + 1) for x, y in zip(m, v)], n + 1)
            out.append(best)
        else:
            means.append((list(v), 1))
            out.append(len(means) - 1)
    return out
