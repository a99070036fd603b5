"""Readings: transitions between functional labels, the beam over a phrase, the tie-break in favour of fewer parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phrases import RELATIONS

#: What a label holds, the first that fits wins, and the family it stands for.
FAMILIES = (("relational", "relational"), ("modifier", "modifier"), ("operator", "relational"), ("predicate", "predicate"), ("verb", "predicate"), ("nominal", "noun"), ("noun", "noun"), ("mixed", "mixed"), ("uncertain", "mixed"))
#: Worth of a transition between families; with any mixed one, and any other.
TRANSITIONS = {
    ("modifier", "noun"): 1.10, ("relational", "predicate"): 1.25, ("predicate", "noun"): 0.85, ("predicate", "mixed"): 0.85,
    ("noun", "relational"): 0.70, ("relational", "noun"): 0.75, ("noun", "predicate"): 0.55, ("noun", "noun"): 0.20,
}
WITH_MIXED, WEAK, LEAST, MOST = 0.05, -0.65, -0.8, 1.4
#: The margin of a near tie, and by how much a reading of many single letters has to win.
TIE_MARGIN, CLEAR_WIN = 0.10, 0.18


def family(label: Column) -> Column:
    low, out = F.lower(label), F.lit("unknown")
    for part, name in reversed(FAMILIES):
        out = F.when(low.contains(part), name).otherwise(out)
    return out


def transition(left: Column, right: Column, left_confidence: Column, right_confidence: Column) -> Column:
    """Worth of two neighbouring families; 0 if one is unknown or there is no confidence in them."""
    sure = F.least(F.lit(1.0), (left_confidence + right_confidence) / 2)
    base = F.when((left == "mixed") | (right == "mixed"), WITH_MIXED).otherwise(WEAK)
    for (a, b), worth in TRANSITIONS.items():
        base = F.when((left == a) & (right == b), worth).otherwise(base)
    known = (sure > 0) & (left != "unknown") & (right != "unknown")
    scaled = F.least(F.lit(MOST), F.greatest(F.lit(LEAST), base * (0.35 + 0.65 * sure)))
    return F.when(known, F.round(scaled, 4)).otherwise(0.0)


def _transition(a: dict, b: dict) -> float:
    sure = min(1.0, (a["confidence"] + b["confidence"]) / 2)
    pair = (a["family"], b["family"])
    if sure <= 0 or "unknown" in pair:
        return 0.0
    base = TRANSITIONS.get(pair, WITH_MIXED if "mixed" in pair else WEAK)
    return round(min(MOST, max(LEAST, base * (0.35 + 0.65 * sure))), 4)


def _relation(a: dict, b: dict) -> float:
    have = (a["profile"], b["profile"], a["role"], b["role"])
    return next(score for *allowed, _, _, score in RELATIONS if all(x is None or h in x for x, h in zip(allowed, have)))


def link(a: dict, b: dict) -> float:
    """What it adds to a parse that ``b`` follows ``a``."""
    return _relation(a, b) + _transition(a, b)


def own_worth() -> Column:
    """What a candidate adds to a parse by itself; takes score, confidence, coherence, parts, definition, provisional, rescued."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    singles = F.coalesce(F.size(F.filter("parts", lambda p: F.char_length(p) == 1)), F.lit(0))
    return number("score") + 5 * number("confidence") + 2 * number("coherence") - 0.45 * F.greatest(F.lit(0), singles - 2) - 2.0 * open_reading().cast("int") - 0.35 * F.coalesce("rescued", F.lit(False)).cast("int")


def open_reading() -> Column:
    return F.coalesce(F.col("provisional"), F.lit(False)) & (F.coalesce("definition", F.lit("")) == "")


def parses(tokens: list[list[dict]], top: int) -> list[tuple[float, list[int]]]:
    """The best parses of a phrase, a candidate's number for each token; ties keep the order in which they arose."""
    beams: list[tuple[float, list[int]]] = [(0.0, [])]
    for at, choices in enumerate(tokens):
        grown = [(score + c["worth"] + (link(tokens[at - 1][path[-1]], c) if path else 0.0), [*path, k]) for score, path in beams for k, c in enumerate(choices)]
        beams = sorted(grown, key=lambda x: -x[0])[: max(6, 4 * top)]
    left = [(score - 1.5 * sum(tokens[at][k]["open"] for at, k in enumerate(path)), path) for score, path in beams[: max(1, top)]]
    return sorted(left, key=lambda x: -x[0])


def phrase_beam(candidates: DataFrame, phrase: str, top: int = 3) -> DataFrame:
    """phrase, rank, score, choices (the ``choice`` of each token): the best parses of each phrase.

    ``candidates`` has a row for each reading of a token: phrase, at, choice, label, role, profile and what ``own_worth``
    takes. Nulls count as nothing; tokens without candidates aren't there. A phrase is one row in Arrow.
    """
    c = F.struct("at", "choice", own_worth().alias("worth"), open_reading().alias("open"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce(family(F.col("label")), F.lit("unknown")).alias("family"), "role", "profile")
    rows = candidates.where("at is not null").select(phrase, c.alias("c")).groupBy(phrase).agg(F.array_sort(F.collect_list("c")).alias("cs"))

    @F.pandas_udf("array<struct<rank:long,score:double,choices:array<long>>>")
    def best(phrases: pd.Series) -> pd.Series:
        out = []
        for cs in phrases:
            tokens: dict = {}
            for x in cs:
                tokens.setdefault(x["at"], []).append(x)
            own = list(tokens.values())
            out.append([{"rank": n, "score": s, "choices": [own[at][k]["choice"] for at, k in enumerate(path)]} for n, (s, path) in enumerate(parses(own, top), 1)])
        return pd.Series(out)

    return rows.select(phrase, F.explode(best("cs")).alias("p")).select(phrase, "p.*")


def fewer_parts(rows: list[dict], margin: float = TIE_MARGIN, clear: float = CLEAR_WIN) -> list[dict]:
    """Readings, best first, after near ties went to the one of fewer parts; ``moved`` marks those that rose."""
    rows, again = [{**r, "moved": False} for r in rows], True
    while again:
        again = False
        for i in range(1, len(rows)):
            upper, lower = rows[i - 1], rows[i]
            ahead = upper["score"] - lower["score"]
            earned = upper["singles"] >= 2 and 2 * upper["singles"] >= max(1, upper["parts"]) and ahead >= clear
            if upper["parts"] > lower["parts"] and ahead <= margin and not earned:
                rows[i - 1], rows[i] = {**lower, "moved": True}, upper
                again = True
    return rows


def tie_break(readings: DataFrame, word: str, reading: str) -> DataFrame:
    """word, reading, rank, moved. Takes score, parts, singles (null: 0); ties of the score stand by reading."""
    schema = readings.select(word, reading).schema
    zero = readings.select(word, reading, *[F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c) for c, t in (("score", "double"), ("parts", "long"), ("singles", "long"))])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        own = fewer_parts(group.sort_values(["score", reading], ascending=[False, True]).to_dict("records"))
        return pd.DataFrame([(r[word], r[reading], k, r["moved"]) for k, r in enumerate(own, 1)], columns=[word, reading, "rank", "moved"])

    return zero.groupBy(word).applyInPandas(one, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, rank long, moved boolean")
