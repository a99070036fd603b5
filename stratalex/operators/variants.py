"""Spelling variants, as array expressions over a column; rules are small lists, fixed for a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import occurrences


def _once(text: Column, rules: list[tuple[str, str]]) -> Column:
    """All texts that one rule makes at one place; a rule doesn't expand what is expanded already."""

    def places(x: Column, source: str, target: str) -> Column:
        at = occurrences(x, F.lit(source))
        if target.startswith(source):
            at = F.filter(at, lambda i: F.substring(x, i + 1, F.lit(len(target))) != target)
        return F.transform(at, lambda i: F.concat(F.substring(x, F.lit(1), i), F.lit(target), F.substring(x, i + 1 + len(source), F.char_length(x))))

    return F.concat(*[places(text, s, t) for s, t in rules])


def lookup_variants(surface: Column, rules: list[tuple[str, str]], operations: int = 2, most: int = 128) -> Column:
    """A surface in capitals and what up to ``operations`` rules, each at one place, make of it; itself first, the rest in order.

    Beyond ``most`` variants, those of fewer operations and then the first in order are kept: a bound of the feature, as words are short.
    """
    rules = [(s.upper(), t.upper()) for s, t in dict.fromkeys(rules) if s and t and s.upper() != t.upper()]
    own = F.upper(F.trim(F.coalesce(surface, F.lit(""))))
    if not rules:
        return F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>"))
    found, last = F.array(own), F.array(own)
    for _ in range(max(1, operations)):
        last = F.array_sort(F.array_distinct(F.flatten(F.transform(last, lambda x: _once(x, rules)))))
        found = F.slice(F.array_distinct(F.concat(found, last)), 1, most)
    return F.when(own != "", F.concat(F.array(own), F.array_sort(F.filter(found, lambda x: x != own)))).otherwise(F.array().cast("array<string>"))


def _alternates(rules: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def usable(rules: dict[str, list[dict]]) -> dict[str, list[str]]:
    """The alternates of each letter that are spoken outwards, neither letter names nor of low confidence."""
    out = {k: [a["value"] for a in v if a.get("direction") in ("to", "both") and a.get("type", "unknown") != "letter_name" and a.get("confidence", "low") != "low"] for k, v in rules.items()}
    return {k: v for k, v in out.items() if v}


def substitution_variants(word: Column, rules: dict[str, list[str]], most: int = 3) -> Column:
    """Sorted distinct spellings with up to ``most`` letters replaced by one of their alternates."""
    known, low = _alternates(rules), F.lower(word)
    start = F.array(F.struct(F.lit("").alias("t"), F.lit(0).alias("n")))

    def step(found: Column, ch: Column) -> Column:
        more = lambda x: F.transform(F.when(x["n"] < most, F.coalesce(F.element_at(known, ch), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), lambda s: F.struct(F.concat(x["t"], s).alias("t"), (x["n"] + 1).alias("n")))
        return F.flatten(F.transform(found, lambda x: F.concat(F.array(F.struct(F.concat(x["t"], ch).alias("t"), x["n"].alias("n"))), more(x))))

    return F.array_sort(F.array_distinct(F.transform(F.aggregate(F.split(low, ""), start, step), lambda x: x["t"])))


def two_place_variants(word: Column, rules: dict[str, list[str]]) -> Column:
    """Sorted distinct spellings with the letters at two places replaced, each by one of its alternates or, without any, by itself; and the word."""
    known, low = _alternates(rules), F.lower(word)
    n = F.char_length(low)
    of = lambda i: F.coalesce(F.element_at(known, F.substring(low, i + 1, F.lit(1))), F.array(F.substring(low, i + 1, F.lit(1))))
    between = lambda i, j: F.substring(low, i + 2, j - i - 1)
    made = lambda i, j: F.flatten(F.transform(of(i), lambda x: F.transform(of(j), lambda y: F.concat(F.substring(low, F.lit(1), i), x, between(i, j), y, F.substring(low, j + 2, n)))))
    places = F.sequence(F.lit(0), n - 2)
    every = F.flatten(F.transform(places, lambda i: F.flatten(F.transform(F.sequence(i + 1, n - 1), lambda j: made(i, j)))))
    return F.when(n >= 2, F.array_sort(F.array_distinct(F.concat(F.array(low), every)))).otherwise(F.array(low))


def compressed(word: Column, rules: list[dict]) -> Column:
    """A word after the sequence rules that are read inwards, one after another."""
    for r in rules:
        if r["direction"] in ("from", "both"):
            word = F.replace(word, F.lit(r["from"]), F.lit(r["to"]))
    return word
