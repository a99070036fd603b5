"""String expressions over columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_form(form: str):
    """A function of a string column: its Unicode normal form. Spark has none of its own."""

    @F.pandas_udf("string")
    def normal(text: pd.Series) -> pd.Series:
        return text.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return normal


def words(text: Column) -> Column:
    """ASCII words in order."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))


def pairs_in_order(items: Column) -> Column:
    """Structs (l, r) of neighbouring items of an array."""
    return F.zip_with(F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("l"), b.alias("r")))


def letters_only(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}]", ""))


def alphabet_only(text: Column, alphabet: str = "A-IK-VX-Z") -> Column:
    """Upper-cased letters of a restricted alphabet."""
    return F.regexp_replace(F.upper(text), f"[^{alphabet}]", "")


def collapse_repeats(items: Column) -> Column:
    """An array without items that equal the one before them."""
    return F.filter(F.transform(items, lambda x, i: F.when((i == 0) | (x != F.get(items, i - 1)), x)), lambda x: x.isNotNull())


def occurrences(text: Column, part: Column) -> Column:
    """0-based starts of ``part`` in ``text``, overlapping ones included."""
    last = F.char_length(text) - F.char_length(part)
    starts = F.when((last >= 0) & (F.char_length(part) > 0), F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.substring(text, i + 1, F.char_length(part)) == part)


def char_ngrams(text: Column, least: int, most: int) -> Column:
    """Structs (start, gram) of all character n-grams of ``least`` to ``most`` characters."""
    size = F.char_length(text)
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, n).alias("gram")))).otherwise(F.array().cast("array<struct<start:int,gram:string>>"))
    return F.concat(*[of(F.lit(n)) for n in range(least, most + 1)])


def windows(items: Column, size: int, stride: int) -> Column:
    """Runs of ``size`` items at every ``stride``-th start; a short tail is dropped."""
    n = F.size(items)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(stride)), lambda i: F.slice(items, i + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def canonical_space(text: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[;:,]"), lambda x: F.trim(x)), lambda x: x.rlike("[A-Za-z]"))


def graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s).\p{M}*"), F.lit(0))


def terms(text: Column) -> Column:
    """Distinct semantic terms of a gloss, cut at commas, slashes, semicolons and the word or."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(text), r"[,/;]|\bor\b"), lambda x: F.trim(x)), lambda x: x != ""))


def replaced_variants(text: Column, rules: list[tuple[str, str]], most: int = 2) -> Column:
    """A spelling and what up to ``most`` replace-all rules make of it; the original first, the rest sorted."""
    found = F.array(text)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, lambda x: F.array(*[F.replace(x, F.lit(a), F.lit(b)) for a, b in rules])))))
    return F.concat(F.array(text), F.array_sort(F.filter(found, lambda x: x != text)))
