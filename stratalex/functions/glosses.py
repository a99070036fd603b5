"""Expressions over glosses: placeholders, metalanguage, number claims, headwords, parts of speech, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a gloss as a description of language rather than a meaning.
META = (
    "base", "copula", "copular", "deictic", "demonstrative", "derivational", "existential base", "grammatical", "infix", "invariant", "lemma", "morpheme", "marker", "operator", "prefix", "predicate",
    "predicate-integrator", "suffix", "relativizer", "particle", "pronoun", "pronominal", "root", "semantic", "semantic core", "specifier", "relational operator", "reference", "subordinate clause",
)
#: Forms of the copula, prepositions, coordinators, personal pronouns, words that make a gloss a phrase.
COPULAS = ("is", "are", "was", "were", "be", "am", "being", "been")
PREPOSITIONS = ("in", "on", "of", "to", "from", "with", "by", "for", "at", "into", "upon", "under", "over")
COORDINATORS = ("and", "or", "but", "nor")
PRONOUNS = ("he", "she", "it", "they", "we", "i", "thou", "ye")
PHRASE_WORDS = ("which", "that", "those", "these", "they", "amongst")
#: Words that don't head a gloss.
NOT_HEADS = ("a", "an", "the", "of", "in", "on", "to", "and", "or", "for", "with", "by", "my", "thy", "his", "her", "its", "our", "your", "their")


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_placeholder(text: Column) -> Column:
    """Whether a gloss stands in for one: a list of residuals, or a bracketed tag in capitals."""
    return F.coalesce(F.lower(_squeezed(text)).startswith("top residuals:") | F.trim(text).rlike(r"^\[[A-Z][A-Z' ?-]*\]$"), F.lit(False))


def is_meta(text: Column) -> Column:
    """Whether a gloss speaks about language; one that quotes a meaning doesn't count."""
    low = F.lower(_squeezed(text))
    marked = low.rlike(rf"(?:^|[^a-z0-9_])(?:{'|'.join(sorted(META, key=len, reverse=True))})(?:[^a-z0-9_]|$)")
    quoted = low.rlike("[\"'`].{1,48}?[\"'`]")
    other = F.trim(text).rlike(r"^[A-Z][A-Z0-9'-]* +(?:denotes|encodes|signifies)(?:[^a-zA-Z0-9_]|$)") | low.startswith("a root ") | low.startswith("the root ") | low.startswith("root denoting ")
    return F.coalesce((low != "") & F.when(marked, ~quoted).otherwise(other), F.lit(False))


def digit_count(text: Column) -> Column:
    """How many digits the number has that a gloss names; null without one."""
    digits = F.regexp_extract(_squeezed(text), r"(?i)(?:^|[^a-zA-Z0-9_])(?:digits?|numbers?|numerals?) *['\"]?([0-9]+)", 1)
    return F.when(digits != "", F.char_length(digits))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def headword(text: Column, ignore: tuple = NOT_HEADS) -> Column:
    """The first token that may head a gloss, after a leading "to"; null if there is none."""
    found = tokens(text)
    rest = F.when((F.get(found, F.lit(0)) == "to") & (F.size(found) > 1), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(1)))).otherwise(found)
    return F.get(F.filter(rest, lambda x: ~x.isin(*ignore)), F.lit(0))


def singular(word: Column) -> Column:
    """A plain singular: -ies to -y, -sses kept to -ss, a last -s dropped unless -ss or -us stand there."""
    return (
        F.when((F.char_length(word) > 4) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.char_length(word) - 3), F.lit("y")))
        .when(word.endswith("sses"), F.substring(word, F.lit(1), F.char_length(word) - 2))
        .when((F.char_length(word) > 3) & word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us"), F.substring(word, F.lit(1), F.char_length(word) - 1))
        .otherwise(word)
    )


def is_compound(text: Column) -> Column:
    found = tokens(text)
    return (F.size(found) > 0) & (text.contains(",") | text.contains(" / ") | text.contains(";") | F.arrays_overlap(found, F.array(*map(F.lit, PHRASE_WORDS))) | (F.size(found) > 2))


def parts_of_speech(text: Column) -> Column:
    """Array of tags by the rules of a ladder; NOUN where none holds, PHRASE first where a gloss is a compound."""
    low, found = F.lower(F.trim(F.coalesce(text, F.lit("")))), tokens(text)
    first = F.get(found, F.lit(0))
    copula = low.startswith("to be") | low.isin(*COPULAS)
    one = F.size(found) == 1
    tags = F.filter(
        F.array(
            F.when(copula, "AUX"), F.when(low.rlike("^to +[a-z]") & ~copula, "VERB"), F.when(first.isin(*PREPOSITIONS) & (F.size(found) <= 3), "ADP"),
            F.when(one & first.isin(*COORDINATORS), "CCONJ"), F.when(one & first.isin(*PRONOUNS), "PRON"),
        ), lambda x: x.isNotNull(),
    )
    tags = F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("NOUN")))
    return F.when(low == "", F.array(F.lit("NOUN"))).when(is_compound(F.coalesce(text, F.lit(""))), F.concat(F.array(F.lit("PHRASE")), tags)).otherwise(tags)


def enhanced_definition(senses: Column, contexts: Column) -> Column:
    """Senses joined, and usages in backticks, in lower case."""
    base = F.array_join(F.transform(senses, lambda x: F.trim(F.coalesce(x, F.lit("")))), " ")
    uses = F.transform(F.filter(contexts, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.concat(F.lit("`"), F.trim(x), F.lit("`")))
    return F.concat(F.lower(base), F.lit("."), F.when(F.size(uses) > 0, F.concat(F.lit(" usage: "), F.lower(F.array_join(uses, ", ")))).otherwise(F.lit("")))
