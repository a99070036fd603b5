"""Scans of corpora, metrics, rules and profiles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alphabet_only
from .files import dictionary, json_lines

#: Fixed format: a line of a metrics file; each figure has two names.
METRICS = "coverage_ratio double, coverage_ratio_mean double, residual_ratio double, residual_ratio_mean double, confidence double, avg_confidence double, recon_error double, token string, normalized string"


def paragraph_tokens(text: Column) -> Column:
    """The paragraphs of a text, cut at blank lines, as arrays of tokens in a restricted alphabet.

    Stops, pauses, quotes, parentheses and dashes part tokens and are dropped.
    """
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p) != "")
    return F.transform(paragraphs, lambda p: F.filter(F.transform(F.regexp_extract_all(p, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: alphabet_only(w)), lambda t: t != ""))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """paragraph, at, token of text files."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.posexplode(paragraph_tokens(F.col("value"))).alias("paragraph", "t")).select("paragraph", F.posexplode("t").alias("at", "token"))


def rules(spark: SparkSession, path: str) -> list[dict]:
    """Substitution or compression rules: a JSON list of objects, or an object with the list under ``rules``; none for anything else. A small file."""
    rows = spark.read.text(path, wholetext=True).collect()
    try:
        data = json.loads(rows[0][0]) if rows else []
    except json.JSONDecodeError:
        return []
    data = data.get("rules") if isinstance(data, dict) else data
    return [r for r in data if isinstance(r, dict)] if isinstance(data, list) else []


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A catalogue table, or an empty one of that schema if it isn't there."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def _number(*names: str) -> Column:
    return F.coalesce(*[F.nullif(n, F.lit(0.0)) for n in names], *[F.col(n) for n in names[-1:]])


def metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Means (one row) of a metrics file, and token, error of each token, that of its last line."""
    rows = json_lines(spark, path, METRICS).withColumn("at", F.monotonically_increasing_id())
    means = rows.agg(F.avg(_number("coverage_ratio", "coverage_ratio_mean")).alias("coverage_ratio_mean"), F.avg(_number("residual_ratio", "residual_ratio_mean")).alias("residual_ratio_mean"), F.avg(_number("confidence", "avg_confidence")).alias("avg_confidence"))
    token = F.coalesce(F.nullif("token", F.lit("")), F.col("normalized"))
    errors = rows.select(token.alias("token"), _number("recon_error", "residual_ratio").alias("error"), "at").where("token is not null and error is not null")
    return means, errors.groupBy("token").agg(F.max_by("error", "at").alias("error"))


def trusted_seeds(manual: DataFrame, entries: DataFrame, ngrams: DataFrame | None = None, most: int = 7) -> DataFrame:
    """token: seeds listed by hand, and a dictionary's headwords and alternates, in capitals, of ``most`` letters at most.

    With an n-gram index, dictionary tokens that it lacks are left out. manual: token; entries: canonical, normalized, alternates (struct of value).
    """
    forms = F.concat(F.array(F.coalesce(F.nullif(F.trim("normalized"), F.lit("")), F.trim("canonical"))), F.coalesce(F.transform("alternates", lambda a: F.trim(a["value"])), F.array().cast("array<string>")))
    own = entries.select(F.explode(forms).alias("t")).select(F.upper("t").alias("token")).where("token <> ''")
    if ngrams is not None:
        own = own.join(ngrams.select(F.upper("ngram").alias("token")), "token", "left_semi")
    return manual.select(F.upper(F.trim("token")).alias("token")).where("token <> ''").union(own).where(F.char_length("token") <= most).distinct()


def gloss_tokens(spark: SparkSession, path: str) -> DataFrame:
    """token, words (of the definition, or of the first sense's), cited (words of the citations) of each entry of a dictionary file."""
    low = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z']+"), F.lit(0))
    e = dictionary(spark, path, canonical_only=False).where(F.coalesce("word", "normalized").isNotNull())
    definition = F.coalesce(F.nullif(F.trim("definition"), F.lit("")), F.trim(F.get("senses", F.lit(0))["definition"]))
    cited = F.flatten(F.transform(F.coalesce("key_citations", F.array().cast("array<struct<location:string,context:string>>")), lambda c: low(c["context"])))
    return e.select("at", F.lower(F.coalesce("word", "normalized")).alias("token"), low(definition).alias("words"), cited.alias("cited")).groupBy("token").agg(F.max_by("words", "at").alias("words"), F.max_by("cited", "at").alias("cited"))


def _yaml(spark: SparkSession, path: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise ImportError("PyYAML is needed to read YAML profiles") from e
    rows = spark.read.text(path, wholetext=True).collect()  # a configuration file
    return (yaml.safe_load(rows[0][0]) if rows else None) or {}


def profiles(spark: SparkSession, built_in: list[dict], manual: str | None = None, generated: str | None = None) -> DataFrame:
    """name, head_terms, motif_terms, origin: profiles by name; a generated one wins over one written by hand, and that over a built-in one.

    Files hold a mapping of names, or a list under ``profiles``.
    """
    found = {str(p["name"]).lower(): (p, "built-in") for p in built_in}
    for path, origin in ((manual, "manual"), (generated, "generated")):
        data = _yaml(spark, path) if path else {}
        listed = data.get("profiles", data)
        listed = [{"name": k, **(v or {})} for k, v in listed.items()] if isinstance(listed, dict) else listed
        found |= {str(p["name"]).lower(): (p, origin) for p in listed if isinstance(p, dict) and p.get("name")}
    words = lambda p, k: [str(x) for x in p.get(k) or []]
    return spark.createDataFrame([(n, words(p, "head_terms"), words(p, "motif_terms"), o) for n, (p, o) in sorted(found.items())], "name string, head_terms array<string>, motif_terms array<string>, origin string")


def domain_config(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """headword, domain (in capitals) of a domain configuration, and its stop-words; headwords that are stop-words are left out."""
    data = _yaml(spark, path)
    stop = sorted({str(x).lower() for x in data.get("headword_stopwords") or [] if x})
    rows = [(str(k).lower(), str(x).upper()) for k, v in (data.get("headword_to_domains") or {}).items() if k and str(k).lower() not in stop for x in v or []]
    return spark.createDataFrame(rows, "headword string, domain string"), stop


def composites(rows: DataFrame) -> DataFrame:
    """token, predicted, gold, error, morphs of a file of composites, whatever its columns are called; errors are rounded to 4 places, 0 where there is none."""
    first = lambda kind, default, *names: F.coalesce(*[F.col(n).cast(kind) for n in names if n in rows.columns], F.lit(default).cast(kind))
    return rows.select(
        first("string", None, "token", "word", "normalized").alias("token"), first("string", None, "predicted", "predicted_gloss").alias("predicted"), first("string", None, "gold", "gold_gloss", "definition").alias("gold"),
        F.round(first("double", 0.0, "recon_error", "error", "reconstruction_error"), 4).alias("error"), first("string", None, "morphs_json", "morphs", "used_morphs").alias("morphs"),
    ).where("token is not null")
