"""A corpus pipeline: language ID, line dedup, near-duplicates, decontamination, mixing.

Each stage reads all that the stage before it kept; all but the last return the columns of documents. A stage's frame is to be
written before the next stage begins, which drops the tables that it stood on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.llm import common, decontaminate, language, lines, mixing, neardup

#: Tables of the last stage, its own alone.
_last: list[str] = []


def _stage(spark: SparkSession, build) -> DataFrame:
    common.drop(spark, _last)
    common.small_batches(spark)
    with common.owned(_last):
        return build()


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language learned from the labelled ones accepts.

    Null, empty and letterless texts go; long texts are judged whole; repeated rows get one answer; ties between languages don't
    matter here; a null doc_id, lang or source is kept; without labelled rows all documents go; an empty table stays empty; further columns stay.
    """
    return _stage(spark, lambda: language.clean(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks, cut by content, and then the lines that earlier documents have; one of which nothing but white space is left is dropped.

    Null texts stay, empty ones go; long texts are cut in whole; of equal documents the least doc_id keeps its lines, rows of one doc_id
    are judged alike, and one without doc_id keeps them; further columns stay; an empty table stays empty.
    """
    return _stage(spark, lambda: lines.clean(docs).where(F.col("text").isNull() | F.col("text").rlike(r"\S")))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id.

    Null and empty texts and rows without doc_id stay; long texts are compared whole; repeated rows of one doc_id stay or go together;
    further columns stay; an empty table stays empty.
    """
    return _stage(spark, lambda: neardup.clean(docs))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates.

    Null and empty texts stay; long texts are searched whole; each row is judged by its own text, whatever its doc_id, so repeated rows stay
    or go together; further columns stay; an empty table, or an empty benchmark, removes nothing.
    """
    return _stage(spark, lambda: decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many words of each, its repeats counted.

    Null and empty texts have no word and aren't taken; a long text is taken whole or not; a null source is a source; ties are put in order by
    the whole row; further columns aren't returned; an empty table gives no rows.
    """
    return _stage(spark, lambda: mixing.mix(docs, keep=["text", "lang", "source", "n_chars"]).where("taken > 0"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
]
#: SQL can't express nearest centroids nor sketches; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's output is a table of its own, dropped when the next one's is written."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        out = f"{common.shared_dir(spark)}/stratalex/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(out)
        common.drop(spark, before)
        before.append(out)
        docs = spark.read.parquet(out)
    common.drop(spark, _last)
    return docs
