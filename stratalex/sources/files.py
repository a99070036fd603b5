"""File scans and sinks: JSON lines, dictionaries, manuscript leaves, ordered exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_form

#: Fixed format: an entry of a dictionary file.
ENTRY = "word string, canonical string, normalized string, canon_word boolean, definition string, commentary string, pos string, context_tags array<string>, alternates array<struct<value:string,confidence:double>>, key_citations array<struct<location:string,context:string>>, senses array<struct<sense_id:int,definition:string,confidence:double,key_citations:array<struct<location:string,context:string>>>>"
#: Fixed format: a manuscript leaf.
LEAF = "artifact struct<kind:string,name:string,title:string,meta:map<string,string>>, blocks array<string>, grid_lines array<string>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each line that holds a JSON object; blank, malformed and other lines are skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{"))
    known = lines.where(F.expr("try_parse_json(value) is not null"))
    return known.select(F.from_json("value", schema).alias("r")).select("r.*")


def dictionary(spark: SparkSession, path: str, canonical_only: bool = True) -> DataFrame:
    """Entries of a JSON dictionary, a list or an object by headword, with their place in it (``at``); those marked as not canonical go."""
    whole = spark.read.text(path, wholetext=True)
    listed = whole.where(F.col("value").rlike(r"^\s*\[")).select(F.posexplode(F.from_json("value", f"array<struct<{_fields(ENTRY)}>>")).alias("at", "e")).select("at", "e.*")
    keyed = whole.where(F.col("value").rlike(r"^\s*\{")).select(F.posexplode(F.from_json("value", f"map<string,struct<{_fields(ENTRY)}>>")).alias("at", "k", "e"))
    keyed = keyed.select("at", "k", "e.*").withColumn("word", F.coalesce("word", "k")).drop("k")
    every = listed.unionByName(keyed)
    return every.where("coalesce(canon_word, true)") if canonical_only else every


def _fields(schema: str) -> str:
    import re

    return re.sub(r"(^|, )(\w+) ", r"\1\2:", schema).replace(", ", ",")


def _said(*names: str) -> Column:
    """The first of these that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])


def senses(entries: DataFrame) -> DataFrame:
    """word, normalized, definition, sense_id, citations (JSON), canon for each sense; an entry without any is its own first sense.

    A sense without a definition or citations has its entry's; without a number it has its place. Rows without word or definition go.
    """
    own = F.when(F.size("senses") > 0, F.col("senses"))
    rows = entries.select(_said("word").alias("word"), _said("normalized", "word").alias("normalized"), F.col("definition").alias("whole"), F.col("key_citations").alias("cited"), F.coalesce("canon_word", F.lit(False)).alias("canon"), F.posexplode_outer(own).alias("n", "s"))
    some = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    rows = rows.select("word", "normalized", _said("s.definition", "whole").alias("definition"), F.coalesce(F.nullif("s.sense_id", F.lit(0)), F.col("n") + 1, F.lit(1)).alias("sense_id"), F.coalesce(some("s.key_citations"), some("cited")).alias("citations"), "canon")
    return rows.where("word is not null and normalized is not null and definition is not null")


def _listed(sense_first: bool) -> Column:
    """structs (definition, confidence) of an entry: its senses, and its own definition where it has none (``sense_first``) or before them."""
    whole = F.when(_said("definition").isNotNull(), F.array(F.struct(_said("definition").alias("definition"), F.lit(1.0).alias("confidence"))))
    none = F.array().cast("array<struct<definition:string,confidence:double>>")
    each = F.transform("senses", lambda s: F.struct(F.trim(s["definition"]).alias("definition"), F.coalesce(s["confidence"], F.lit(1.0)).alias("confidence")))
    each = F.filter(each, lambda s: s["definition"] != "")
    return F.coalesce(each, whole, none) if sense_first else F.concat(F.coalesce(whole, none), F.coalesce(each, none))


def flat(entries: DataFrame) -> DataFrame:
    """canonical, alternates, senses of each entry as it stands; a word that differs from its normalized form is an alternate."""
    word = F.lower(_said("word"))
    other = F.when(word != F.col("canonical"), F.array(word)).otherwise(F.array().cast("array<string>"))
    rows = entries.withColumn("canonical", F.lower(_said("normalized", "word"))).where("canonical is not null")
    return rows.select("canonical", F.coalesce(other, F.array().cast("array<string>")).alias("alternates"), _listed(False).alias("senses"))


def merged(entries: DataFrame, order: str = "at") -> DataFrame:
    """One row for each normalized form (NFKC, lower case), with what its entries have in ``order``, each value once, and the first pos."""
    key = F.lower(normal_form("NFKC")(_said("normalized", "canonical", "word")))
    rows = entries.withColumn("__key", key).withColumn("own_senses", _listed(True)).where("__key <> ''")
    kept = ["word", "definition", "commentary", "pos", "canon_word", "context_tags", "alternates", "key_citations", "own_senses"]
    own = rows.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *kept))).alias("e"))
    every = lambda c: F.filter(F.transform("e", lambda x: x[c]), lambda v: v.isNotNull())
    clean = lambda a: F.filter(F.transform(a, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return own.select(
        F.col("__key").alias("normalized"),
        F.array_distinct(every("word")).alias("words"),
        F.array_distinct(every("definition")).alias("definitions"),
        F.flatten(every("own_senses")).alias("senses"),
        F.array_distinct(clean(F.flatten(every("context_tags")))).alias("tags"),
        F.array_distinct(clean(F.transform(F.flatten(every("alternates")), lambda x: x["value"]))).alias("alternates"),
        F.array_distinct(F.flatten(every("key_citations"))).alias("citations"),
        F.array_join(F.array_distinct(F.filter(every("commentary"), lambda x: x != "")), "; ").alias("commentary"),
        F.get(F.filter(every("pos"), lambda x: x != ""), F.lit(0)).alias("pos"),
        F.exists(every("canon_word"), lambda x: x).alias("canon_word"),
    )


def leaves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEAF).json(path, multiLine=True)


def prose_tokens(rows: DataFrame) -> DataFrame:
    """name, block, place, raw and the flags of every token of the leaves that have prose."""
    blocks = rows.where("size(blocks) > 0").select(F.col("artifact.name").alias("name"), F.col("artifact.meta").alias("meta"), F.posexplode("blocks").alias("block", "b"))
    tokens = blocks.select("name", "meta", "block", F.posexplode(F.filter(F.split("b", r"\s+"), lambda x: x != "")).alias("place", "raw"))
    return _peeled(tokens, "raw", ["name", "block", "place", "raw"])


def _peeled(rows: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """``keep``, token and flags: off the end go [sic], a run of punctuation and asterisks, then every mark of doubt."""
    marker = F.coalesce(F.nullif(F.col("meta")["uncertain_marker"], F.lit("")), F.lit("?"))
    off = lambda c, pattern: F.regexp_replace(c, pattern, "")
    sic, run, bold = r"(?i)\[sic\]\s*$", r"(?:[,.;:!?]\s*)+$", r"\*+\s*$"
    t1 = rows.withColumn("__a", off(F.col(raw), sic))
    t2 = t1.withColumn("__b", off(F.col("__a"), run))
    t3 = t2.withColumn("__c", off(F.col("__b"), bold))
    doubt = F.when(F.contains("__c", marker), marker).when(F.contains("__c", F.lit("?")), F.lit("?"))
    t4 = t3.withColumn("__d", doubt).withColumn("token", normal_form("NFC")(F.trim(F.coalesce(F.replace("__c", F.col("__d"), F.lit("")), "__c"))))
    punct = F.regexp_replace(F.substring("__a", F.char_length("__b") + 1, 1 << 30), r"\s", "")
    return t4.select(*keep, "token", F.col(raw).rlike(sic).alias("sic"), F.nullif(punct, F.lit("")).alias("trail_punct"), F.col("__b").rlike(bold).alias("bold"), F.col("__d").isNotNull().alias("uncertain"), F.col("token").rlike(r"\p{Lu}").alias("capital"))


def grid_cells(rows: DataFrame, delimiter: str = "|") -> DataFrame:
    """name, line, cell, token, flags, orientation, state of every cell of the leaves that have a grid.

    A leaf's metadata names its tokens of lacunae, of empty cells and of doubt. A cell of which nothing is left is blank.
    """
    lines = rows.where("size(grid_lines) > 0").select(F.col("artifact.name").alias("name"), F.col("artifact.meta").alias("meta"), F.posexplode("grid_lines").alias("line", "l"))
    by = F.coalesce(F.nullif(F.col("meta")["delimiter"], F.lit("")), F.lit(delimiter))
    cells = lines.select("name", "meta", "line", F.posexplode(F.split("l", F.concat(F.lit(r"\Q"), by, F.lit(r"\E")), -1)).alias("cell", "raw")).withColumn("raw", F.trim("raw"))
    named = lambda k, other: F.lower(F.coalesce(F.nullif(F.trim(F.col("meta")[k]), F.lit("")), F.lit(other)))
    low = F.lower("raw")
    state = F.when(low == named("lacuna_token", "[LACUNA]"), "lacuna").when(low.isin("", "null", "[null]") | (low == named("intentionally_empty", "[NULL]")), "blank").otherwise("text")
    turn = r"\^(?:\[(-?\d+)\]|(-?\d+))\s*$"
    turned = F.concat(F.regexp_extract("raw", turn, 1), F.regexp_extract("raw", turn, 2))
    cells = cells.withColumn("state", state).withColumn("orientation", F.when((F.col("state") == "text") & (turned != ""), turned.cast("int")))
    cells = _peeled(cells.withColumn("bare", F.when(F.col("state") == "text", F.regexp_replace("raw", turn, ""))), "bare", ["name", "line", "cell", "orientation", "state"])
    return cells.withColumn("state", F.when(F.col("token") == "", "blank").otherwise(F.col("state"))).withColumn("token", F.nullif("token", F.lit("")))


def floats(text: Column) -> Column:
    """A JSON or comma separated list as doubles; null if any of its items isn't one."""
    items = F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), ",")
    read = F.transform(items, lambda x: F.trim(x).try_cast("double"))
    return F.when(~F.exists(read, lambda x: x.isNull()), read)


def strings(text: Column) -> Column:
    """A JSON, comma or pipe separated list as non-blank strings."""
    listed = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))
    return F.filter(F.transform(F.coalesce(listed, F.split(text, "[,|]")), lambda x: F.trim(x)), lambda x: x != "")


def write_csv(rows: DataFrame, path: str, order: list) -> None:
    """CSV in global order, as many files as there are ranges; a reader that takes them by name has the order."""
    rows.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_yaml(rows: DataFrame, path: str, key: str) -> None:
    """A YAML mapping, one line for each row: ``key`` and the other columns as a flow mapping (JSON is YAML)."""
    rest = F.to_json(F.struct(*[c for c in rows.columns if c != key]))
    rows.orderBy(key).select(F.concat(F.regexp_replace(F.to_json(F.array(F.col(key).cast("string"))), r"^\[|\]$", ""), F.lit(": "), rest)).write.mode("overwrite").text(path)


def write_html(spark: SparkSession, sections: dict[str, DataFrame], path: str, title: str, rows: int = 50) -> None:
    """A report with the first ``rows`` rows of each section as a table; the sections come ordered."""
    from html import escape

    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in sections.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        parts.append(f"<h2>{escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body or '<tr><td>no rows</td></tr>'}</tbody></table>")
    page = "\n".join([*parts, "</body></html>"])
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
