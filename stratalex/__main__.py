"""Command line: ``list`` the registered queries, ``run`` one over a folder of tables, or apply an operator to Parquet files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import collocation, factorize, lookup, refresh, residual, segment, vectors
from .operators.translate import translations
from .plans import registry
from .sources import corpus, files

#: Operators by command: inputs, options (name, type, default) and what is run on them.
COMMANDS = {
    "colloc": (["pairs"], [("min_count", int, 2)], lambda s, p, o: collocation.collocations(s.read.parquet(*p), o.min_count)),
    "attrib": (["pairs"], [], lambda s, p, o: vectors.leave_one_out(s.read.parquet(*p))),
    "residual": (["rows"], [], lambda s, p, o: residual.subtract(s.read.parquet(*p))),
    "decompose": (["candidates"], [("total", int, 1), ("width", int, 15)], lambda s, p, o: segment.segment(s.read.parquet(*p), o.total, o.width)),
    "factorize": (["counts", "targets"], [("alpha", float, 0.05)], lambda s, p, o: factorize.ridge(*map(s.read.parquet, p), o.alpha)),
    "fuzzy": (["needles", "known"], [("least", int, 70), ("most", int, 10)], lambda s, p, o: lookup.fuzzy(*map(s.read.parquet, p), o.least, o.most)),
    "translate-word": (["words", "dictionary"], [("strategy", str, "prefer-balance"), ("whole_words", int, 1), ("top", int, 5)], lambda s, p, o: translations(s.read.parquet(p[0]), files.senses(files.dictionary(s, p[1])), o.strategy, bool(o.whole_words), o.top)),
    "preanalyze": (["dictionary"], [("most", int, 7)], lambda s, p, o: corpus.trusted_seeds(s.createDataFrame([], "token string"), files.dictionary(s, *p).withColumn("canonical", F.coalesce("canonical", "word")), None, o.most)),
    "refresh": (["rows"], [], lambda s, p, o: s.read.parquet(*p).select("root", "word", refresh.refreshed(F.col("word"), F.col("root"), F.col("segments")).alias("b")).select("root", "word", "b.*")),
    "composite": (["tokens", "vectors"], [("size", int, 64)], lambda s, p, o: refresh.composites(*map(s.read.parquet, p), o.size)),
    "find-ngram": (["dictionary"], [("ngram", str, None), ("canon_only", int, 0), ("alternates", int, 0)], lambda s, p, o: find(files.dictionary(s, *p, False), o.ngram, bool(o.canon_only), bool(o.alternates))),
}


def find(entries, ngram: str, canon_only: bool = False, alternates: bool = False):
    """Entries of whose letters, or those of an alternate, ``ngram`` is a part, by normalized form and word."""
    letters = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))
    needle = "".join(c for c in ngram if c.isalpha()).lower()
    if not needle:
        raise ValueError("an n-gram has a letter at least")
    own = F.array(F.coalesce("normalized", "word"))
    named = F.concat(own, F.coalesce(F.transform("alternates", lambda x: x["value"]), F.array().cast("array<string>"))) if alternates else own
    hits = F.filter(named, lambda x: F.contains(letters(x), F.lit(needle)))
    rows = entries.where("canon_word") if canon_only else entries
    return rows.select("*", hits.alias("matched")).where(F.size("matched") > 0).orderBy(F.lower(F.coalesce("normalized", "word")), F.lower("word"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stratalex")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(registry.queries()))
    run.add_argument("tables")
    run.add_argument("out")
    run.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    for name, (inputs, options, _) in COMMANDS.items():
        own = commands.add_parser(name)
        for x in (*inputs, "out"):
            own.add_argument(x)
        for option, kind, default in options:
            own.add_argument(f"--{option.replace('_', '-')}", type=kind, default=default, required=default is None)
        own.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    given = parser.parse_args(argv)
    if given.command == "list":
        print("\n".join(sorted(registry.queries())))
        return
    spark = SparkSession.builder.appName(f"stratalex {given.command}").getOrCreate()
    if given.command == "run":
        rows = registry.queries()[given.query](spark, given.tables)
    else:
        inputs, _, apply = COMMANDS[given.command]
        rows = apply(spark, [getattr(given, x) for x in inputs], given)
    rows.write.mode("error").format(given.format).options(**({"header": True} if given.format == "csv" else {})).save(given.out)


if __name__ == "__main__":
    main()
