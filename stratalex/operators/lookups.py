"""Evidence lookups: payloads of definitions and fragments, runs, anchors, and the joins that gather what is known of a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, letters_only
from ..functions.vectors import cosine

YES = ("1", "true", "yes", "y")


def _field(payload: Column, *names: str) -> Column:
    return F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names])


def _unfenced(payload: Column) -> Column:
    inner = F.regexp_extract(payload, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(payload))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def definition_payload(payload: Column) -> Column:
    """struct(definition, rejected) of a payload: JSON, JSON in a code fence, JSON whose ``raw_text`` holds one, or plain text."""

    def read(body: Column) -> Column:
        is_object = body.startswith("{") & F.get_json_object(body, "$").isNotNull()
        named = F.trim(_field(body, "DEFINITION", "definition"))
        definition = F.when(is_object, F.when(named != "", named)).otherwise(F.when(body != "", body))
        return F.struct(definition.alias("definition"), F.coalesce(is_object & F.lower(F.trim(_field(body, "REJECTED", "rejected"))).isin(*YES), F.lit(False)).alias("rejected"))

    def inner(body: Column) -> Column:
        nested = F.when(_field(body, "DEFINITION", "definition").isNull(), _field(body, "raw_text", "RAW_TEXT"))
        return _let(F.when(nested.isNotNull(), _unfenced(nested)).otherwise(body), read)

    return _let(_unfenced(payload), inner)


def acceptable(payload: Column) -> Column:
    """Whether a payload has a definition and isn't rejected."""
    return _let(definition_payload(payload), lambda x: x["definition"].isNotNull() & ~x["rejected"])


def evaluation(payload: Column) -> Column:
    """The evaluation that a payload names, by its JSON or else by its text."""
    found = F.regexp_extract(payload, r'"(?i:evaluation)"\s*:\s*"([^"]+)"', 1)
    return F.coalesce(_field(payload, "EVALUATION", "evaluation"), F.when(F.get_json_object(payload, "$").isNull() & (found != ""), found))


def fragments(payload: Column) -> Column:
    """Letters of the fragments in a JSON array of texts, or of objects with text, residual or fragment; none for anything else."""
    items = F.coalesce(F.from_json(payload, "array<string>"), F.array().cast("array<string>"))
    text = F.transform(items, lambda x: letters_only(F.when(x.startswith("{"), F.coalesce(*[F.when(F.get_json_object(x, f"$.{n}") != "", F.get_json_object(x, f"$.{n}")) for n in ("text", "residual", "fragment")])).otherwise(x)))
    return F.filter(text, lambda x: x.isNotNull() & (x != ""))


def json_like(rows: DataFrame, payload: str) -> DataFrame:
    """Rows whose payload begins like an object and doesn't report an error."""
    text = F.trim(payload)
    return rows.where(text.startswith("{") & ~F.upper(text).startswith("[ERROR]") & ~F.upper(text).startswith("ERROR"))


def of_run(rows: DataFrame, runs: DataFrame, wanted: list | None = None) -> DataFrame:
    """Rows of the runs asked for, or of the one created last (then of the greatest id)."""
    if wanted:
        return rows.where(F.col("run_id").isin(*wanted))
    last = runs.agg(F.max(F.struct("created_at", "run_id"))["run_id"].alias("run_id"))
    return rows.join(F.broadcast(last), "run_id")  # one row


def evidence_mode(rows: DataFrame, mode: str = "all") -> DataFrame:
    """All evidence, or that of ``clusters-only`` or ``residuals-only``."""
    return rows if mode == "all" else rows.where(F.col("kind") == {"clusters-only": "cluster", "residuals-only": "residual"}[mode])


def searchable(rows: DataFrame, gloss: str, score: str, least: float) -> DataFrame:
    """Results of a search without glosses that name letters or regions, or score less than ``least``."""
    return rows.where(~F.lower(gloss).rlike("(?:^|[^a-z])(?:letter|aethyr)") & (F.col(score) >= least))


def segments_of(decompositions: DataFrame, token: Column, run: Column | None = None) -> DataFrame:
    """The segments of a token in order, of one run or of all."""
    own = decompositions.where(F.lower("token") == F.lower(token))
    return (own if run is None else own.where(F.col("run_id") == run)).orderBy("run_id", "seg_index")


def singleton_candidates(details: DataFrame, clusters: DataFrame, uncovered: int = 1, least: float = 0.35, most: int = 500) -> DataFrame:
    """Words with exactly ``uncovered`` fragments left and a residual of ``least`` or more, the greatest first (a report of ``most`` rows)."""
    rows = details.where((F.col("residual_ratio") >= least) & (F.json_array_length("uncovered_json") == uncovered))
    rows = rows.withColumn("fragment", F.trim(F.get_json_object("uncovered_json", "$[0].text"))).join(clusters.select("cluster_id", "ngram"), "cluster_id")
    top = rows.orderBy(F.desc("residual_ratio"), "residual_id").limit(most)
    return top.where("coalesce(fragment, '') <> ''").select("residual_id", "cluster_id", F.upper("fragment").alias("fragment"), "residual_ratio", F.upper("ngram").alias("root"))


def flagged(rows: DataFrame, morph: str, payload: str) -> DataFrame:
    """morph, flagged: whether any of its payloads is rejected or has no definition."""
    return rows.groupBy(F.upper(F.trim(F.col(morph))).alias("morph")).agg(F.bool_or(~acceptable(F.coalesce(F.col(payload), F.lit("")))).alias("flagged"))


def accepted_definitions(rows: DataFrame, morph: str, payload: str, score: str) -> DataFrame:
    """morph, definition, n, score: how often each accepted definition of a morph stands, case aside, and its greatest score."""
    known = rows.withColumn("__x", definition_payload(F.col(payload))).where("__x.definition is not null and not __x.rejected")
    return known.groupBy(F.col(morph).alias("morph"), F.lower("__x.definition").alias("definition")).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("score"))


def attested(clusters: DataFrame, definitions: DataFrame) -> DataFrame:
    return clusters.join(definitions, "cluster_id")


def root_profiles(glosses: DataFrame, profiles: DataFrame, counts: list[str], by_cluster: bool = False) -> DataFrame:
    """Glosses beside the attachment counts of their root: of each of its clusters, so rows fan out, or of the gloss's own cluster, 0 where there are none."""
    if not by_cluster:
        return glosses.join(profiles.withColumnRenamed("cluster_id", "profile_cluster"), "root", "left")
    return glosses.join(profiles, ["root", "cluster_id"], "left").fillna(0, counts)


def unnested_evidence(rows: DataFrame, key: str, payload: str, path: str = "$.EVIDENCE") -> DataFrame:
    """key, place, item: a row for each entry of a JSON array inside a payload."""
    return rows.select(key, F.posexplode(F.from_json(F.get_json_object(payload, path), "array<string>")).alias("place", "item"))


def remaining(residuals: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Residuals that no dictionary attests."""
    return residuals.join(known.select(key), key, "left_anti")


def substring_evidence(words: DataFrame, evidence: DataFrame, least: int = 1, most: int = 7) -> DataFrame:
    """word, start, morph and the evidence of every slice of the word that has some, by variant."""
    slices = words.select("word", F.explode(char_ngrams(F.upper("word"), least, most)).alias("x")).select("word", "x.start", F.col("x.gram").alias("morph"))
    return slices.join(evidence, "morph")


def alias_evidence(aliases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of a spelling, given to every surface that is looked up by it; aliases: surface, lookup."""
    return aliases.join(evidence.withColumnRenamed("morph", "lookup"), "lookup").withColumnRenamed("surface", "morph")


def packet_pairs(packets: DataFrame, root: str, item: str, likeness, least: float) -> DataFrame:
    """root, a, b, sim: pairs of a root's packets of likeness ``least`` or more. A root has as many packets as it has analyses."""
    a, b = packets.alias("a"), packets.alias("b")
    both = a.join(b, (F.col(f"a.{root}") == F.col(f"b.{root}")) & (F.col(f"a.{item}") < F.col(f"b.{item}")))
    return both.select(F.col(f"a.{root}").alias(root), F.col(f"a.{item}").alias("a"), F.col(f"b.{item}").alias("b"), likeness("a", "b").alias("sim")).where(F.col("sim") >= least)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def enriched(canon: DataFrame, dictionary: DataFrame, key: str, order: str) -> DataFrame:
    return canon.join(last_wins(dictionary, key, order).drop(order), key, "left")


def dictionary_morphs(words: DataFrame, dictionary: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """word, morph, start and the dictionary's row of every slice of the word that it has; of equal slices the first. dictionary: normalized, ..."""
    longest = most or (dictionary.agg(F.max(F.char_length("normalized"))).first()[0] or 1)
    slices = words.select("word", F.explode(char_ngrams(F.lower("word"), least, longest)).alias("x")).groupBy("word", F.col("x.gram").alias("normalized")).agg(F.min("x.start").alias("start"))
    return slices.join(dictionary, "normalized").withColumn("morph", F.upper("normalized")).drop("normalized")


def word_evidence(words: DataFrame, sources: dict[str, DataFrame], neighbours: DataFrame) -> DataFrame:
    """word, kind, text: what each source (word, text) knows; vector neighbours only of words that no source knows."""
    known = None
    for kind, rows in sources.items():
        part = words.join(rows, "word").select("word", F.lit(kind).alias("kind"), "text")
        known = part if known is None else known.unionByName(part)
    rest = words.join(known.select("word").distinct(), "word", "left_anti").join(neighbours, "word")
    return known.unionByName(rest.select("word", F.lit("neighbour").alias("kind"), "text"))


def index_lookup(ngrams: DataFrame, membership: DataFrame) -> DataFrame:
    """ngram, canonical: the distinct words that an index has for each of ``ngrams``, case aside."""
    wanted = ngrams.select(F.lower("ngram").alias("ngram")).distinct()
    return membership.select(F.lower("ngram").alias("ngram"), "canonical").join(wanted, "ngram").distinct()


def seed_history(seeds: DataFrame, runs: DataFrame) -> DataFrame:
    """Seeds with their runs' stage and time and their place in time for each n-gram; seeds: run_id, ngram, ...; runs: run_id, stage, created_at."""
    return seeds.join(runs, "run_id").withColumn("place", F.row_number().over(Window.partitionBy("ngram").orderBy("created_at", "run_id")))


def nearest_known(words: DataFrame, vectors: DataFrame, known: DataFrame, k: int = 10, least: float = 0.4) -> DataFrame:
    """item, near, sim: for each of ``words`` (item, vec) its ``k`` nearest vectors (item, vec) among the ``known`` items, of cosine ``least`` or more.

    The known vectors are compared with all words, so they are a dictionary's, not a corpus's: they go to the executors if the planner finds them small.
    """
    others = vectors.join(known, "item", "left_semi").select(F.col("item").alias("near"), F.col("vec").alias("other"))
    pairs = words.join(others, F.col("item") != F.col("near")).select("item", "near", F.round(cosine(F.col("vec"), F.col("other")), 9).alias("sim")).where(F.col("sim") >= least)
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sim"), "near"))).where(F.col("place") <= k)


def bridge(roots: DataFrame, partners: DataFrame, residuals: DataFrame, most_partners: int = 6, most_residuals: int = 5) -> DataFrame:
    """root, kind, name, weight: what analyses tell of each root: its strongest partners and most frequent residuals, so many of each at most."""

    def top(rows, kind, k):
        place = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("weight"), "name"))
        return roots.select("root").join(rows, "root").withColumn("place", place).where(F.col("place") <= k).select("root", F.lit(kind).alias("kind"), "name", "weight", "place")

    return top(partners, "partner", most_partners).unionByName(top(residuals, "residual", most_residuals))


def window_glosses(windows: DataFrame, glosses: DataFrame) -> DataFrame:
    """window, glosses: the gloss tokens of a window's tokens in order, tokens without a gloss left out. windows: window, tokens; glosses: token, words."""
    rows = windows.select("window", F.posexplode("tokens").alias("at", "token")).join(glosses, "token", "left")
    return rows.groupBy("window").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("words", F.array().cast("array<string>")).alias("words")))), lambda x: x["words"])).alias("glosses"))


def anchors(rows: DataFrame, morph: str, cohesion: str, uses: int = 3, least: float = 0.40) -> DataFrame:
    """morph, uses, cohesion of morphs used often enough by groups that hang together."""
    return rows.groupBy(F.upper(morph).alias("morph")).agg(F.count(F.lit(1)).alias("uses"), F.avg(cohesion).alias("cohesion")).where((F.col("uses") >= uses) & (F.col("cohesion") >= least))


def first_of_tier(rows: DataFrame, tiers: list[str], form: str, order: list) -> DataFrame:
    """Rows in the order of their tiers, one for each normalised form within a tier."""
    rank = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    one = rows.withColumn("tier_rank", rank).where("tier_rank > 0").withColumn("__n", F.row_number().over(Window.partitionBy("tier", F.lower(form)).orderBy(*order)))
    return one.where("__n = 1").drop("__n")


def queue_missing(queue: DataFrame, inventory: DataFrame) -> DataFrame:
    """The queue (ngram, queue_index, cycles) with the inventory's n-grams that it lacks at its end, in the order of their names."""
    last = queue.agg(F.coalesce(F.max("queue_index"), F.lit(-1)).alias("last"))
    new = inventory.select("ngram").distinct().join(queue.select("ngram"), "ngram", "left_anti")
    # names are numbered over all: a queue is a list that one process works off
    new = new.withColumn("n", F.row_number().over(Window.orderBy("ngram"))).join(F.broadcast(last)).select("ngram", (F.col("last") + F.col("n")).cast("long").alias("queue_index"), F.lit(0).cast("long").alias("cycles"))
    return queue.unionByName(new)


def best_candidates(rows: DataFrame, word: str, composite: Column, bonus: Column, k: int, order: str) -> DataFrame:
    """The ``k`` best of each word's candidates by composite and bonus (the feature's own limit)."""
    place = F.row_number().over(Window.partitionBy(word).orderBy(F.desc("total"), order))
    return rows.withColumn("total", F.round(composite + bonus, 9)).withColumn("place", place).where(F.col("place") <= k)


def best_candidate(rows: DataFrame, word: str, score: str, segments: str, least: int, order: str) -> DataFrame:
    """The best of each word's candidates with ``least`` segments or more."""
    return rows.where(F.col(segments) >= least).groupBy(word).agg(F.max_by(order, F.struct(score, -F.col(order))).alias(order), F.max(score).alias(score))


def merged_pool(*pools: DataFrame, key: list[str], score: str) -> DataFrame:
    """Decompositions of several searches, each once with its greatest score."""
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    return out.groupBy(*key).agg(F.max(score).alias(score))


def review_counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows there are, and of how many each condition holds."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def group_rank(confidence: Column, cohesion: Column, attachment: Column, members: Column, alignment: Column, support: Column, examples: Column, review: Column) -> Column:
    """Weight of a root's group; all parts from 0 to 1. Fixed values."""
    return F.greatest(F.lit(0.0), 0.25 * confidence + 0.20 * cohesion + 0.15 * attachment + 0.15 * members + 0.10 * alignment + 0.10 * support + 0.05 * examples - 0.20 * review)


def chosen_note(rows: DataFrame, root: str, gap: float, least: float, tokens: int) -> DataFrame:
    """For each root the partner whose loss without it exceeds the root's own loss most; rows: root, partner, delta_partner, delta_root, n_tokens."""
    good = rows.withColumn("dominance", F.col("delta_partner") - F.col("delta_root")).where((F.col("n_tokens") >= tokens) & (F.col("dominance") >= gap) & (F.col("delta_partner") >= least))
    return good.withColumn("__n", F.row_number().over(Window.partitionBy(root).orderBy(F.desc("dominance"), "partner"))).where("__n = 1").drop("__n")


def seed_snapshots(counts: DataFrame, members: DataFrame, glosses: DataFrame, most: int = 8) -> DataFrame:
    """ngram, tf, canonicals (the first ``most`` by name), gloss."""
    own = members.groupBy("ngram").agg(F.slice(F.array_sort(F.collect_set("canonical")), 1, most).alias("canonicals"))
    return counts.join(own, "ngram", "left").join(glosses, "ngram", "left").select("ngram", "tf", F.coalesce("canonicals", F.array().cast("array<string>")).alias("canonicals"), "gloss")


def finished(rows: DataFrame, status: str = "status") -> DataFrame:
    """Conditional status update: what was skipped stays skipped, everything else is completed."""
    return rows.withColumn(status, F.when(F.col(status) == "skipped", "skipped").otherwise("completed"))


def skip_rows(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows with the code of the first reason to skip them that holds."""
    code = F.lit(None).cast("string")
    for name, holds in reversed(list(reasons.items())):
        code = F.when(holds, name).otherwise(code)
    return rows.withColumn("reason_code", code).where("reason_code is not null")


def noted(definitions: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Definitions (key, partners, notes: arrays) with the note of a partner (key, partner, note) added unless it is there already; ``changed`` says where."""
    both = definitions.join(notes, key, "left")
    new = F.col("partner").isNotNull() & ~F.coalesce(F.exists("partners", lambda x: F.lower(x) == F.lower(F.col("partner"))), F.lit(False))
    return both.select(key, F.when(new, F.array_append("partners", F.col("partner"))).otherwise(F.col("partners")).alias("partners"), F.when(new, F.array_append("notes", F.col("note"))).otherwise(F.col("notes")).alias("notes"), new.alias("changed"))


def lookup_text(rows: DataFrame, word: str, definition: str, citations: str) -> DataFrame:
    """word, text, json: a lookup's matches as lines for people and as JSON."""
    lines = F.concat(F.col(word), F.lit(": "), F.coalesce(F.col(definition), F.lit("(no definition)")), F.when(F.size(citations) > 0, F.concat(F.lit(" ["), F.array_join(citations, "; "), F.lit("]"))).otherwise(F.lit("")))
    return rows.select(word, lines.alias("text"), F.to_json(F.struct(word, definition, citations)).alias("json"))


def exported(rows: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """key, items: the rows of each key as a JSON array of objects, in order."""
    return rows.groupBy(*key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__ord"), F.struct(*fields).alias("o")))), lambda x: x["o"])).alias("items"))


def diagonals(cells: DataFrame, group: str, row: str, column: str) -> DataFrame:
    """Cells with their two diagonals: falling (column - row) and rising (column + row)."""
    return cells.select("*", F.explode(F.array(F.struct(F.lit("falling").alias("direction"), (F.col(column) - F.col(row)).alias("diagonal")), F.struct(F.lit("rising").alias("direction"), (F.col(column) + F.col(row)).alias("diagonal")))).alias("x")).select("*", "x.*").drop("x")


def merged_maps(*maps: Column) -> Column:
    """One map of all, the last one's value for a key that several have."""
    entries = F.concat(*[F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))) for m in maps])
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
