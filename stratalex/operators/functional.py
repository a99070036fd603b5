"""What the parts of a word do: the profile of a root's attachments, scores of a part in its place, the word's function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp

AXES, PLACES = ("nounness", "modifier", "verbness"), ("prefix", "suffix", "infix", "free")
#: Words in a root's glosses that point to an operator.
HINTS = (
    "association", "clause", "clause-introducer", "comparison", "conjunction", "deictic", "demonstrative", "directional", "locative", "negation",
    "ordinal", "polarity", "possessive", "pronoun", "quantifier", "relative", "relativizer", "relation", "relational", "sequence",
)
#: How strong the support of a part is; any other and none.
SUPPORT, LITTLE = {"cluster": 1.0, "dictionary": 0.85, "attested": 0.85, "residual": 0.75, "hypothesis": 0.60}, 0.20


def _number(c: Column | str, other: float = 0.0) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(other)).cast("double")


def _unit(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def attachments(rows: DataFrame, root: str) -> DataFrame:
    """root, the weighted mean likelihood of each place, the most that was observed in each, productivity, estimated profiles.

    ``rows``: root, weight, prefix, suffix, free, observed_prefix, observed_suffix, observed_infix, observed_free, productivity,
    estimated. An infix's likelihood is its share of what was observed. Nulls count as 0; without weight a mean is 0.
    """
    total = F.sum(_number("weight"))
    mean = lambda c: F.when(total > 0, _unit(F.sum(_number(c) * _number("weight")) / total)).otherwise(0.0)
    sums = [F.round(mean(c), 4).alias(c) for c in ("prefix", "suffix", "free", "productivity")]
    seen = [F.coalesce(F.max(f"observed_{p}"), F.lit(0)).cast("long").alias(f"observed_{p}") for p in PLACES]
    out = rows.groupBy(root).agg(*sums, *seen, F.array_sort(F.collect_set(F.nullif("estimated", F.lit("")))).alias("estimated"))
    every = sum((F.col(f"observed_{p}") for p in PLACES), F.lit(0))
    return out.withColumn("infix", F.when(every > 0, F.round(F.col("observed_infix") / every, 4)).otherwise(0.0))


def _place(at: Column, n: Column) -> Column:
    return F.when(n <= 1, "free").when(at == 0, "prefix").when(at >= n - 1, "suffix").otherwise("infix")


def _of(place: Column, prefix: str = "") -> Column:
    out = F.lit(None)
    for p in PLACES:
        out = F.when(place == p, F.col(f"{prefix}{p}")).otherwise(out)
    return out


def parts(morphs: DataFrame, profiles: DataFrame, word: str) -> DataFrame:
    """A row for each part of a word: its place, how it fits there, and its scores as head, modifier and operator, with its role.

    ``morphs``: word, at (order), morph, support, quality (null: by support). ``profiles``, one row for each morph: morph, nounness,
    modifier, verbness, authority, instability, ambiguity, prefix, suffix, infix, free, observed_* (as ``attachments``), estimated,
    terms (one text). Parts without a profile have the role ``unknown``. Parts without a morph go.
    """
    w = Window.partitionBy(word)
    own = morphs.where("morph <> ''").withColumn("morph", F.upper("morph"))
    own = own.withColumn("index", F.row_number().over(w.orderBy("at", "morph")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("place", _place(F.col("index"), F.col("n")))
    rows = own.join(profiles.withColumn("morph", F.upper("morph")).withColumn("known", F.lit(True)), "morph", "left")
    seen = sum((_number(f"observed_{p}") for p in PLACES), F.lit(0.0))
    share = F.when(seen > 0, _number(_of(F.col("place"), "observed_")) / seen).otherwise(0.0)
    likely = _number(_of(F.col("place")), 0.5)
    strength = F.lit(LITTLE)
    for name, worth in SUPPORT.items():
        strength = F.when(F.lower(F.trim("support")) == name, worth).otherwise(strength)
    low = F.lower(F.coalesce("terms", F.lit("")))
    hints = sum((low.rlike(rf"\b{h}\b").cast("int") for h in HINTS), F.lit(0))
    bound = F.exists(F.coalesce("estimated", F.array().cast("array<string>")), lambda e: F.lower(e).rlike("prefix|suffix"))
    rows = rows.withColumns({
        "fit": _unit(F.when(share > 0, 0.55 * likely + 0.45 * share).otherwise(likely)), "quality": _unit(F.coalesce(F.col("quality").cast("double"), strength)),
        "authority": _number("authority"), "steady": _unit(1 - _number("instability")), "length": _unit(F.log1p(F.char_length("morph")) / F.log1p(F.lit(7.0))),
        "operator": _unit(0.65 * _number("modifier") + _unit(0.2 * hints) + F.when(bound, 0.15).otherwise(0.0)),
    })
    rows = rows.withColumns({
        "head": _unit(0.22 * F.col("quality") + 0.20 * F.greatest(_number("nounness"), _number("verbness")) + 0.17 * F.col("steady") + 0.16 * F.col("fit") + 0.15 * F.col("authority") + 0.10 * F.col("length") - 0.18 * F.col("operator")),
        "modifying": _unit(0.45 * _number("modifier") + 0.20 * F.col("operator") + 0.18 * F.col("fit") + 0.10 * F.col("quality") + 0.07 * F.col("steady")),
        "doubt": _unit(0.45 * _number("ambiguity") + 0.35 * _number("instability") + 0.20 * (1 - F.col("authority"))),
    })
    head, mod, op = F.col("head"), F.col("modifying"), F.col("operator")
    role = F.when(F.col("doubt") >= 0.72, "uncertain").when((op >= 0.58) & (op >= head + 0.04), "operator").when((mod >= 0.55) & (mod >= head), "modifier")
    role = role.when(head >= 0.42, F.when(_number("verbness") > _number("nounness"), "predicate_head").otherwise("nominal_head")).otherwise("uncertain")
    known = F.coalesce("known", F.lit(False))
    plain = {"fit": 0.5, "authority": 0.0, "head": 0.0, "modifying": 0.0, "operator": 0.0, "doubt": 0.75}
    scores = [F.when(known, F.col(c)).otherwise(v).alias(c) for c, v in plain.items()]
    return rows.select(word, "index", "morph", "place", known.alias("known"), *scores, F.when(known, role).otherwise("unknown").alias("role"), *[_number(a).alias(a) for a in AXES])


def functions(scored: DataFrame, word: str) -> DataFrame:
    """word, inferred, score, confidence, raw, heads, operators, modifiers, uncertain from the rows of ``parts``; ties keep the parts' order."""
    role_weight = F.when(F.col("role").isin("operator", "modifier"), 0.65).when(F.col("role") == "unknown", 0.30).otherwise(1.0)
    weight = (0.35 + 0.45 * F.col("head") + 0.20 * F.col("authority")) * role_weight
    rows = scored.withColumn("w", weight)
    part = F.struct("index", "morph", "known", "fit", "head", "modifying", "operator", "doubt", "role")
    g = rows.groupBy(word).agg(
        F.array_sort(F.collect_list(part)).alias("s"), F.avg("fit").alias("fit"), F.avg("doubt").alias("doubt"), F.avg("authority").alias("authority"), F.avg((~F.col("known")).cast("double")).alias("bare"),
        *[_unit(F.sum(F.col("w") * F.col(a)) / F.sum("w")).alias(a) for a in AXES],
    )
    g = g.withColumn("h", F.array_sort(F.transform("s", lambda x: F.struct((-x["head"]).alias("less"), x["index"].alias("index"), x["morph"].alias("morph"), x["role"].alias("role")))))
    least = F.greatest(F.lit(0.45), -F.get("h", F.lit(0))["less"] - 0.08)
    names = lambda c, keep: F.transform(F.filter(c, keep), lambda x: x["morph"])
    inside = lambda x, *cs: sum((F.array_contains(c, x["morph"]).cast("int") for c in cs), F.lit(0)) > 0
    g = g.withColumn("least", least).withColumn("heads", F.slice(names("h", lambda x: -x["less"] >= F.col("least")), 1, 2))
    g = g.withColumn("operators", names("s", lambda x: (x["operator"] >= 0.55) & ~inside(x, F.col("heads"))))
    g = g.withColumn("modifiers", names("s", lambda x: (x["modifying"] >= 0.50) & ~inside(x, F.col("heads"), F.col("operators"))))
    g = g.withColumn("uncertain", F.array_sort(F.array_distinct(names("s", lambda x: ~x["known"] | (x["doubt"] >= 0.55) | (x["fit"] <= 0.25)))))
    first = F.slice("h", 1, 2)
    local = -F.aggregate(first, F.lit(0.0), lambda total, x: total + x["less"]) / F.size(first)
    axes = F.sort_array(F.array(*AXES), asc=False)
    g = g.withColumns({"local": local, "penalty": _unit(F.col("doubt") + 0.15 * F.col("bare")), "gap": F.get(axes, F.lit(0)) - F.get(axes, F.lit(1))})
    g = g.withColumn("confidence", _unit(0.35 * F.greatest(F.lit(0.0), F.col("local")) + 0.25 * F.col("authority") + 0.25 * F.col("fit") + 0.15 * _unit(F.col("gap") + 0.25) - 0.30 * F.col("penalty")))
    has = lambda c: F.size(c) > 0
    some = lambda c: has(c).cast("double")
    sure, verbal, leads = F.col("confidence"), F.col("verbness") >= F.col("nounness"), F.get("h", F.lit(0))["role"] == "operator"
    with_parts = 0.30 * sure + 0.15 * some("modifiers") + 0.10 * some("operators")
    told = (
        ("nominal_head_with_modification", has("heads") & ~verbal, 0.45 * F.col("nounness") + with_parts),
        ("predicate_head_with_modification", has("heads") & verbal, 0.45 * F.col("verbness") + with_parts),
        ("relational_operator", has("operators") | leads, 0.30 * F.col("modifier") + 0.25 * sure + F.when(leads | ~has("heads"), 0.25).otherwise(0.05)),
        ("modifier_operator", has("modifiers"), 0.55 * F.col("modifier") + 0.25 * sure + 0.10),
    )
    none = F.lit(True)
    for _, hit, _ in told:
        none = none & ~hit
    told = (*told, ("mixed_or_uncertain", (F.col("gap") < 0.16) | none, 0.65 - F.col("gap") + 0.20 * (1 - sure)))
    best = F.array_sort(F.array_compact(F.array(*[F.when(hit, F.struct((-_unit(x)).alias("less"), F.lit(k).alias("k"), F.lit(name).alias("label"))) for k, (name, hit, x) in enumerate(told)])))
    g = g.withColumn("best", F.get(best, F.lit(0)))
    raw = clamp((F.col("local") - 0.5) * 1.10 + (F.col("fit") - 0.5) * 0.60 + (sure - 0.5) * 0.60 - F.col("penalty") * 0.35, -1.0, 1.0)
    return g.select(word, F.col("best.label").alias("inferred"), F.round(-F.col("best.less"), 4).alias("score"), F.round("confidence", 4).alias("confidence"), F.round(raw, 4).alias("raw"), "heads", "operators", "modifiers", "uncertain")
