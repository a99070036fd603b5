"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are runs of 20 or more of ``A-Za-z0-9+/_=-`` with two digits and a letter at least; runs of letters alone are words. Each
belongs to a character class: ``hexadecimal`` if it is made of hexadecimal digits, ``single`` if of digits and letters of one case (base32
among them), else ``base64``. A window of 20 characters slides over it. The counts of its characters are carried along, as a string with a
character for each of the alphabet's: the one that enters adds 1 to its count, the one that leaves takes 1 off, and
the sum of c * log2(c) over the counts c changes by these two terms; the entropy is log2(20) - sum / 20. The span from the first to
the last window that reaches its class's threshold is reported. Thresholds lie where 3 to 5 of 100 random windows of the class's
alphabet stay below. The allow-list of placeholders suppresses what it matches and no more: the text there is blank to the
candidates, so that what stands beside a placeholder in the same run is still judged.

Positions come from built-in functions alone: ``split`` and ``regexp_extract_all`` cut a text at the same
places, and the lengths of the pieces are summed up to the offsets in log2(n) rounds over their array.

Defined results: a null text is an empty one, which has no span; a very long text, or one of very many matches, is scanned whole, in time that grows
with its length (and n * log(n) of its matches); repeated rows, and rows that share a doc_id or have none, are scanned one by one;
spans of one kind never overlap, those of different kinds may, and those that start together are listed in the order of the kinds; further
columns are ignored; an empty table gives no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "entropy")
_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
PATTERNS = {
    "assign": rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
    "entropy": r"[A-Za-z0-9+/_=-]{20,}",
}
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character at which a window counts as random, by class; a window of 20 has log2(20) = 4.32 at most.
THRESHOLDS = {"hexadecimal": 3.0, "single": 3.4, "base64": 3.75}
CLASSES = {"hexadecimal": "^[0-9A-Fa-f]+$", "single": "^([0-9a-z]+|[0-9A-Z]+)$"}
#: Placeholders, in any case.
ALLOWED = ("example", "placeholder", "changeme", "xxxxxxxx", "00000000", "12345678", "abcdefgh")


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _spans(kind: str, text: str = "text") -> str:
    """array<struct<s, e, m, g>> of all matches: start, end, the match, and its length that counts."""
    r = _sql(PATTERNS[kind])
    whole = f"regexp_extract_all({text}, {r}, 0)"
    counts = f"transform(regexp_extract_all({text}, {r}, 2), x -> char_length(x))" if kind == "assign" else "transform(m, x -> char_length(x))"
    lengths = "transform(m, (x, i) -> char_length(p[i]) + char_length(x))"
    ends = f"aggregate(sequence(0, int(ceil(log2(size(m))))), {lengths}, (z, h) -> transform(z, (x, i) -> if(i >= shiftleft(1, h), x + z[i - shiftleft(1, h)], x)))"
    spans = "transform(m, (x, i) -> named_struct('s', e[i] - char_length(x), 'e', e[i], 'm', x, 'g', g[i]))"
    found = _let(whole, "m", _let(f"split({text}, {r})", "p", _let(ends, "e", _let(counts, "g", spans))))
    # texts without a match are not cut
    return f"if({text} rlike {r}, {found}, cast(array() as array<struct<s:int,e:int,m:string,g:int>>))"


def _masked() -> str:
    """The text with placeholders made blank, its length kept."""
    out = "text"
    for x in ALLOWED:
        out = f"regexp_replace({out}, '(?i){x}', '{' ' * len(x)}')"
    return f"if(text rlike '(?i){'|'.join(ALLOWED)}', {out}, text)"


def _entropy(name: str) -> str:
    """Of the candidates, [s, e) from the first to the last window at the threshold, or none."""
    w, null = WINDOW, "cast(null as int)"
    low = "case " + " ".join(f"when c.m rlike '{r}' then {THRESHOLDS[k]}D" for k, r in CLASSES.items()) + f" else {THRESHOLDS['base64']}D end"

    def moved(state: str, ch: str, by: int, tag: str) -> str:
        """The state's counts and sum when a character enters (1) or leaves (-1)."""
        changed = f"named_struct('k', overlay({state}.k, char(n{tag} + 65 + {by}), j{tag}, 1), 'sum', {state}.sum - clog[n{tag}] + clog[n{tag} + {by}])"
        return _let(f"instr('{ALPHABET}', {ch})", f"j{tag}", _let(f"ascii(substring({state}.k, j{tag}, 1)) - 65", f"n{tag}", changed))

    high = f"i >= {w} - 1 and log2({w}D) - y.sum / {w} >= low - 1e-9"
    out = f"named_struct('k', y.k, 'sum', y.sum, 'from', coalesce(a.from, if({high}, i - {w} + 1, {null})), 'to', if({high}, i - {w} + 1, a.to))"
    step = _let(moved("a", "ch[i]", 1, "1"), "x", _let(f"if(i >= {w}, {moved('x', f'ch[i - {w}]', -1, '2')}, x)", "y", out))
    start = f"named_struct('k', repeat('A', {len(ALPHABET)}), 'sum', 0D, 'from', {null}, 'to', {null})"
    slide = f"aggregate(sequence(0, size(ch) - 1), {start}, (a, i) -> {step})"
    found = f"transform({name}, c -> named_struct('s', c.s, 'r', {_let(low, 'low', _let("split(c.m, '')", 'ch', slide))}))"
    return f"transform(filter({found}, c -> c.r.from is not null), c -> named_struct('s', c.s + c.r.from, 'e', c.s + c.r.to + {w}))"


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and found: array<struct<s, k, kind, e>> of every span, by start, then kind as listed."""
    out = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = out.select("doc_id", "text", F.expr(_masked()).alias("masked"))
    out = out.select("doc_id", *[F.expr(_spans(k, "masked" if k == "entropy" else "text")).alias(k) for k in KINDS])
    least = {"assign": "x.g >= 12", "access": "x.g >= 18", "hex": "true", "entropy": "x.m rlike '[0-9].*[0-9]' and x.m rlike '[A-Za-z]'"}
    out = out.select("doc_id", F.expr(f"transform(sequence(0, {WINDOW} + 1), c -> if(c < 2, 0D, c * log2(c)))").alias("clog"), *[F.expr(f"filter({k}, x -> {least[k]})").alias(k) for k in KINDS])
    out = out.withColumn("entropy", F.expr(f"if(size(entropy) = 0, cast(array() as array<struct<s:int,e:int>>), {_entropy('entropy')})"))
    parts = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {n}, 'kind', '{k}', 'e', x.e))" for n, k in enumerate(KINDS))
    return out.select("doc_id", F.expr(f"array_sort(concat({parts}))").alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs``."""
    show = lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    return find_spans(docs).select(
        "doc_id",
        *[F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(F.filter("found", lambda x: x["k"] < 3), show), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", show), ",").alias("spans"),
    )
