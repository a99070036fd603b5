"""Line dedup by content-defined chunks of lines.

A line's hash is taken from its digest; a rolling hash over the hashes of two neighbouring lines
chooses where chunks end (with two lines in the window, rolling is to drop the line before the last one: h * 257 + the next line's hash), so a chunk's limits depend on
what stands around them and not on where they stand, and lines that are put in or taken out move only the limits next to them. Of a chunk of two or more
lines that occurs again, the copy in the least doc_id stays (within a document, the first one). A chunk goes only
after its bytes have been compared: chunks meet by digest and by text, and a digest that two different texts share
removes nothing.

``clean`` removes such chunks first (``cut_chunks``) and then goes on to single lines, which chunks with limits of chance leave: it removes every line that stands in a run of
whole lines, of ``min_chars`` characters or more in all, which an earlier document holds in the same order (or the same
document, earlier and not overlapping). To find them all, the units compared are, for each line, the shortest run of
that size that starts with it and the shortest that ends with it; a line that is long enough is such a run by itself.
Runs inside one chunk that has gone aren't compared any more: what the chunk repeats is there, in the copy that stays, for all other places.

Units are numbered within their document. Which of them the document has had before comes from sorting its digests, and what goes is taken
off the numbers by hashing, so a document of a million lines costs what its length asks for.

Defined results: a null text stays null; an empty one has one empty line; a very long text, or one of very many lines, is cut in whole; rows that share a doc_id are
judged alike, each with its own lines; a row without doc_id keeps what other rows repeat; of equal documents the least doc_id keeps its lines; chunks of less than ``min_chars``
characters and single lines stay in ``report``, runs of less than that in ``clean``; further columns are kept whatever their names are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A chunk ends after a line with the chance of 1 to DIVISOR.
DIVISOR = 3
MIN_CHARS = 32


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chunks(lines: str, divisor: int, min_chars: int) -> str:
    """array<struct<s, n, t, h>>: first line, number of lines, text and digest of each chunk; no digest for one that always stays."""
    hashes = "transform(ls, l -> cast(conv(substring(md5(l), 1, 7), 16, 10) as bigint))"
    ends = f"filter(sequence(1, size(lh)), i -> i = size(lh) or (i > 1 and pmod(pmod(element_at(lh, i - 1) * 257 + element_at(lh, i), 1000003), {divisor}) = 0))"
    cut = "transform(ends, (x, k) -> named_struct('s', if(k = 0, 0, element_at(ends, k)) + 1, 'n', x - if(k = 0, 0, element_at(ends, k)), 't', array_join(slice(ls, if(k = 0, 0, element_at(ends, k)) + 1, x - if(k = 0, 0, element_at(ends, k))), '\\n')))"
    digests = f"transform({cut}, c -> named_struct('s', c.s, 'n', c.n, 't', c.t, 'h', if(c.n > 1 and char_length(c.t) >= {min_chars}, md5(c.t), null)))"
    return f"if({lines} is null, null, {_let(lines, 'ls', _let(hashes, 'lh', _let(ends, 'ends', digests)))})"


def _runs(lines: str, min_chars: int, within: str) -> str:
    """array<struct<s, n, t, h>>: first line, number of lines, text and digest of each run, in order, but of those inside one chunk that has gone."""
    m = min_chars
    # no run has more than m + 1 lines, as each adds a line break at least
    least = lambda part, s: f"aggregate({part}, named_struct('n', 0, 'c', -1), (a, x) -> if(a.c >= {m}, a, named_struct('n', a.n + 1, 'c', a.c + 1 + char_length(x))), a -> if(a.c >= {m}, ({s}) * 1024L + a.n, null))"
    after = f"transform(ls, (l, i) -> if(char_length(l) >= {m}, (i + 1) * 1024L + 1, {least(f'slice(ls, i + 1, {m} + 1)', 'i + 1')}))"
    before = f"transform(ls, (l, i) -> if(char_length(l) >= {m}, null, {least(f'reverse(slice(ls, greatest(1, i + 1 - {m}), least(i + 1, {m} + 1)))', 'i + 2 - a.n')}))"
    text = "transform(sort_array(array_distinct(filter(concat({0}, {1}), w -> w is not null and not coalesce({2}[int(w div 1024) - 1] >= 0 and {2}[int(w div 1024) - 1] = {2}[int(w div 1024 + w % 1024) - 2], false)))), w -> named_struct('s', int(w div 1024), 'n', int(w % 1024), 't', array_join(slice(ls, int(w div 1024), int(w % 1024)), '\\n')))".format(after, before, within)
    digests = f"transform({text}, c -> named_struct('s', c.s, 'n', c.n, 't', c.t, 'h', md5(c.t)))"
    return f"if({lines} is null, null, {_let(lines, 'ls', digests)})"


def _had(units: str, apart: bool) -> str:
    """The numbers (from 0) of the units that stand in the document earlier; ``apart``: and don't overlap the first place."""
    # by digest, then text, then place: equal units stand together, the first place first
    places = "array_sort(filter(transform(us, (c, k) -> named_struct('h', c.h, 't', c.t, 'k', k, 's', c.s, 'n', c.n)), x -> x.h is not null))"
    if not apart:
        return _let(units, "us", _let(places, "ps", "transform(filter(ps, (x, i) -> i > 0 and ps[i - 1].h = x.h and ps[i - 1].t = x.t), x -> x.k)"))
    # the number, among the sorted, of the first of each unit's equals: the greatest of the numbers at which a new unit begins
    first = "aggregate(sequence(0, int(ceil(log2(size(ps) + 1)))), transform(ps, (x, i) -> if(i > 0 and ps[i - 1].h = x.h and ps[i - 1].t = x.t, -1, i)), (z, h) -> transform(z, (x, i) -> if(i >= shiftleft(1, h), greatest(x, z[i - shiftleft(1, h)]), x)))"
    return _let(units, "us", _let(places, "ps", _let(first, "fs", "transform(filter(transform(ps, (x, i) -> named_struct('k', x.k, 's', x.s, 'f', fs[i])), x -> x.s >= ps[x.f].s + ps[x.f].n), x -> x.k)")))


def _fixed(rows: DataFrame, name: str, value) -> DataFrame:
    """``rows`` with a column that is worked out once: a generator's output, which the optimizer doesn't copy into filters or lambdas above it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _numbered(docs: DataFrame, units: str, apart: bool) -> DataFrame:
    """``docs`` with ``__sx_units`` and ``__sx_had``, the numbers of those that the document has had before."""
    out = _fixed(docs.withColumn("__sx_lines", F.split("text", "\n", -1)), "__sx_units", F.expr(units))
    return _fixed(out, "__sx_had", F.expr(_had("__sx_units", apart)))


def _mark(docs: DataFrame) -> DataFrame:
    """``docs`` with a hash of the text, which tells rows of one doc_id apart."""
    return docs.withColumn("__sx_mark", F.xxhash64("text"))


def _new(units: DataFrame) -> DataFrame:
    """doc_id, __sx_mark, k, h, t: the units that their document hasn't had before, a row each."""
    fresh = "if(size(__sx_units) > 0, transform(filter(transform(array_except(sequence(0, size(__sx_units) - 1), __sx_had), k -> named_struct('k', k, 'c', __sx_units[k])), x -> x.c.h is not null), x -> named_struct('k', x.k, 'h', x.c.h, 't', x.c.t)), null)"
    return units.where("doc_id is not null").select("doc_id", "__sx_mark", F.explode(F.expr(fresh)).alias("x")).select("doc_id", "__sx_mark", "x.k", "x.h", "x.t")


def repeated(units: DataFrame) -> DataFrame:
    """__sx_h, __sx_keep: digests of units that several documents have, and the least doc_id among them."""
    same = _new(units).groupBy(F.col("h").alias("__sx_h"), "t").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return same.groupBy("__sx_h").agg(F.count(F.lit(1)).alias("texts"), F.min("low").alias("__sx_keep"), F.max("high").alias("high")).where("texts = 1 and high > __sx_keep").select("__sx_h", "__sx_keep")


def _judged(docs: DataFrame, units: str, apart: bool, tag: str, also: tuple[str, ...] = (), spent: bool = False) -> DataFrame:
    """``docs`` with its units, which stand on the text and the columns ``also``, and, in ``__sx_stay``, the numbers of those that stay."""
    small = _numbered(_mark(docs.select("doc_id", "text", *also)), units, apart)
    again = stored(repeated(small), tag, spent=spent)
    gone = _new(small).select("doc_id", "__sx_mark", "k", F.col("h").alias("__sx_h")).join(again, "__sx_h").where("doc_id > __sx_keep")
    # rows that share doc_id and text have the same numbers
    gone = gone.groupBy(F.col("doc_id").alias("__sx_id"), F.col("__sx_mark").alias("__sx_of")).agg(F.collect_set("k").alias("__sx_drop"))
    both = _numbered(_mark(docs).join(gone, (F.col("doc_id") == F.col("__sx_id")) & (F.col("__sx_mark") == F.col("__sx_of")), "left"), units, apart)
    stay = "if(size(__sx_units) > 0, array_except(array_except(sequence(0, size(__sx_units) - 1), __sx_had), coalesce(__sx_drop, cast(array() as array<int>))), cast(array() as array<int>))"
    return _fixed(both, "__sx_stay", F.expr(stay)).drop("__sx_id", "__sx_of", "__sx_mark")


def dedup_chunks(docs: DataFrame, divisor: int = DIVISOR, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``__sx_text`` (what stays), ``__sx_count`` and ``__sx_gone`` (numbers of lines, before and removed)."""
    both = _judged(docs, _chunks("__sx_lines", divisor, min_chars), False, "chunks")
    stays = "transform(__sx_stay, k -> __sx_units[k])"
    total = lambda a: f"coalesce(aggregate({a}, 0L, (s, c) -> s + c.n), 0L)"
    return (
        both.withColumn("__sx_text", F.expr(f"if(text is null, null, array_join(transform({stays}, c -> c.t), '\\n'))"))
        .withColumn("__sx_count", F.expr(total("__sx_units")))
        .withColumn("__sx_gone", F.expr(f"{total('__sx_units')} - {total(stays)}"))
        .drop("__sx_units", "__sx_had", "__sx_drop", "__sx_stay", "__sx_lines")
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of what stays, for every row of ``docs``."""
    return dedup_chunks(docs.select("doc_id", "text")).select("doc_id", F.col("__sx_count").alias("n_lines"), F.col("__sx_gone").alias("n_removed"), F.sha2("__sx_text", 256).alias("clean_sha256"))


def cut_chunks(docs: DataFrame, divisor: int = DIVISOR, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``__sx_cut``: for each line the number of the chunk with which it goes, or -1; null if no chunk goes."""
    both = _judged(docs, _chunks("__sx_lines", divisor, min_chars), False, "chunks", spent=True)
    gone = "array_except(sequence(0, size(__sx_units) - 1), __sx_stay)"
    all_ = f"array_sort(concat(transform(__sx_stay, k -> named_struct('k', k, 'c', -1)), transform({gone}, k -> named_struct('k', k, 'c', k))))"
    cut = f"if(size(__sx_units) > size(__sx_stay), flatten(transform({all_}, x -> array_repeat(x.c, __sx_units[x.k].n))), null)"
    return both.select(*docs.columns, F.expr(cut).alias("__sx_cut"))


def dedup_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``__sx_text``: what stays without the lines of repeated chunks and then of repeated runs."""
    if not 0 < min_chars < 1023:
        raise ValueError("min_chars must be from 1 to 1022")
    docs = stored(cut_chunks(docs, DIVISOR, min_chars), "cut", spent=True)
    both = _judged(docs, _runs("__sx_lines", min_chars, "__sx_cut"), True, "runs", also=("__sx_cut",), spent=True)
    # the lines of every run that doesn't stay
    out = "flatten(transform(array_except(sequence(0, greatest(size(__sx_units) - 1, 0)), __sx_stay), k -> if(k < size(__sx_units), sequence(__sx_units[k].s, __sx_units[k].s + __sx_units[k].n - 1), cast(array() as array<int>))))"
    chunks = "coalesce(filter(transform(__sx_cut, (c, i) -> if(c >= 0, i + 1, null)), i -> i is not null), cast(array() as array<int>))"
    stays = f"transform(array_except(sequence(1, size(__sx_lines)), concat({out}, {chunks})), i -> __sx_lines[i - 1])"
    return _fixed(both, "__sx_text", F.expr(f"if(text is null, null, array_join({stays}, '\\n'))")).drop("__sx_units", "__sx_had", "__sx_drop", "__sx_stay", "__sx_lines", "__sx_cut")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines of repeated chunks and runs taken out of ``text``; ``n_chars``, if there, follows it."""
    out = dedup_runs(docs)
    new = {"text": F.col("__sx_text")} | ({"n_chars": F.char_length("__sx_text").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
