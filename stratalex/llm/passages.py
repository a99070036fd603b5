"""Substring dedup by hashing lines and the sentences within them.

Units are lines, and the sentences of a line: passages are often pasted into the middle of a line, where
no whole line repeats but its sentences do. A unit is normalised (case folded, all but letters and digits
made one blank) and hashed to 128 bits. Digests are grouped globally, the occurrence with the least rank
(doc_id, then offset) stays, and every other one goes, its original offsets kept.

Units of fewer than ``MIN_WORDS`` words are too common to be copies. Short sentences and short lines are therefore units together with
their neighbours, across line ends: for each, the shortest run of sentences with ``MIN_WORDS`` words that starts with it and the shortest
that ends with it. So of a repeated passage of whole sentences with as many words, every sentence lies in a repeated unit. Where
a script sets no blanks between words, two characters count as a word.

What goes are stretches of repeated units, next to each other but for two characters at most, of ``MIN_CHARS`` characters or more: a common line or sentence that
stands alone among a document's own words is wording rather than a copied passage, and stays.

Defined results: a null or empty text has no unit; a very long text is cut in whole, in time that grows with its length; occurrences are ranked by doc_id, then (in rows that
share one) by a hash of the text, then by offset, so each row loses what it repeats itself and nothing of another row's; rows that agree in doc_id and text are one
document and lose the same; a row without doc_id is never removed from and keeps nothing from others; ties are decided by these ranks; removals that overlap or touch
are made one; further columns are ignored, and kept by ``cut``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches, split_join, stored

MIN_WORDS = 8
#: Characters of the shortest stretch of repeated units that is removed.
MIN_CHARS = 100
UNIT = re.compile(r"[^.!?。！？｡।]+[.!?。！？｡।]*")
#: Letters of scripts that set no blanks between words: Thai, Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WORD = re.compile(r"[^\W_]+")


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each line, of each sentence of several in a line, and of runs of short sentences.

    White space around a unit isn't part of it.
    """
    unspaced = _UNSPACED.search(text) is not None
    parts: list[tuple[int, int, str, int]] = []  # start, end, words and their number of each sentence that has a word
    seen = set()
    at = 0

    def unit(start: int, end: int, own: list) -> Iterator[tuple[int, int, bytes]]:
        if (start, end) not in seen:
            seen.add((start, end))
            yield start, end, hashlib.blake2b(" ".join(x[2] for x in own).encode(), digest_size=16).digest()

    for line in text.split("\n"):
        first = len(parts)
        for m in UNIT.finditer(line):
            s = m[0]
            if found := _WORD.findall(s):
                start = at + m.start() + len(s) - len(s.lstrip())
                parts.append((start, start + len(s.strip()), " ".join(found).lower(), _size(found) if unspaced else len(found)))
                if parts[-1][3] >= min_words:
                    yield from unit(*parts[-1][:2], parts[-1:])
        own = parts[first:]
        if sum(x[3] for x in own) >= min_words:
            start = at + len(line) - len(line.lstrip())
            yield from unit(start, start + len(line.strip()), own)
        at += len(line) + 1
    for k, x in enumerate(parts):
        if x[3] < min_words:
            n, j = x[3], k
            while n < min_words and j + 1 < len(parts):
                j += 1
                n += parts[j][3]
            if n >= min_words:
                yield from unit(x[0], parts[j][1], parts[k : j + 1])
            n, j = x[3], k
            while n < min_words and j > 0:
                j -= 1
                n += parts[j][3]
            if n >= min_words:
                yield from unit(parts[j][0], x[1], parts[j : k + 1])


def _size(found: list[str]) -> int:
    """Number of words, two characters of a script without blanks counted as one."""
    return sum(max(1, (len(_UNSPACED.findall(w)) + 1) // 2) for w in found)


def _rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                out: tuple[list, list, list, list] = [], [], [], []
                for i, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    for s, e, d in units(text.as_py() or "", min_words):
                        for column, x in zip(out, (i, mark, s << 32 | e, d)):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary())], names=["doc_id", "mark", "place", "digest"])

    return run


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text"))


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, mark (a hash of the text), place (start << 32 | end), digest of every unit."""
    small_batches(docs.sparkSession)
    return _marked(docs).where("doc_id is not null").mapInArrow(_rows(min_words), "doc_id long, mark long, place long, digest binary")


def repeated_places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """__sx_id, __sx_of, __sx_places: for each doc_id and hash of a text the sorted places of all units that an earlier one repeats."""
    every = stored(occurrences(docs, min_words), "units")
    # counts and sums keep the aggregate's buffer of fixed width, so it is combined by hashing before the shuffle
    low = stored(every.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1"), "digests")
    again = stored(split_join(every, low.drop("n"), "digest", counts=low), "copies")
    # in the document that keeps the unit, its first occurrence stays; one that overlaps it is part of what stays
    own = again.where("doc_id = first_doc").drop("first_doc")
    first = own.groupBy("digest").agg(F.min(F.struct("mark", "place")).alias("first"))
    end = F.col("first.place").bitwiseAND(F.lit(2**32 - 1))
    after = (F.col("mark") != F.col("first.mark")) | (F.shiftright("place", 32) >= end)
    same = own.join(first, "digest").where(after).select("doc_id", "mark", "place")
    later = again.where("doc_id > first_doc").select("doc_id", "mark", "place")
    return later.unionByName(same).groupBy(F.col("doc_id").alias("__sx_id"), F.col("mark").alias("__sx_of")).agg(F.sort_array(F.collect_set("place")).alias("__sx_places"))


def stretches(places: list[int], min_chars: int = MIN_CHARS) -> list[tuple[int, int]]:
    """Sorted spans of what goes: places with those that overlap or touch made one, in stretches of ``min_chars`` or more."""
    spans: list[list[int]] = []
    for x in places:
        start, end = x >> 32, x & (2**32 - 1)
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    out: list[tuple[int, int]] = []
    first = 0
    for k in range(len(spans)):
        if k + 1 == len(spans) or spans[k + 1][0] > spans[k][1] + 2:
            if spans[k][1] - spans[first][0] >= min_chars:
                out += [(s, e) for s, e in spans[first : k + 1]]
            first = k + 1
    return out


def _beside(docs: DataFrame, places: DataFrame) -> DataFrame:
    return docs.join(places, (docs["doc_id"].cast("long") == F.col("__sx_id")) & (F.xxhash64(docs["text"]) == F.col("__sx_of")), "left").drop("__sx_id", "__sx_of")


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_removed, chars_removed, spans (start:end, comma-joined) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [stretches(x or [], min_chars) for x in b.column(1).to_pylist()]
            text = [",".join(f"{s}:{e}" for s, e in x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([sum(e - s for s, e in x) for x in found], pa.int64()), pa.array(text, pa.string())], names=["doc_id", "n_removed", "chars_removed", "spans"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"))
    places = repeated_places(docs, min_words)
    both = ids.join(places, (F.col("doc_id") == F.col("__sx_id")) & (F.col("mark") == F.col("__sx_of")), "left")
    return both.select("doc_id", F.col("__sx_places").alias("places")).mapInArrow(run, "doc_id long, n_removed long, chars_removed long, spans string")


def cut(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the repeated stretches in ``text``; what stays keeps its order."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, x in zip(b.column("text").to_pylist(), b.column("__sx_places").to_pylist()):
                spans = stretches(x or [], min_chars)
                ends = [0, *(e for _, e in spans)]
                texts.append("".join(t[e:s] for e, s in zip(ends, [*(s for s, _ in spans), len(t)])) if spans else t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns], names=columns)

    return _beside(docs, repeated_places(docs, min_words)).mapInArrow(run, docs.schema)
