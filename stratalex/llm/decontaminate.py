"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document and stored. A row of it is one shard: the terms of a bounded run of
documents and, for each term, the ascending list of the token positions at which it stands.
A phrase is searched shard by shard: the list of its rarest term there, shifted by the term's offset, gives the starts
that are possible, and each next list, from the rarest on, is shifted by its own offset and intersected with them by binary search, until
the starts of whole occurrences remain. Proximity goes the same way, with a range around each place instead of one
offset: from the list of the rarest term (of the whole index, so that shards don't matter), places stay around which every other
term stands within ``slop`` words in the same document.

The benchmark's windows are made by the executors and searched for in blocks of ``WINDOWS`` pairs of a window and its item, which is all that the
driver holds and sends at once; the ids of the items that have one window in common stay together.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. All separators are ASCII,
so texts are cut on their UTF-8 bytes.

Defined results: a null or empty text has no words, is hit nowhere and is never contaminated; a null
or wordless benchmark item has no window; an item without item_id hits words like any other, but there is no id to count or list; items
that share an id are one; repeated rows are judged one by one, ``clean`` too, which keeps rows without doc_id unless they are contaminated themselves; a very
long text is a shard of its own; terms equally rare are taken in the order of their bytes; further columns are
ignored whatever their names are; an empty table on either side gives no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

WINDOW = 13
#: A shard holds about so many bytes of text, or one longer document.
SHARD_BYTES = 1 << 20
#: Pairs of a window and an item that are searched for at once: what the driver holds and broadcasts is bounded by it.
WINDOWS = 100_000
#: Proximity: an item is near where so many of its rarest terms stand within SLOP words of the rarest.
NEAR_TERMS, SLOP = 4, 13
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "doc_ids array<long>, marks array<long>, doc_starts array<int>, n_words array<int>, terms array<binary>, list_starts array<int>, positions binary"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _shard(ids: list, marks: list, tokens: list[list[bytes]]) -> dict:
    """Documents stand one after another with a gap between them, which belongs to no term."""
    sizes = np.array([len(x) for x in tokens], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    flat = pa.array([w for x in tokens for w in x], type=pa.binary()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.arange(len(codes)) + np.repeat(np.arange(len(tokens)), sizes)
    order = np.argsort(codes, kind="stable")
    lists = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(flat.dictionary)))])
    return {"doc_ids": ids, "marks": marks, "doc_starts": starts.tolist(), "n_words": sizes.tolist(), "terms": flat.dictionary, "list_starts": lists.tolist(), "positions": at[order].astype("<i4").tobytes()}


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    marks: list = []
    tokens: list = []
    held = 0

    def cut() -> pa.RecordBatch:
        s = _shard(ids, marks, tokens)
        kinds = {"doc_ids": pa.int64(), "marks": pa.int64(), "doc_starts": pa.int32(), "n_words": pa.int32(), "list_starts": pa.int32()}
        cols = [pa.ListArray.from_arrays([0, len(s[k])], pa.array(s[k], kinds[k]) if k in kinds else s[k].cast(pa.binary())) if k != "positions" else pa.array([s[k]]) for k in s]
        return pa.RecordBatch.from_arrays(cols, names=list(s))

    for b in batches:
        for i, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
            raw = text.as_py() or b""
            if held and held + len(raw) > SHARD_BYTES:
                yield cut()
                ids, marks, tokens, held = [], [], [], 0
            ids.append(i)
            marks.append(mark)
            tokens.append(words(raw))
            held += len(raw) + 64
    if ids:
        yield cut()


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Positional inverted index of all words of ``docs``, one row for each shard, as a table of the shared folder."""
    small_batches(docs.sparkSession)
    shards = docs.select(F.col(doc_id).cast("long"), _mark(text), F.col(text)).mapInArrow(_shards, INDEX)
    return stored(shards.withColumn("shard", F.monotonically_increasing_id()), "postings", wide=True)  # written once, so the numbers stay


class Shard:
    """A shard as read: its terms' lists of positions, end to end."""

    def __init__(self, row: dict):
        self.ids, self.marks = row["doc_ids"], row["marks"]
        self.starts, self.sizes = np.asarray(row["doc_starts"], np.int64), np.asarray(row["n_words"], np.int64)
        self.code = {t: k for k, t in enumerate(row["terms"])}
        self.lists = np.asarray(row["list_starts"], np.int64)
        self.df = np.diff(self.lists)
        self.positions = np.frombuffer(row["positions"], "<i4").astype(np.int64)
        self.length = int(self.starts[-1] + self.sizes[-1] + 1) if len(self.starts) else 1
        # lists one above another: posting p of term t is the key t * length + p, so one sorted array holds all lists
        self.keys = np.repeat(np.arange(len(self.df)), self.df) * self.length + self.positions

    def local(self, vocabulary: list[bytes]) -> np.ndarray:
        """The shard's codes of a vocabulary, -2 for a term that it lacks; -1, padding, is the last."""
        return np.array([self.code.get(w, -2) for w in vocabulary] + [-1], np.int64)

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def _lists(self, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, posting) of the list of each row's term at ``first``."""
        rows = np.arange(len(terms))
        code = terms[rows, first]
        n = self.df[code]
        row = np.repeat(rows, n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return row, self.positions[np.repeat(self.lists[code], n) + within]

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of each exact occurrence; terms: a row of codes for each phrase, padded with -1."""
        which = np.flatnonzero(~(terms == -2).any(axis=1) & (terms >= 0).any(axis=1))
        if not len(which):
            return which, which
        terms = terms[which]
        length = np.where(terms >= 0, self.df[np.maximum(terms, 0)], np.iinfo(np.int64).max)
        rank = np.argsort(length, axis=1, kind="stable")  # the rarest term first
        phrase, posting = self._lists(terms, rank[:, 0])
        start = posting - rank[phrase, 0]
        phrase, start = phrase[start >= 0], start[start >= 0]
        for k in range(1, terms.shape[1]):
            if not len(phrase):
                break
            offset = rank[phrase, k]
            want = terms[phrase, offset]
            at = start + offset
            key = want * self.length + at
            found = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
            keep = (want < 0) | (found & (at < self.length))
            phrase, start = phrase[keep], start[keep]
        return which[phrase], start

    def near(self, terms: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the first term of each row wherever all its others stand within ``slop`` words in the same document."""
        which = np.flatnonzero(~(terms == -2).any(axis=1) & (terms[:, 0] >= 0))
        if not len(which):
            return which, which
        terms = terms[which]
        row, at = self._lists(terms, np.zeros(len(which), np.int64))
        for k in range(1, terms.shape[1]):
            doc = self.documents(at)
            low, high = np.maximum(at - slop, self.starts[doc]), np.minimum(at + slop, self.starts[doc] + self.sizes[doc] - 1)
            want = terms[row, k]
            found = np.searchsorted(self.keys, want * self.length + low) < np.searchsorted(self.keys, want * self.length + high, side="right")
            keep = (want < 0) | found
            row, at = row[keep], at[keep]
        return which[row], at


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                w = words(text.as_py() or b"")
                for k in range(max(1, len(w) - size + 1) if w else 0):
                    ids.append(i)
                    out.append(b" ".join(w[k : k + size]))
                    if len(out) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["item", "phrase"])
                        ids, out = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["item", "phrase"])

    return run


def phrase_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """item, phrase: each item's windows of ``size`` consecutive words, or all of a shorter item, blank-joined."""
    small_batches(benchmark.sparkSession)
    return benchmark.select(F.col(item_id).cast("long"), F.col(text)).mapInArrow(_windows(size), "item long, phrase binary")


def near_terms(index: DataFrame, benchmark: DataFrame, terms: int = NEAR_TERMS, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item, phrase: each item's ``terms`` words that have the shortest lists in the whole index, the rarest first; no row if one is nowhere."""
    lists = F.transform(F.slice("list_starts", 2, F.greatest(F.lit(1), F.size("list_starts") - 1)), lambda e, k: e - F.get("list_starts", k))
    own = stored(phrase_windows(benchmark, item_id, text, 1).where("item is not null").distinct().withColumnRenamed("phrase", "term"), "terms", narrow=True)
    postings = index.select(F.explode(F.arrays_zip(F.col("terms").alias("t"), lists.alias("n"))).alias("x")).select(F.col("x.t").alias("term"), "x.n")
    df = postings.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    known = own.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = known.withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy("df", "term"))).where(F.col("k") <= terms)
    rows = ranked.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("k", "term"))).alias("x"), F.min("df").alias("df")).where("df > 0")
    return rows.select("item", F.array_join(F.transform("x", lambda x: x["term"].cast("string")), " ").cast("binary").alias("phrase"))


def _union(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(start.tolist(), end.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _found(shard: Shard, block: tuple, slop: int | None) -> tuple[list, list]:
    """For each document of the shard the merged spans and the items of a block's phrases, or of its proximities."""
    vocabulary, terms, items_of = block
    local = shard.local(vocabulary)[terms]
    phrase, start = shard.phrases(local) if slop is None else shard.near(local, slop)
    sizes = (terms >= 0).sum(axis=1) if slop is None else np.ones(len(terms), np.int64)
    doc = shard.documents(start)
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(doc[order], np.arange(len(shard.ids) + 1))
    spans, items = [], []
    for d in range(len(shard.ids)):
        p = order[cuts[d] : cuts[d + 1]]
        s = start[p] - shard.starts[d]
        spans.append([{"s": x, "e": y} for x, y in _union(s, s + sizes[phrase[p]])] if len(p) else [])
        items.append(sorted({x for k in set(phrase[p].tolist()) for x in items_of[k]}) if len(p) else [])
    return spans, items


def _search(sent, slop: int):
    hit, ids = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, near = sent.value
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                shard = Shard(row)
                n = len(shard.ids)
                spans, items = _found(shard, exact, None)
                places, near_items = _found(shard, near, slop)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(shard.ids, pa.int64()), pa.array(shard.marks, pa.int64()), pa.array(shard.sizes, pa.int64()), pa.array(spans, hit), pa.array(items, ids), pa.array(places, hit), pa.array(near_items, ids)],
                    names=["shard", "place", "doc_id", "mark", "n_words", "spans", "items", "places", "near_items"],
                )

    return run


def _blocks(pairs: DataFrame | None, most: int) -> Iterator[tuple]:
    """(vocabulary, terms of each phrase, items of each phrase) of about ``most`` pairs (item, phrase) each; one block at least."""
    if pairs is not None:
        pairs = stored(pairs.distinct(), "phrases", narrow=True)
    n = max(1, -(-pairs.count() // most)) if pairs is not None else 1
    for k in range(n):
        by: dict[bytes, list] = {}
        for i, p in pairs.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k).collect() if pairs is not None else ():  # one block
            by.setdefault(bytes(p), []).extend([] if i is None else [i])
        phrases = [p.split(b" ") for p in by]
        vocabulary = sorted({w for p in phrases for w in p})
        code = {w: x for x, w in enumerate(vocabulary)}
        terms = np.full((len(phrases), max(map(len, phrases), default=1)), -1, np.int32)
        for x, p in enumerate(phrases):
            terms[x, : len(p)] = [code[w] for w in p]
        yield vocabulary, terms, list(by.values())


def search(index: DataFrame, exact: DataFrame | None = None, near: DataFrame | None = None, slop: int = SLOP, most: int = WINDOWS) -> DataFrame:
    """shard, place, doc_id, mark, n_words, spans, items, places, near_items: a row for each document of the index.

    ``exact`` and ``near`` are pairs (item, phrase). ``spans`` are the merged half-open word ranges that occurrences of the exact phrases
    cover, ``places`` those of the first terms of the near ones around which all the others stand; ``items`` and ``near_items`` the ids of
    the items that these belong to. A block of each is searched for in one pass over the index.
    """
    spark = index.sparkSession
    small_batches(spark)
    nothing, parts = next(_blocks(None, most)), []
    for pair in zip_longest(_blocks(exact, most), _blocks(near, most), fillvalue=nothing):
        sent = spark.sparkContext.broadcast(pair)
        parts.append(index.mapInArrow(_search(sent, slop), "shard long, place int, doc_id long, mark long, n_words long, spans array<struct<s:int,e:int>>, items array<long>, places array<struct<s:int,e:int>>, near_items array<long>"))
    found = parts[0]
    if len(parts) > 1:  # a document has a row for each block; its spans are merged again
        for p in parts[1:]:
            found = found.unionByName(p)
        both = lambda c: F.flatten(F.collect_list(c))
        found = found.groupBy("shard", "place").agg(
            *[F.first(c).alias(c) for c in ("doc_id", "mark", "n_words")], *[F.array_sort(both(c)).alias(c) for c in ("spans", "places")], *[F.array_distinct(both(c)).alias(c) for c in ("items", "near_items")]
        )
    return found


def proximity_matches(index: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """(doc_id, position) of the rarest term wherever all ``terms`` stand within ``slop`` words of it."""
    wanted = " ".join(w.decode() for t in terms for w in words(t.encode()))
    one = index.sparkSession.createDataFrame([(0, wanted)], "item_id long, text string")
    found = search(index, near=near_terms(index, one, len(wanted.split())), slop=min(slop, 2**30))
    return found.select("doc_id", F.explode("places").alias("x")).select("doc_id", F.explode(F.sequence(F.col("x.s").cast("long"), F.col("x.e").cast("long") - 1)).alias("position"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20, most: int = WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near for every row of ``docs``.

    A word inside any occurrence of a window is hit; contaminated: n_hit > 0 and share * n_hit >= n_words. n_near counts the items
    whose ``NEAR_TERMS`` rarest terms stand within ``SLOP`` words of the rarest somewhere in the document: texts that reword an item.
    """
    index = build_index(docs)
    found = search(index, phrase_windows(benchmark, size=size), near_terms(index, benchmark), SLOP, most)
    return judged(found, share).drop("mark")


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, mark, n_words, n_hit, n_items, items_sha256, n_near and contaminated from what ``search`` found."""
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).cast("long").alias("n"), F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["n"])
    out = found.select("doc_id", "mark", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"), F.size("near_items").cast("long").alias("n_near"))
    return out.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words"), share))


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    return (n_hit > 0) & (share * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    found = judged(search(build_index(docs), phrase_windows(benchmark)))
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("__sx_bad"), F.col("mark").alias("__sx_mark")).distinct(), "bad", narrow=True)
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("__sx_bad")) & (_mark("text") == F.col("__sx_mark")), "left_anti")
