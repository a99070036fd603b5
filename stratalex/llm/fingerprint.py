"""Document fingerprints from prefix polynomial hashes.

With code points c_i, the prefix array of a text is P[k] = sum(c_i * B^i for i < k) mod p, for two
31-bit primes. The span [i, j) has the value P[j] - P[i], which is its own polynomial times B^i, so two
spans are compared in O(1) after both are brought to the same power; the longest common extension of
two positions is found by binary search over span equality.

A document's fingerprint is a bounded excerpt of its prefix array: its length, its whole hash, the
hashes of its prefixes and suffixes at every multiple of a stride, a power of two of 1/16 to 1/32 of the
length, and the prefix hashes at up to ``MARKS`` places that the text itself chooses: where the value of the span of ``WINDOW`` characters that
begins there, mixed, has as many trailing zeros as the stride has. Such marks stand at the same words in two texts wherever these are, and those of a
longer text are among those of a shorter one. So fingerprints answer span equality between any two of their marks, and the longest common
extension of two marks is found by binary search over it. The likeness of two fingerprints is the share of the
longer text that is covered by their longest common prefix and suffix (binary search over the multiples of the larger stride) and by common extensions of
marks, in order: a few characters changed, put in or taken out cost what lies between the marks around them. It is 1 for equal fingerprints alone, and symmetric.

Documents are taken in the order of doc_id (null first), then of a hash of the text, then of the text. They are dealt into ranges of about ``RANGE_BYTES`` by this
order, whatever their number or lengths, so no window holds more than one range; each range also gets the first row of the next.

Defined results: a null text is an empty one; two empty texts are alike (1); a very long text is one row with a fingerprint like any other; rows with one doc_id follow each other
in the order above, and rows that agree in doc_id and text are interchangeable; a single row's next
document is itself; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

P1, P2, BASE = 2147483647, 2147483629, (911382323, 972663749)
_INVERSE = tuple(pow(b, -1, p) for b, p in zip(BASE, (P1, P2)))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_inverses = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text that a range of documents is meant to have; ranges are worked on one by one.
RANGE_BYTES = 8 << 20
#: Characters of a mark's window, and marks of a fingerprint.
WINDOW, MARKS = 12, 64
_MARK = np.dtype([("at", "<u4"), ("p1", "<u4"), ("p2", "<u4"), ("zeros", "u1")])


def _power(which: int, n: int, powers: list = _powers, bases: tuple = BASE) -> np.ndarray:
    """B^0 .. B^(n-1) at least, by doubling; kept for the next text of the worker."""
    p, b = (P1, P2)[which], bases[which]
    while len(powers[which]) < n:
        x = powers[which]
        powers[which] = np.concatenate([x, x * np.uint64(pow(b, len(x), p)) % np.uint64(p)])
    return powers[which]


def _inverse(which: int, i: np.ndarray) -> np.ndarray:
    """B^-i for an array of places."""
    return _power(which, int(i.max(initial=0)) + 1, _inverses, _INVERSE)[i]


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(c)
        self.at = []
        for k, p in enumerate((P1, P2)):
            # sums of fewer than 2^33 values below 2^31 stay below 2^64
            self.at.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * _power(k, self.n)[: self.n] % np.uint64(p)) % np.uint64(p)]))

    def spans(self, i, j) -> np.ndarray:
        """62-bit values of the spans [i, j) as if they stood at 0; i and j may be arrays."""
        i, j = np.atleast_1d(i), np.atleast_1d(j)
        out = []
        for k, p in enumerate((P1, P2)):
            d = (self.at[k][j] + np.uint64(p) - self.at[k][i]) % np.uint64(p)
            out.append(d * _inverse(k, i) % np.uint64(p))
        return (out[0] << np.uint64(31)) | out[1]

    def equal(self, i: int, other: Prefixes, j: int, length: int) -> bool:
        """Whether self[i : i + length] and other[j : j + length] are equal; all answers in O(1)."""
        if i + length > self.n or j + length > other.n:
            return False
        return bool(self.spans(i, i + length)[0] == other.spans(j, j + length)[0])

    def common(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension of self[i:] and other[j:]."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low


def stride(n: int) -> int:
    return 1 << max(0, (n // 16).bit_length() - 1)


def _marks(t: Prefixes) -> tuple[int, np.ndarray]:
    """The level, and the marks, which have so many trailing zeros at least."""
    level = stride(t.n).bit_length() - 1
    at = np.arange(max(0, t.n - WINDOW + 1))
    with np.errstate(over="ignore"):
        h = t.spans(at, at + WINDOW) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    at = np.flatnonzero((h & np.uint64((1 << level) - 1)) == 0)
    at = np.sort(at[np.unique(h[at], return_index=True)[1]])  # the first place of each span
    while len(at) > MARKS:
        level += 1
        at = at[(h[at] & np.uint64((1 << level) - 1)) == 0]
    out = np.zeros(len(at), _MARK)
    low = h[at] & (~h[at] + np.uint64(1))
    out["at"], out["p1"], out["p2"], out["zeros"] = at, t.at[0][at], t.at[1][at], np.where(low > 0, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)), 63)
    return level, out


def fingerprint(text: str, own: Prefixes | None = None) -> bytes:
    """8 bytes length, 8 bytes whole hash, 1 byte level, 4 bytes for each prefix and for each suffix, then the marks."""
    t = own or Prefixes(text)
    at = np.arange(stride(t.n), t.n, stride(t.n))
    prefix = (t.at[0][at] ^ (t.at[1][at] << np.uint64(1))).astype("<u4")
    # a suffix's value is taken backwards from the end, so equal suffixes of texts of any length agree
    back = Prefixes(text[::-1])
    suffix = (back.at[0][at] ^ (back.at[1][at] << np.uint64(1))).astype("<u4")
    whole = int(t.at[0][-1]) << 31 | int(t.at[1][-1])
    level, marks = _marks(t)
    return t.n.to_bytes(8, "little") + whole.to_bytes(8, "little") + bytes([level]) + prefix.tobytes() + suffix.tobytes() + marks.tobytes()


class Print:
    """A fingerprint as read."""

    def __init__(self, raw: bytes):
        self.n, whole, self.level = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little"), raw[16]
        self.stride = stride(self.n)
        k = max(0, self.n - 1) // self.stride
        grid = np.frombuffer(raw, "<u4", 2 * k, 17)
        self.prefix, self.suffix = grid[:k], grid[k:]
        self.marks = np.frombuffer(raw, _MARK, offset=17 + 8 * k)
        self.end = (self.n, whole >> 31, whole & (1 << 31) - 1)

    def anchors(self, level: int) -> list[tuple[int, int, int]]:
        """Places and prefix hashes of the start, the marks of the level, and the end."""
        found = self.marks[self.marks["zeros"] >= level]
        return [(0, 0, 0), *((x, y, z) for x, y, z, _ in found.tolist() if x), self.end]


def _span(x: tuple, y: tuple) -> tuple[int, int, int]:
    """Length and values of the span between two anchors, as if it stood at 0."""
    return y[0] - x[0], (y[1] - x[1]) * pow(_INVERSE[0], x[0], P1) % P1, (y[2] - x[2]) * pow(_INVERSE[1], x[0], P2) % P2


def _extensions(a: list, b: list) -> list[tuple[int, int]]:
    """Spans of a that are common extensions of its anchors and those of b, in the order of both."""
    where: dict[tuple, list[int]] = {}
    for j in range(len(b) - 1):
        where.setdefault(_span(b[j], b[j + 1]), []).append(j)
    out, i, least = [], 0, 0
    while i < len(a) - 1:
        j = next((j for j in where.get(_span(a[i], a[i + 1]), ()) if j >= least), None)
        if j is None:
            i += 1
            continue
        low, high = 1, min(len(a) - 1 - i, len(b) - 1 - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if _span(a[i], a[i + mid]) == _span(b[j], b[j + mid]) else (low, mid - 1)
        out.append((a[i][0], a[i + low][0]))
        i, least = i + low, j + low
    return out


def _common(a: np.ndarray, b: np.ndarray, sa: int, sb: int) -> int:
    """The last mark up to which both agree, by binary search."""
    s = max(sa, sb)
    a, b = a[s // sa - 1 :: s // sa], b[s // sb - 1 :: s // sb]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid - 1] == b[mid - 1] else (low, mid - 1)
    return low * s


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    x, y = Print(min(a, b)), Print(max(a, b))
    if not x.n or not y.n:
        return 0.0
    most = max(x.n, y.n)
    head, tail = _common(x.prefix, y.prefix, x.stride, y.stride), _common(x.suffix, y.suffix, x.stride, y.stride)
    level = max(x.level, y.level)
    covered = at = 0
    for s, e in sorted([(0, head), (x.n - tail, x.n), *_extensions(x.anchors(level), y.anchors(level))]):
        covered += max(0, e - max(s, at))
        at = max(at, e)
    return min(covered, x.n, y.n, most - 1) / most


def _key(doc_id: int | None, mark: int) -> int:
    """A place in the order of documents, as far as doc_id and the text's hash tell."""
    return (0 if doc_id is None else doc_id + 2**63 + 1) << 64 | (mark + 2**63)


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def cuts(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> list[int]:
    """The keys at which ranges of about ``range_bytes`` of text begin, the least one first: 32 bytes a range."""
    rows = _marked(docs).select("doc_id", "mark", (F.octet_length("text") + 64).alias("n"))
    rows = stored(rows.repartitionByRange("doc_id", "mark").withColumn("part", F.spark_partition_id()), "keys", narrow=True)
    before = F.sum("n").over(Window.partitionBy("part").orderBy("doc_id", "mark")) - F.col("n")
    found = rows.withColumn("nth", F.floor(before / range_bytes)).groupBy("part", "nth").agg(F.min(F.struct("doc_id", "mark")).alias("x"))
    return sorted({_key(r["x"]["doc_id"], r["x"]["mark"]) for r in found.collect()})


def with_fingerprints(docs: DataFrame, begins: list[int] | None = None) -> DataFrame:
    """doc_id, mark, text, fingerprint (binary), bucket and guest for every row of ``docs``.

    With ``begins``, a bucket is the range that a row falls in. The first row of a range is also
    sent, as a guest (1), to the range before it; that of the first range, as a guest (2), to the last.
    """
    begins = begins or []
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "mark", "text", "fingerprint", "bucket", "guest"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32()]
        sent = set()
        for b in batches:
            rows = []
            for i, m, t in zip(*(c.to_pylist() for c in b.columns)):
                key, f = _key(i, m), fingerprint(t)
                k = max(0, bisect_right(begins, key) - 1)
                rows.append((i, m, t, f, k, 0))
                if begins and key == begins[k] and k not in sent:  # rows of one key are alike
                    sent.add(k)
                    rows.append((i, m, t, f, k - 1 if k else len(begins) - 1, 1 if k else 2))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)

    return _marked(docs).mapInArrow(run, "doc_id long, mark long, text string, fingerprint binary, bucket int, guest int")


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, fingerprint, next_head, next_fingerprint: the document that comes next.

    next_head has as many code points as a quarter of the own text, or all. The text moves once.
    """
    rows = with_fingerprints(docs, cuts(docs, range_bytes))
    w = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "mark", "text")
    need = F.floor(F.char_length("text") / 4).cast("int")
    own = F.coalesce(F.lead("text").over(w), F.col("text")), F.coalesce(F.lead("fingerprint").over(w), F.col("fingerprint"))
    return rows.select("doc_id", "text", "fingerprint", "guest", own[0].alias("next_text"), own[1].alias("next_fingerprint")).where("guest = 0").select("doc_id", "text", "fingerprint", F.substring("next_text", F.lit(1), need).alias("next_head"), "next_fingerprint")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            n = len(r["text"])
            text = r["text"][: n - n // 4] + r["next_head"]
            edited = Prefixes(text)
            own, new = r["fingerprint"], fingerprint(text, edited)
            out.append((r["doc_id"], n, hashlib.sha256(text.encode()).hexdigest(), own.hex(), new.hex(), likeness(own, new), likeness(own, r["next_fingerprint"]), Prefixes(r["text"]).common(0, edited, 0)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out)) or [()] * 8, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited"])


def edited_likeness(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each text against itself with its last quarter replaced by the next document's beginning.

    common_edited is the exact length of the two texts' longest common extension from their starts.
    """
    return with_next(docs, range_bytes).mapInArrow(_edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long")
