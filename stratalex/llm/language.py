"""Language identification by nearest centroids.

A text's vector are its letters' 1- to 3-grams (lower case, words set off by blanks), hashed into
``DIM`` places, as (1 + ln tf) * idf, brought to length 1. Each language's sampled vectors are clustered by
spherical k-means into several centroids; a text gets the language of the centroid of the greatest
cosine, which is its score.

A language rejects what is no nearer to it than noise. Cosines grow with a text's length, so the limit depends on it: ``foreign`` is
the greatest cosine that texts of letters drawn at random from scripts (``NOISE``), made up at each of ``SIZES``, have with the language;
``own`` is the cosine that all but ``LOW`` of the sampled texts of the length that are nearest to the language exceed, each measured against
centroids of the other half of the sample. The limit lies ``BETWEEN`` of the way from ``foreign`` to ``own``, and never above ``own``; between sizes it is interpolated.

Only fitting uses a sample (a documented bound, not a part of any result's rows): ``PER_LANGUAGE`` labelled rows of each language, those of the least hashes of doc_id, and
never more than ``MOST`` rows in all. Prediction reads whole texts and nothing but texts.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0 and rejected; with no labelled row every text
is; a very long text is counted whole; a row without doc_id is never learned from and counts as not held out; repeated rows, and rows that share a doc_id and a text, get equal
answers; languages of equal cosine are decided by name; further columns are ignored by ``predict`` and kept by ``clean``; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

DIM = 4096
CENTROIDS = 4
PER_LANGUAGE, MOST = 300, 6_000
#: Characters of a text that are hashed at once.
PIECE = 1 << 18
#: Where a limit lies between the cosine of noise and the low quantile of the language's own texts.
BETWEEN, LOW = 0.25, 0.01
#: Characters of each sampled text that say which letters shuffled text is made of.
HEAD = 100
#: Numbers of n-grams at which limits are set, and how many texts of noise of each kind are made for each.
SIZES, DRAWS = tuple(8 * 2**k for k in range(16)), 3
#: First and last code point of the letters that noise is made of; the learned texts' own letters are shuffled besides.
NOISE = {"latin": (0x61, 0x7A), "greek": (0x3B1, 0x3C9), "cyrillic": (0x430, 0x44F), "hebrew": (0x5D0, 0x5EA), "arabic": (0x627, 0x64A), "devanagari": (0x905, 0x939), "thai": (0xE01, 0xE2E), "han": (0x4E00, 0x5E00), "hangul": (0xAC00, 0xBC00)}
UNKNOWN = "und"
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x32000)), bool, 0x32000)
    return _tables["letters"]


def counts(text: str) -> np.ndarray | None:
    """Hashed counts of the letters' n-grams; None without a letter. Long texts are hashed piece by piece."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    known = _letters()
    ok = known[np.minimum(c, len(known) - 1)] & (c < len(known))
    if not ok.any():
        return None
    c = np.where(ok, c, np.uint32(32))
    c = np.concatenate([[np.uint32(32)], c[(c != 32) | np.concatenate([[True], c[:-1] != 32])], [np.uint32(32)]])
    k, out = np.uint64(0x9E3779B97F4A7C15), np.zeros(DIM, np.int64)
    for at in range(0, len(c), PIECE):
        piece = c[at : at + PIECE + 2].astype(np.uint64)  # the two characters more are the ends of the last 2- and 3-grams
        last = at + PIECE >= len(c)
        with np.errstate(over="ignore"):
            one = (piece + np.uint64(1)) * k
            two = (one[:-1] ^ piece[1:]) * k
            three = (two[:-1] ^ piece[2:]) * k
            if not last:
                one, two, three = one[:PIECE], two[:PIECE], three[:PIECE]
            grams = np.concatenate([one[piece[: len(one)] != 32], two ^ np.uint64(1 << 63), three])
            out += np.bincount(((grams ^ (grams >> np.uint64(29))) * k >> np.uint64(52)).astype(np.int64), minlength=DIM)
    return out


def vector(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * idf
    return x / max(np.sqrt(x @ x), 1e-12)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(lang, h, counts(t), t[:HEAD].lower()) for lang, h, t in zip(*(c.to_pylist() for c in b.columns))]
        found = [x for x in found if x[2] is not None]
        at = [np.flatnonzero(x[2]) for x in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64()), pa.array([x.astype("<i4").tobytes() for x in at], pa.binary()), pa.array([y[2][x].astype("<i4").tobytes() for y, x in zip(found, at)], pa.binary()), pa.array([x[3] for x in found], pa.string())], names=["lang", "h", "at", "n", "head"])


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from far-apart starts; fewer centroids if there are fewer rows."""
    mean = x.mean(axis=0)
    at = [int((x @ mean).argmax())]
    while len(at) < min(k, len(x)):
        at.append(int((x @ x[at].T).max(axis=1).argmin()))
    c = x[at]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        new = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return c


def _noise(letters: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of about ``size`` n-grams of words of letters drawn at random."""
    n = max(1, size // 3)
    c = rng.choice(letters, n)
    c[rng.random(n) < 0.15] = 32
    c[0] = letters[0]
    return counts(c.astype("<u4").tobytes().decode("utf-32-le"))


def foreign(idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The greatest cosine of noise with each language (row) at each of ``SIZES``; ``letters`` are those of the learned texts."""
    rng = np.random.default_rng(0)
    kinds = [np.arange(a, b + 1) for a, b in NOISE.values()] + ([letters] if len(letters) else [])
    high = np.zeros((of.max() + 1, len(SIZES)))
    for k, size in enumerate(SIZES):
        cos = np.stack([centroids @ vector(_noise(x, size, rng), idf) for x in kinds for _ in range(DRAWS)]).max(axis=0)
        np.maximum.at(high[:, k], of, cos)
    return np.maximum.accumulate(high, axis=1)


def limits(x: np.ndarray, of: np.ndarray, size: np.ndarray, centroids: int, high: np.ndarray) -> np.ndarray:
    """Each language's limits (row) at ``SIZES`` from the sampled vectors, their languages and numbers of n-grams, and the cosines of noise."""
    nth = np.zeros(len(of), int)
    for lang in range(len(high)):
        nth[of == lang] = np.arange((of == lang).sum()) % 2
    cos, near = np.zeros(len(x)), np.full(len(x), -1)
    for half in (0, 1):
        known = [k for k in range(len(high)) if ((of == k) & (nth != half)).any()]
        own = np.flatnonzero(nth == half)
        if known and len(own):
            by = np.stack([(x[own] @ cluster(x[(of == k) & (nth != half)], centroids).T).max(axis=1) for k in known], axis=1)
            cos[own], near[own] = by.max(axis=1), np.array(known)[by.argmax(axis=1)]
    low = high.copy()  # with no text to judge by, the limit is noise
    for lang in range(len(high)):
        c, n = cos[near == lang], size[near == lang]
        for k, want in enumerate(SIZES) if len(c) else ():
            # the nearest lengths, thirty texts at least: a length of few samples lends from its neighbours
            far = np.abs(np.log2(n / want))
            low[lang, k] = np.quantile(c[np.argsort(far, kind="stable")[: max(30, int((far <= 1).sum()))]], LOW)
    return np.where(low > high, high + BETWEEN * (low - high), low)


def refused(cos: float, size: int, limit: np.ndarray) -> bool:
    return bool(cos < np.interp(np.log2(max(size, 1)), np.log2(SIZES), limit))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> dict:
    """The model: idf, names, and for each centroid its vector, language and rejection limit.

    The driver holds ``MOST`` vectors of ``DIM`` 4-byte numbers twice, 200 MB.
    """
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col("doc_id").alias("i"), "lang", "text").where(F.col("i").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("i")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return {"names": []}
    each = max(1, min(per_language, MOST // len(sizes)))
    h = F.xxhash64(F.col("i").cast("string"))
    # a share of each language that holds more than enough, then the least hashes among it
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (3.0 * each + 100) / n))]), F.col("lang"))
    near = labelled.withColumn("h", h).where(F.pmod(F.col("h"), F.lit(1_000_000)) < share * 1_000_000)
    rows = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "i", "text"))).where(F.col("k") <= each)
    found = sorted(rows.select("lang", "h", "text").mapInArrow(_sampled, "lang string, h long, at binary, n binary, head string").collect(), key=lambda r: (r["lang"], r["h"], bytes(r["at"]), bytes(r["n"]), r["head"]))
    if not found:
        return {"names": []}
    n = np.zeros((len(found), DIM), np.int32)
    for k, r in enumerate(found):
        n[k, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["n"], "<i4")
    idf = np.log((1 + len(n)) / (1 + (n > 0).sum(axis=0))) + 1
    x = np.stack([vector(r, idf).astype(np.float32) for r in n])
    names = sorted({r["lang"] for r in found})
    of = np.array([names.index(r["lang"]) for r in found])
    c = [cluster(x[of == k], centroids) for k in range(len(names))]
    all_c, of_c = np.concatenate(c), np.repeat(np.arange(len(names)), [len(y) for y in c])
    head = np.array([ord(y) for y in "".join(r["head"] for r in found) if ord(y) < len(_letters()) and _letters()[ord(y)]], np.uint32)
    low = limits(x, of, n.sum(axis=1), centroids, foreign(idf, all_c, of_c, head))
    return {"names": names, "idf": idf.astype(np.float32), "centroids": all_c.astype(np.float32), "of": of_c, "low": low}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # centroids of each language: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            names, scores, rejected = [], [], []
            for t in b.column(2):
                n = counts(t.as_py() or "") if m["names"] else None
                if n is None:
                    names.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                cos = m["centroids"] @ vector(n, m["idf"]).astype(np.float32)
                k = int(cos.argmax())
                names.append(m["names"][m["of"][k]])
                scores.append(float(min(1.0, max(0.0, cos[k]))))
                rejected.append(refused(cos[k], int(n.sum()), m["low"][m["of"][k]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text some language accepts, with the columns of ``docs``."""
    model = fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            ok = []
            for t in b.column("text"):
                n = counts(t.as_py() or "") if m["names"] else None
                cos = m["centroids"] @ vector(n, m["idf"]).astype(np.float32) if n is not None else None
                ok.append(cos is not None and not refused(cos.max(), int(n.sum()), m["low"][m["of"][int(cos.argmax())]]))
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
