"""Near-duplicate detection with SetSketch registers.

A document's set are its distinct 5-word shingles. Register i of its sketch is
floor(1 - log_b(min h_i / a)), where h_i is exponential over the shingles: an exponentially spaced,
truncated minimum. Sketches of unions are the maxima of sketches, and equal registers are as likely as
shared shingles, so bands of registers serve as buckets for candidates, and the counts of larger,
smaller and equal registers give the maximum likelihood estimate of the Jaccard similarity.

Copies of one word sequence are a class, and classes are what is compared. First the members of a bucket are
compared with one of them, its center, only; links make components. Buckets whose members still lie in
different components are taken up again, with another center, and at last in blocks of members: sketches
and then the shingles' hashes are compared between components, for pairs that have met in no
earlier band, and what links two components is passed on. So a large group of near
copies costs a few pairs for each member and bucket, not all its pairs. Every passed pair whose estimate
leaves room for the threshold is confirmed on its full sets, as sorted 64-bit hashes of all shingles, slices of a few
hundred pairs at a time; the pairs of a center that has many are dealt into parts.

At 128 registers in 32 bands of 4, a pair of similarity 0.75 meets in no band with a chance of 5e-6;
the estimate's standard error is 0.04 at most, and pairs are given up at 0.15 below the threshold. Two shingles of a pair
with n shingles have the same hash with a chance of n * n / 2**65.

Defined results: a document without words, or null, has an empty set and is linked with nothing; rows
that share a doc_id are one document, so all that is like one of them is in one component, and ``clean`` keeps or drops all of them; a row
without doc_id is linked with nothing, has no component and is kept; a very long text is one set like any other and is
worked on alone; repeated rows get equal answers; documents that tie are told apart by doc_id; further columns are ignored by ``components`` and kept by ``clean``;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connect
from .common import pieces, small_batches, split_join, stored

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Base and rate of the registers, which then fit into 16 bits for any set.
BASE, RATE = 1.001, 20.0
SLACK = 0.15
#: Members of a bucket that are compared with each other in one step.
MEMBERS = 256
#: Shingles, 8 bytes each, of a block of members.
BLOCK_SHINGLES = 2_000_000
#: Rows up to which a set of ids, 24 bytes each, is sent to all executors to pick texts by.
SENT_IDS = 1_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(20240229).integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(20240301).integers(0, 2**63, REGISTERS, dtype=np.uint64)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(docs: list[list[bytes]]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document."""
    flat = pa.array([w for d in docs for w in d], pa.binary()).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    h = known[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            full = full * _MIX + h[k : k + len(full)]
        full = _mixed(full)
        out, at = [], 0
        for d in docs:
            n = len(d)
            if n >= SHINGLE:
                out.append(np.unique(full[at : at + n - SHINGLE + 1]))
            else:
                short = np.uint64(n)
                for x in h[at : at + n]:
                    short = short * _MIX + x
                out.append(_mixed(np.array([short ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)) if n else np.zeros(0, np.uint64))
            at += n
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set, uint16; of an empty set all 0."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 1024):
            least = np.minimum(least, (shingles[k : k + 1024, None] * _ODD + _ADD).min(axis=0))
    u = (least.astype(np.float64) + 1.0) / 2.0**64
    e = -np.log1p(-np.minimum(u, 1 - 1e-16))
    return np.clip(np.floor(1 - np.log(e / RATE) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """int64 bucket keys, (n, BANDS), of sketches (n, REGISTERS)."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, (len(registers), BANDS)).copy()
        for k in range(ROWS):
            key = _mixed(key ^ (r[:, :, k] + np.uint64(1)) * _MIX)
    return key.view(np.int64)


def estimate(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum likelihood estimate of the Jaccard similarity, on a grid.

    more, less: numbers of registers in which a exceeds b and b exceeds a.
    """
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    same = np.clip(1 - up - down, 1e-12, 1)
    total = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (REGISTERS - more - less)[:, None] * np.log(same)
    return np.take_along_axis(j, total.argmax(axis=1)[:, None], 1)[:, 0]


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    possible = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)  # else the sizes alone forbid it
    out = np.zeros(len(ra), bool)
    k = np.flatnonzero(possible)
    if len(k):
        out[k] = estimate((ra[k] > rb[k]).sum(1), (ra[k] < rb[k]).sum(1), na[k].astype(float), nb[k].astype(float)) >= percent / 100 - SLACK
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in pieces(b, "text"):
            docs = [words(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]
            sets = shingle_sets(docs)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("mark"), pa.array([len(x) for x in sets], pa.int64()), pa.array([hashlib.blake2b(b" ".join(d), digest_size=16).digest() if d else None for d in docs], pa.binary()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())],
                names=["doc_id", "mark", "n_shingles", "key", "registers"],
            )


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text, which tells rows of one doc_id apart), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, key (digest of the word sequence, null without words), registers of every row."""
    small_batches(docs.sparkSession)
    return _marked(docs).mapInArrow(_sketched, "doc_id long, mark long, n_shingles long, key binary, registers binary")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 1024):
            part = b.slice(k, 1024)
            if part.num_rows:
                keys = band_keys(_registers(part.column("registers")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), BANDS))], names=["bucket", "node"])


def _kept_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                col = lambda n: b.column(n).to_numpy()
                ok = pa.array(_likely(_registers(b.column("registers_c")), _registers(b.column("registers_m")), col("n_shingles_c"), col("n_shingles_m"), percent))
                yield pa.RecordBatch.from_arrays([b.column("c").filter(ok), b.column("m").filter(ok)], names=["c", "m"])

    return run


def _set(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def _confirmed(percent: int):
    """Of the pairs (c, m) those whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for sc, sm in zip(batch.column("shingles_c"), batch.column("shingles_m")):
                a, b = sorted((_set(sc), _set(sm)), key=len)
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                ok.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("c").filter(pa.array(ok, pa.bool_())), batch.column("m").filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return run


def _beside(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (c, m) and each column x of ``of`` (node, ...) for both, as x_c and x_m; centers, c, may have any number of pairs."""
    side = lambda p: of.select(F.col("node").alias(p), *[F.col(x).alias(f"{x}_{p}") for x in of.columns if x != "node"])
    return split_join(pairs.join(side("m").hint("merge"), "m"), side("c"), "c", counted=pairs)


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: of the pairs (c, m) those that their full sets confirm; most others go by their sketches alone."""
    pairs = stored(pairs, "pairs", narrow=True)
    likely = _beside(pairs, classes.select("node", "n_shingles", "registers")).mapInArrow(_kept_pairs(percent), "c long, m long")
    return _beside(stored(likely, "likely", narrow=True, apart=True), sets).mapInArrow(_confirmed(percent), "a long, b long")


def _across(percent: int):
    """Links between components in blocks (bucket, i, j), whose rows come one after another; confirmed on their full sets."""

    def pairs(rows: pa.Table) -> tuple[list, list]:
        side = rows.column("side").to_numpy()
        left, right = (rows.filter(pa.array(side != x)).combine_chunks() for x in (1, 0))  # 2: a block with itself
        if not left.num_rows or not right.num_rows:
            return [], []
        ra, rb = (np.frombuffer(b"".join(x.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (left, right))
        keys = band_keys(ra), band_keys(rb)
        (ca, cb), (na, nb), (ia, ib) = [[x.column(k).to_numpy().copy() for x in (left, right)] for k in ("component", "n_shingles", "node")]
        sets = [_set(x) for x in right.column("shingles")]
        band = int((keys[0][0] == rows.column("bucket")[0].as_py()).argmax())
        a, b = [], []
        for k in range(left.num_rows):
            near = np.flatnonzero((cb != ca[k]) & (ib != ia[k]))
            if side[0] == 2:
                near = near[near > k]
            if len(near) and band:  # a pair that met in an earlier band is compared there
                near = near[~(keys[1][near, :band] == keys[0][k, :band]).any(axis=1)]
            if len(near):
                near = near[_likely(np.broadcast_to(ra[k], (len(near), REGISTERS)), rb[near], np.full(len(near), na[k]), nb[near], percent)]
            if not len(near):
                continue
            own = _set(left.column("shingles")[k])
            for x in near:
                if cb[x] == ca[k]:  # joined in this block meanwhile
                    continue
                both = int((own[np.minimum(np.searchsorted(own, sets[x]), len(own) - 1)] == sets[x]).sum())
                if 100 * both >= percent * (len(own) + len(sets[x]) - both):
                    a.append(int(ia[k]))
                    b.append(int(ib[x]))
                    old, new = cb[x], ca[k]
                    ca[ca == old], cb[cb == old] = new, new
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy() for k in ("bucket", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if held and tuple(at[s]) != group:
                    yield _pair_batch(*pairs(pa.Table.from_batches(held)))
                    held = []
                group = tuple(at[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield _pair_batch(*pairs(pa.Table.from_batches(held)))

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in pieces(b, "text"):
            sets = shingle_sets([words(t) for t in part.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])


def _pair_batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit hashes) of the classes in ``nodes``, from the text of one document each."""
    ids = stored(classes.join(nodes.distinct().hint("merge"), "node").select("node", F.col("at.doc_id").alias("doc_id"), F.col("at.mark").alias("mark")), "ids", narrow=True)
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids.hint("merge")
    own = _marked(docs).where("doc_id is not null and text is not null")
    return own.join(ids, ["doc_id", "mark"]).select("node", "text").mapInArrow(_hashed, "node long, shingles binary").dropDuplicates(["node"])


def classes_of(rows: DataFrame) -> DataFrame:
    """node (a number of its own), key, at (doc_id, the least, and mark), n_shingles, registers: a row for each distinct word sequence."""
    out = rows.where("key is not null and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    return stored(out.withColumn("node", F.monotonically_increasing_id()), "classes")  # written once, so the numbers stay


def _shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: classes that one doc_id has, each linked with the least of them."""
    several = stored(rows.where("key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("doc_id"), "several", narrow=True)
    of = stored(rows.join(several, "doc_id").select("doc_id", "key").distinct().join(classes.select("key", "node"), "key").select("doc_id", "node"), "of", narrow=True)
    return of.join(of.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (node, ...) and the component so far."""
    of = labels.select(F.col("node").alias("__sx_node"), F.col("component").alias("c"))
    return rows.join(of.hint("merge"), F.col("node") == F.col("__sx_node"), "left").withColumn("component", F.coalesce("c", "node")).drop("__sx_node", "c")


def components(docs: DataFrame, percent: int = PERCENT, members: int = MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = stored(sketches(docs), "sketches")
    classes = classes_of(rows)
    banded = classes.select("node", "registers").mapInArrow(_banded, "bucket long, node long")
    shared = stored(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1").drop("n"), "buckets", narrow=True)
    held = stored(banded.join(shared.hint("merge"), "bucket"), "members")
    sets = stored(_sets(held.select("node"), classes, docs), "shingles")
    # the first center is the least node of a bucket, the second the greatest
    found = _links(held.where("node <> low").select(F.col("low").alias("c"), F.col("node").alias("m")).distinct(), classes, sets, percent)
    links = stored(_shared_ids(rows, classes).unionByName(found), "links", narrow=True, apart=True)
    now = _labelled(held.select("bucket", "node", "high"), connect(links))
    mixed = now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.struct("node", "component"))["component"].alias("of_high")).where("x <> y").select("bucket", "of_high")
    held = stored(now.join(stored(mixed, "mixed", narrow=True).hint("merge"), "bucket"), "members")
    found = _links(held.where("component <> of_high").select(F.col("high").alias("c"), F.col("node").alias("m")).distinct(), classes, sets, percent)
    links = stored(links.unionByName(found), "links", narrow=True, apart=True)
    now = _labelled(held.select("bucket", "node"), connect(links)).join(classes.select("node", "n_shingles").hint("merge"), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / members), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    mixed = now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), blocks.alias("blocks")).where("x <> y").select("bucket", "blocks")
    left = now.join(stored(mixed, "mixed", narrow=True).hint("merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.join(classes.select("node", "registers").hint("merge"), "node").join(sets.hint("merge"), "node")
    # a row goes to every pair of blocks that its own is in: once in all for a bucket of one block
    wide = ["node", "component", "n_shingles", "registers", "shingles"]
    dealt = left.select("bucket", *wide, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("bucket", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.when(F.col("block") == F.col("o"), 2).when(F.col("block") < F.col("o"), 0).otherwise(1).alias("side"), *wide)
    more = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_across(percent), "a long, b long")
    final = connect(stored(links.unionByName(more), "links", narrow=True, apart=True))
    # a component's name is the least doc_id of its classes
    joined = stored(classes.select("key", "node", F.col("at.doc_id").alias("doc")).join(final.hint("merge"), "node"), "joined", narrow=True)
    names = joined.join(joined.groupBy("component").agg(F.min("doc").alias("c")), "component").select("key", "c")
    known = classes.select("key", F.col("at.doc_id").alias("doc")).join(stored(names, "names", narrow=True).hint("merge"), "key", "left").select("key", F.coalesce("c", "doc").alias("c"))
    out = rows.select("doc_id", "n_shingles", "key").join(stored(known, "components", narrow=True).hint("merge"), "key", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one with the least doc_id; of rows that share a doc_id all or none."""
    gone = stored(components(docs).where("not kept").select(F.col("doc_id").alias("__sx_gone")).distinct(), "gone", narrow=True)
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__sx_gone"), "left_anti")
