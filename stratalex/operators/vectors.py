"""Operators over tables of vectors: centroids, cohesion, alignment, leave-one-out attribution."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine, dot, norm, subtract, unit

#: Numbers in a block of vectors, and vectors in one at most: what a task compares with another block at once.
BLOCK, BLOCK_ROWS = 1 << 16, 4096
#: By how much a cosine from a matrix product may miss the one worked out place by place, and what rounding to 9 places hides.
SLACK = 1e-8


def mean_vectors(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """key, vec: the mean of each place over the group's vectors."""
    places = rows.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return places.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vec"))


def centroid_similarity(rows: DataFrame, item: str, key: str, vec: str = "vec") -> DataFrame:
    """item, key, sim (cosine with the group's unit centroid, 0 to 1), rank within the group."""
    from pyspark.sql import Window

    own = rows.select(item, key, unit(F.col(vec)).alias("u")).where("u is not null")
    centers = mean_vectors(own.withColumnRenamed("u", "vec"), key).select(F.col(key).alias("k"), F.col("vec").alias("c"))
    out = own.join(centers, F.col(key) == F.col("k"))
    sim = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("u"), F.col("c"))))
    return out.select(item, key, sim.alias("sim")).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.round("sim", 9).desc(), item)))


def cohesion(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Mean cosine of a group's pairs from sums alone: (|sum of units|^2 - n) / (n * (n - 1)), no pair is made."""
    own = rows.select(key, unit(F.col(vec)).alias("u")).where("u is not null")
    n = own.groupBy(key).agg(F.count(F.lit(1)).alias("members"))
    sums = own.select(key, F.posexplode("u").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x")).groupBy(key).agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    return n.join(sums, key).select(key, "members", F.when(F.col("members") > 1, (F.col("square") - F.col("members")) / (F.col("members") * (F.col("members") - 1))).otherwise(F.lit(0.0)).alias("cohesion"))


def best_alignment(rows: DataFrame, item: str, centers: DataFrame, vec: str = "vec") -> DataFrame:
    """item and the label and cosine of its nearest of ``centers`` (label, vec), a set of few rows sent along as one row."""
    sent = centers.agg(F.array_sort(F.collect_list(F.struct("label", F.col("vec").alias("c")))).alias("centers"))
    best = F.transform("centers", lambda x: F.struct(F.round(cosine(F.col(vec), x["c"]), 9).alias("sim"), (-x["label"]).alias("label")))
    return rows.join(F.broadcast(sent)).select(item, F.array_max(best).alias("b")).select(item, (-F.col("b.label")).alias("label"), F.col("b.sim").alias("sim"))


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """``name`` (array of the rows, in their columns' order) and ``name``_dim: rows with as many places (column dim) dealt into blocks by a hash."""
    total = rows.agg(F.sum("dim"), F.count(F.lit(1))).first()
    n = max(1, -(-(total[0] or 0) // BLOCK), -(-total[1] // BLOCK_ROWS))
    parts = min(n, max(rows.sparkSession.sparkContext.defaultParallelism, n // 16))
    kept = [c for c in rows.columns if c != "dim"]
    dealt = rows.withColumn("__sx_block", F.pmod(F.xxhash64(*kept), F.lit(n))).repartition(parts, "dim", "__sx_block")
    out = dealt.groupBy("dim", "__sx_block").agg(F.sort_array(F.collect_list(F.struct(*kept))).alias(name))
    return out.select(F.col("dim").alias(f"{name}_dim"), name).coalesce(parts)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _block_pairs(a: pa.StructArray, b: pa.StructArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``a``, row of ``b`` and cosine: all that can be among the ``k`` nearest of ``b`` to a row of ``a``, equal ones in the order of ``b``.

    A matrix product chooses them; their cosines are then added up place by place, as the expression ``cosine`` does.
    """
    u, v = _matrix(a.field("vec")), _matrix(b.field("vec"))
    size_u, size_v = a.field("size").to_numpy(zero_copy_only=False), b.field("size").to_numpy(zero_copy_only=False)
    met, first = Counter(), []
    for i, row in enumerate(v):  # of equal vectors the first k alone can be among the nearest
        met[key := row.tobytes()] += 1
        if met[key] <= k:
            first.append(i)
    first = np.array(first)
    v, size_v = v[first], size_v[first]
    with np.errstate(all="ignore"):
        near = u @ v.T / (size_u[:, None] * size_v[None, :])
        near[np.isnan(near)] = np.inf  # sorts first, as in Spark
        least = np.partition(near, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(u), -np.inf)
        x, y = np.nonzero(near >= least[:, None] - SLACK)
        total, u, v = np.zeros(len(x)), u.T.copy(), v.T.copy()
        for p, q in zip(u, v, strict=True):
            total += p[x] * q[y]
        return x, first[y], total / (size_u[x] * size_v[y])


def nearest(rows: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """The columns of ``rows`` and ``others`` but their ``vec``, and sim: for each row a few of ``others`` with the ``k`` of greatest cosine (to 9 places) among them.

    Of equal cosines those of ``others`` that come first by its first column are there. All pairs are compared, block by block: vectors are dealt into blocks of ``BLOCK``
    numbers, so a task holds two blocks whatever the tables' sizes, and the work is one matrix product for two blocks. A vector that is null, has null places or
    no length has the cosine 0, as in ``cosine``; vectors of different lengths have none (null).
    """
    left, right = [c for c in rows.columns if c != "vec"], [c for c in others.columns if c != "vec"]

    def ready(df: DataFrame, names: list[str]) -> DataFrame:
        # generators' output is worked out once
        own = df.select(*names, F.explode(F.array(F.col("vec").cast("array<double>"))).alias("vec")).select("*", F.explode(F.array(norm(F.col("vec")))).alias("size"))
        good = F.col("size") > 0
        return own.select(*names, F.when(good, F.col("vec")).alias("vec"), F.when(good, F.col("size")).alias("size"), F.when(good, F.size("vec")).cast("long").alias("dim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("a")[i].values, batch.column("b")[i].values
                dims = batch.column("a_dim")[i].as_py(), batch.column("b_dim")[i].as_py()
                if None in dims or dims[0] != dims[1]:
                    few = min(k, len(b))
                    x, y, sim = np.repeat(np.arange(len(a)), few), np.tile(np.arange(few), len(a)), pa.array([0.0 if None in dims else None] * (few * len(a)), pa.float64())
                else:
                    x, y, sim = _block_pairs(a, b, k)
                    sim = pa.array(sim, pa.float64())
                got = [a.field(c).take(pa.array(x)) for c in left] + [b.field(c).take(pa.array(y)) for c in right]
                yield pa.RecordBatch.from_arrays([*got, sim], names=[*left, *right, "sim"])

    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in left), *(T.StructField(c, others.schema[c].dataType) for c in right), T.StructField("sim", T.DoubleType())])
    return _blocks(ready(rows, left), "a").crossJoin(_blocks(ready(others, right), "b")).mapInArrow(run, schema)


def leave_one_out(pairs: DataFrame) -> DataFrame:
    """a, b, delta, n: how much of a parent's likeness to a is lost without b, averaged over (p, a, va, b, vb).

    delta(a given b) = cos(p, a) - cos(p - b, a).
    """
    eps = 1e-9
    p, a, b = F.col("p"), F.col("va"), F.col("vb")
    given_b = cosine(p, a, eps) - cosine(subtract(p, b), a, eps)
    given_a = cosine(p, b, eps) - cosine(subtract(p, a), b, eps)
    return pairs.select("a", "b", given_b.alias("x"), given_a.alias("y")).groupBy("a", "b").agg(F.avg("x").alias("delta_a"), F.avg("y").alias("delta_b"), F.count(F.lit(1)).alias("n"))


def kmeans(rows: DataFrame, item: str, k: int, seed: int = 42, vec: str = "vec") -> DataFrame:
    """item, cluster (0 to k - 1) by cosine over unit vectors; rows without a direction are in no cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = rows.select(item, unit(F.col(vec)).alias("u")).where("u is not null").select(item, array_to_vector("u").alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(own)
    return model.transform(own).select(item, F.col("prediction").cast("long").alias("cluster"))


__all__ = ["best_alignment", "centroid_similarity", "cohesion", "dot", "kmeans", "leave_one_out", "mean_vectors", "nearest", "norm"]
