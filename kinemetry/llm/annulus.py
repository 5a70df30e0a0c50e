"""Centroid clustering in whole numbers, with an annulus search for the nearest centroid.

Each round reads the vectors once and sends one row of sums per task and centroid. A vector's
distance to the centroid whose norm is next to its own bounds its distance to the nearest; a centroid
that is not farther has a norm within that bound of the vector's (the annulus). Centroids are
sorted by norm, binary searches give the annulus of each vector, and only those in it are compared,
exactly and with ties to the smaller number."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinemetry.llm.common import written

#: Vectors a block, and pairs of a vector and a centroid that are compared at a time.
ROWS, PAIRS = 4096, 1 << 15
#: Scale of the whole numbers.
SCALE = 1024


def largest(d: int) -> int:
    """The largest whole number with which squared distances of `d` components stay in 64 bits."""
    return min(math.isqrt((2**63 - 1) // (4 * d)), 2**31 - 1)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row (ties: the smaller number), and
    how many pairs were compared for it. All are whole numbers."""
    norms = np.sqrt(squared(centroids, np.zeros_like(centroids)).astype(float))
    order = np.argsort(norms, kind="stable")
    norms, of = norms[order], np.sqrt(squared(x, np.zeros_like(x)).astype(float))
    at = np.clip(np.searchsorted(norms, of), 1, max(len(norms) - 1, 1))
    at = np.where((at < len(norms)) & (of - norms[at - 1] > norms[np.minimum(at, len(norms) - 1)] - of), np.minimum(at, len(norms) - 1), at - 1)
    bound = np.sqrt(squared(x, centroids[order[at]]).astype(float))
    # a little wider than the annulus, so that what lies on its edge is compared
    slack = 1e-9 * (of + bound) + 1e-6
    low, high = np.searchsorted(norms, of - bound - slack, "left"), np.searchsorted(norms, of + bound + slack, "right")
    number, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    ends = np.cumsum(high - low)
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        n = (high - low)[a:b]
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(a, b), n)
        who = order[np.arange(len(row)) - np.repeat(first - low[a:b], n)]
        d = squared(x[row], centroids[who])
        best = np.minimum.reduceat(d, first)
        number[a:b] = np.minimum.reduceat(np.where(d == best[row - a], who, len(norms)), first)
        distance[a:b] = best
        a = b
    return number, distance, int(ends[-1]) if len(ends) else 0


def _matrices(batch: pa.RecordBatch, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for i in range(0, batch.num_rows, ROWS):
        part = batch.slice(i, ROWS)
        yield part, part["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64)


def whole_vectors(df: DataFrame, vec_id: str, embedding: str, d: int) -> DataFrame:
    """(id, v): the vectors that are kept, each component x as floor(SCALE * x)."""
    x = F.col("x")
    fine = (F.size(x) == d) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(F.floor(SCALE * c.cast("double")).cast("double")) > largest(d)))
    rows = df.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{embedding}`").alias("x")).where(x.isNotNull())
    # two steps, so that components that can't be whole numbers never meet the cast
    return rows.select("id", F.when(fine, F.transform(x, lambda c: F.floor(SCALE * c.cast("double")).cast("int"))).alias("v")).where("v is not null")


def start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hashes of their ids, in the order of the hashes; at most k rows are read."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in vectors.orderBy(digest, "id", "v").limit(k).select("v").collect()], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: those that have vectors at the floor of their mean."""
    k, d = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x in _matrices(batch, d):
                number, *_ = nearest(x, centroids)
                counts += np.bincount(number, minlength=k)
                by = np.argsort(number, kind="stable")
                here, first = np.unique(number[by], return_index=True)
                sums[here] += np.add.reduceat(x[by], first)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], names=["number", "n", "sums"])

    parts = vectors.select("v").mapInArrow(add, "number int, n long, sums array<long>")
    one = parts.select("number", "n", F.posexplode("sums").alias("i", "s")).groupBy("number", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in one.collect():  # one row per centroid and component
        out[r.number, r.i] = int(r.s) // r.n
    return out


def cluster(df: DataFrame, k: int, rounds: int, seed: int, d: int, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each vector that is kept, and the final centroids.

    A vector is kept if it has exactly `d` components, none null or non-finite; none may pass `largest`
    as a whole number (with 64 components: 185,000 or more), as distances would leave 64 bits: such a
    vector is left out too. Centroids are the kept vectors with the `k` smallest hashes (fewer, if fewer are
    kept); rows that share an id and repeated rows are vectors of their own. A centroid without
    vectors stays. No vector kept gives an empty result and no centroids. The centroids, k by d
    numbers, are what the driver and every task hold."""
    vectors, _ = written(whole_vectors(df, vec_id, embedding, d))
    centroids = start(vectors, k, seed).reshape(-1, d)
    kind = vectors.select("id").schema.add("cluster", "integer").add("distance", "long")
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        now = moved(vectors, centroids)
        if (now == centroids).all():
            break  # further rounds would leave them where they are
        centroids = now

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch, d):
                number, distance, _ = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(assign, kind), centroids
