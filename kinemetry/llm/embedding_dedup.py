"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into halves; each half has its own codebook, and the pairs of nearest codewords
form a grid of cells per label. A vector belongs to one cell and visits those whose lower bound of
distance, the two halves' bounds together, is within the radius that the wanted cosine allows: the
cells in order of that bound (multi-sequence), up to where it passes the radius, which is where the
recall is complete. Members and visitors of a cell meet in blocks and are verified in double
precision."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinemetry.llm.common import chosen, components, written

COSINE = 0.98
#: Vectors that the codebooks are fitted on, and codewords of a half: at least, at most.
SAMPLE, LEAST_WORDS, MOST_WORDS = 4096, 2, 64
#: Vectors of one label a cell should hold, and rows of a block.
CELL_ROWS, BLOCK_ROWS = 1024, 1024
#: Rounding of the bound and of the two ways to sum a dot product.
SLACK = 1e-6


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of the rows (fewer if there are fewer different rows)."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre, and per centre a squared distance that any point nearest to it has at least
    from x: what lies between x and the planes that part that centre's points from the others'."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    gap = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    gap[gap == 0] = np.inf
    low = np.zeros_like(d)
    for k in range(len(centres)):
        low = np.maximum(low, (d - d[:, k : k + 1]) / (2 * gap[k]))
    return d.argmin(1), low**2


def visits(low1: np.ndarray, low2: np.ndarray, radius2: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per vector the cells (i, j) to visit. Both bound lists are sorted; cells are taken in order of
    the sum, which for a fixed i is a run of the second list."""
    order1, order2 = low1.argsort(1), low2.argsort(1)
    out = []
    for a, b, i, j in zip(np.take_along_axis(low1, order1, 1), np.take_along_axis(low2, order2, 1), order1, order2, strict=True):
        run = np.searchsorted(b, radius2 - a[: np.searchsorted(a, radius2, "right")], "right")
        out.append((np.repeat(i[: len(run)], run), np.concatenate([j[:r] for r in run]) if len(run) else j[:0]))
    return out


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Components of the places 0..n-1 under links (u, v): the least place of each."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meet(members: pa.Table, visitors: pa.Table, cosine: float) -> pa.Table:
    """One block of members against one of visitors of a cell: for each visitor its links there, and
    links (id, id of the same component) that hold the block's components together."""
    kind = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])
    if not members.num_rows or not visitors.num_rows:
        return kind.empty_table()
    d = members["d"][0].as_py()
    a, b = (_matrix(t["x"].combine_chunks(), d) for t in (visitors, members))
    ida, idb = (t["id"].to_numpy() for t in (visitors, members))
    close = (unit(a) @ unit(b).T >= cosine) & (ida[:, None] != idb[None])
    links = close @ members["copies"].to_numpy()
    u, v = np.nonzero(close)
    ids = np.concatenate((ida, idb))
    ids, place = np.unique(ids, return_inverse=True)
    root = _joined(len(ids), place[u], place[len(ida) + v])
    tied = np.flatnonzero(root != np.arange(len(ids)))
    some = np.flatnonzero(links)
    return pa.table({"id": np.concatenate((ida[some], ids[tied])), "links": np.concatenate((links[some], np.zeros(len(tied), np.int64))),
                     "to": pa.array([None] * len(some) + ids[root[tied]].tolist(), pa.int64())}, schema=kind)


def _cells(books: tuple[np.ndarray, np.ndarray], d: int, radius2: float):
    """Makes, of vectors, the numbers of their own cells and of those that they visit."""

    def of(x: pa.Array) -> pa.Array:
        own, seen, n2 = [], [], len(books[1])
        for i in range(0, len(x), BLOCK_ROWS):
            v = unit(_matrix(x[i : i + BLOCK_ROWS], d))
            (h1, low1), (h2, low2) = bounds(v[:, : d // 2], books[0]), bounds(v[:, d // 2 :], books[1])
            own.append((h1 * n2 + h2).astype(np.int32))
            seen += [(a * n2 + b).astype(np.int32) for a, b in visits(low1, low2, radius2)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(own) if own else np.zeros(0, np.int32)), pa.array(seen, pa.list_(pa.int32()))], names=["cell", "visits"])

    return of


def link(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row: the id, n_links (other vectors of its label with at least that cosine),
    component_id (the smallest id reachable over links) and kept (the id is that).

    A vector that is null, empty, zero or holds a null or non-finite component, or whose label is
    null, has no links; vectors of different length have none with each other. Copies are compared
    once and counted; repeated rows are copies. An empty table gives an empty one; other columns are
    left out. Every pair is found that reaches the cosine: no cell, block or partner is left out."""
    good = (F.col("label").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("x"), F.col(f"`{label}`").alias("label"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    own, _ = written(rows.where("good").groupBy("label", "x").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("d", F.size("x")))
    sizes = {r.d: (r.n, r.labels) for r in own.groupBy("d").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).collect()}
    found = None
    for d, (n, labels) in sizes.items():
        part = own.where(F.col("d") == d)
        sample = unit(_matrix(part.orderBy(F.xxhash64("id")).limit(SAMPLE).select("x").toArrow()["x"].combine_chunks(), d))
        k = int(np.clip(math.sqrt(n / max(labels, 1) / CELL_ROWS), LEAST_WORDS, MOST_WORDS))
        books = tuple(codebook(s, k) for s in (sample[:, : d // 2], sample[:, d // 2 :]))
        cells = F.arrow_udf(_cells(books, d, 2 - 2 * cosine + SLACK), "struct<cell:int,visits:array<int>>")
        dealt, path = written(chosen(part, "cells", cells(F.col("x"))))
        # read anew, so that the two sides of a cell's meeting are told apart
        visiting = own.sparkSession.read.schema(dealt.schema).parquet(path).select("label", F.explode("visits").alias("cell"), "id", "x", "d")
        blocks_of = lambda df, to: df.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(to))
        count = blocks_of(dealt, "mb").join(blocks_of(visiting.select("label", "cell"), "vb"), ["label", "cell"])
        count, at = written(count)
        again = own.sparkSession.read.schema(count.schema).parquet(at)
        key = ["label", "cell", "m", "v"]
        left = (dealt.select("label", "cell", "id", "x", "copies", "d").join(count, ["label", "cell"])
                .withColumn("m", F.pmod(F.xxhash64("id"), F.col("mb")).cast("int"))
                .withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).select(*key, "id", "x", "copies", "d"))
        right = (visiting.join(again, ["label", "cell"])
                 .withColumn("v", F.pmod(F.xxhash64("id"), F.col("vb")).cast("int"))
                 .withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).select(*key, "id", "x", "d"))
        met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: _meet(a, b, cosine), "id long, links long, `to` long")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return rows.select(F.col("id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found, _ = written(found)
    links = found.where("`to` is null").groupBy("id").agg(F.sum("links").alias("links"))
    whole = components(found.where("`to` is not null").select(F.col("id").alias("u"), F.col("to").alias("v")))
    of_own = (own.join(links, "id", "left").join(whole, "id", "left")
              .select("label", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c")))
    out = rows.where("good").join(of_own, ["label", "x"]).select("id", "n", "c").unionByName(
        rows.where("not good").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c")))
    return out.select(F.col("id").alias(vec_id), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(False)).alias("kept"))
