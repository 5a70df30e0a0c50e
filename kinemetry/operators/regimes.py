"""How many operating regimes a device's learn windows show, and how many directions they vary in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Learn windows of a device at most, numbers of regimes tried, windows that a regime needs, least
#: distance of two centres, least silhouette (along one direction; otherwise), share of the largest spread that counts.
LEARN, TRIED, LEAST_WINDOWS, LEAST_GAP, LEAST_SILHOUETTE, SPREAD = 200, (2, 3, 4), 8, 1.0, (0.75, 0.5), 0.05
RESTARTS, ROUNDS = 10, 100


def directions(x: np.ndarray) -> int:
    """Singular values of the centred rows of at least SPREAD of the greatest."""
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) if len(x) > 1 else np.zeros(1)
    return int((s >= SPREAD * s[0]).sum()) if s[0] > 0 else 0


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """k-means of least inertia over RESTARTS starts, each spread out by squared distance; numbered by first row."""
    random, best = np.random.default_rng(0), (np.inf, np.zeros(len(x), int))
    for _ in range(RESTARTS):
        centres = x[[random.integers(len(x))]]
        while len(centres) < k:
            d = _distances(x, centres).min(1) ** 2
            centres = np.vstack((centres, x[random.choice(len(x), p=d / d.sum()) if d.sum() > 0 else 0]))
        for _ in range(ROUNDS):
            near = _distances(x, centres).argmin(1)
            moved = np.stack([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
            if np.allclose(moved, centres):
                break
            centres = moved
        inertia = (_distances(x, centres).min(1) ** 2).sum()
        if inertia < best[0] - 1e-12:
            best = inertia, near
    _, first, label = np.unique(best[1], return_index=True, return_inverse=True)
    return first.argsort().argsort()[label]


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance; a row alone in its cluster counts zero."""
    d = _distances(x, x)
    sizes = np.bincount(label)
    to = np.stack([d[:, label == c].sum(1) for c in range(len(sizes))], 1)
    own = sizes[label]
    inner = to[np.arange(len(x)), label] / np.maximum(own - 1, 1)
    mean = to / sizes
    mean[np.arange(len(x)), label] = np.inf
    outer = mean.min(1)
    return float(np.where(own > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0).mean())


def candidates(x: np.ndarray) -> pd.DataFrame:
    """A row for each number of regimes tried: its labels, the windows of the smallest regime, the least distance of
    two centres, the silhouette, and the least silhouette that rows which vary so need."""
    need = LEAST_SILHOUETTE[directions(x) > 1]
    rows = []
    for k in (k for k in TRIED if k <= len(x)):
        label = clustered(x, k)
        centres = _distances(c := centres_of(x, label), c) + np.diag(np.full(len(c), np.inf))
        rows.append((k, label, len(c), np.bincount(label).min(), centres.min(), silhouette(x, label) if len(c) > 1 else -1.0, need))
    return pd.DataFrame(rows, columns=["k", "label", "found", "smallest", "gap", "silhouette", "need"])


def centres_of(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    return np.stack([x[label == c].mean(0) for c in range(label.max() + 1)])


def split(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The regime of each row, and the silhouette of the split (-1: one regime): of the candidates that hold the one
    of the greatest silhouette, of fewest regimes among equals."""
    fit = candidates(x).query("found == k and smallest >= @LEAST_WINDOWS and gap >= @LEAST_GAP and silhouette >= need")
    if fit.empty:
        return np.zeros(len(x), int), -1.0
    best = fit.loc[fit["silhouette"].idxmax()]
    return best["label"], float(best["silhouette"])


def models(windows: DataFrame, device: str, order: str, point: Column) -> DataFrame:
    """(device, centres, silhouette): the regimes that the first LEARN windows of each device show. LEARN bounds what
    a device's task holds, as learning has a bounded set by definition; points with a null or non-finite part don't count."""
    kind = windows.schema[device].dataType.simpleString()
    fine = ~F.exists("p", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    learn = windows.select(F.col(device).alias("device"), F.col(order).alias("id"), point.alias("p")).where(fine)
    learn = learn.withColumn("n", F.row_number().over(Window.partitionBy("device").orderBy("id"))).where(F.col("n") <= LEARN)

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("n")["p"]).astype(float)
        label, s = split(x)
        return pd.DataFrame({"device": key[:1], "centres": [centres_of(x, label).tolist()], "silhouette": [s]})

    return learn.drop("id").groupBy("device").applyInPandas(of, f"device {kind}, centres array<array<double>>, silhouette double")


def assigned(points: DataFrame, model: DataFrame) -> DataFrame:
    """`points` (device, id, p, ...) with the regime whose centre in `model` (device, centres, silhouette) is nearest (ties:
    the smaller number), how many regimes the device has, and their silhouette. A point with a null or non-finite part
    has a null regime; so have all of a device without a model. A device null is one device."""
    far = F.transform("centres", lambda c, i: F.struct(F.aggregate(F.zip_with(c, "p", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v).alias("d"), i.alias("i")))
    d = F.array_min(far)
    joined = points.join(model.withColumnRenamed("device", "_own"), F.col("device").eqNullSafe(F.col("_own")), "left")
    return joined.withColumn("regime", F.when(d["d"] < float("inf"), d["i"]).cast("int")).withColumn("regimes", F.size("centres")).drop("_own", "centres", "p")


def choose(windows: DataFrame, device: str, order: str, point: Column) -> DataFrame:
    """(device, id, regime, regimes, silhouette) of every window, by the model of its device (`models`, `assigned`)."""
    every = windows.select(F.col(device).alias("device"), F.col(order).cast("long").alias("id"), point.alias("p"))
    return assigned(every, models(windows, device, order, point)).select("device", "id", "regime", "regimes", "silhouette")


@F.pandas_udf(T.DoubleType())
def effective_rank(covariance: pd.Series) -> pd.Series:
    """exp of the entropy of the singular values' shares of centred rows, from their covariance."""
    out = []
    for c in covariance:
        own = np.linalg.eigvalsh(np.stack(c))
        s = np.sqrt(own[own > 1e-12 * max(own[-1], 1e-300)])
        p = s / s.sum() if len(s) else np.ones(1)
        out.append(float(np.exp(-(p * np.log(p)).sum())))
    return pd.Series(out)
