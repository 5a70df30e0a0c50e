"""Learning what is normal per regime: shrunk covariances, scores, robust thresholds.

Of the windows only sums are gathered: a task keeps them per regime, at most REGIMES at a time, and Spark adds them
up element by element. So a regime that holds most rows is no larger for any task than another."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinemetry.operators.quantiles import quantiles
from kinemetry.sources import folders

#: Regimes whose sums one task holds before it hands them on.
REGIMES = 1024
ALERT_QUANTILE, CONTAMINATED = 0.995, 1.25
#: Quantiles of the squared distance that the scaled chi-square goes through, and its degrees of freedom.
BODY, FREEDOM = (0.5, 0.75), (1.0, 5000.0)
MODEL = "struct<n:bigint,mean:array<double>,shrinkage:double,covariance:array<array<double>>,precision:array<array<double>>>"


def _sums(x: np.ndarray) -> np.ndarray:
    """n, the sum of |x|^4, and the sums of x, x |x|^2 and x x', in one row."""
    q = (x * x).sum(1)
    return np.concatenate(([len(x), (q * q).sum()], x.sum(0), q @ x, (x.T @ x).ravel()))


def model_of(sums: np.ndarray, shrunk: bool = True) -> dict:
    """Ledoit-Wolf estimate from `_sums` of the windows."""
    p = int(round(math.sqrt(len(sums) - 1))) - 1  # 2 + 2 p + p^2 entries
    n, fourth = int(sums[0]), sums[1]
    mean, cubes, gram = sums[2 : 2 + p] / n, sums[2 + p : 2 + 2 * p], sums[2 + 2 * p :].reshape(p, p)
    s = gram / n - np.outer(mean, mean)
    m2 = mean @ mean
    # the sum of |x - mean|^4, expanded
    centred = fourth + 4 * mean @ gram @ mean + n * m2 * m2 - 4 * cubes @ mean + 2 * m2 * np.trace(gram) - 4 * n * m2 * m2
    mu, square = np.trace(s) / p, (s * s).sum()
    delta = (square - p * mu * mu) / p
    beta = min((centred / n - square) / (p * n), delta)
    shrinkage = beta / delta if shrunk and beta > 0 and delta > 0 else 0.0
    covariance = (1 - shrinkage) * s + shrinkage * mu * np.eye(p)
    return {"n": n, "mean": mean.tolist(), "shrinkage": float(shrinkage), "covariance": covariance.tolist(), "precision": np.linalg.pinv(covariance, hermitian=True).tolist()}


def learn(windows: DataFrame, regime: str = "regime", x: str = "x", shrunk: bool = True) -> DataFrame:
    """One row per regime: n, mean, shrinkage, covariance (as it is counted, if not `shrunk`), precision.

    Vectors are standardised before, all of one length. Rows whose regime or vector is null, or whose vector holds a null
    or non-finite component, don't count; a single row has a zero covariance and precision. No rows give no rows."""
    kind = windows.schema[regime].dataType.simpleString()
    finite = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = windows.select(F.col(f"`{regime}`").alias("regime"), F.col(f"`{x}`").cast("array<double>").alias("x")).where("regime is not null and size(x) > 0").where(finite)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        of_kind = None

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), of_kind), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["regime", "sums"])

        for batch in batches:
            of_kind = batch.column(0).type
            codes = batch.column(0).dictionary_encode()
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            where = codes.indices.to_numpy()
            for i, name in enumerate(codes.dictionary.to_pylist()):
                held[name] = held.get(name, 0) + _sums(vectors[where == i])
            if len(held) > REGIMES:
                yield given()
                held.clear()
        if held:
            yield given()

    parts = rows.mapInArrow(partial, f"regime {kind}, sums array<double>")
    added = parts.select("regime", F.posexplode("sums").alias("i", "v")).groupBy("regime", "i").agg(F.sum("v").alias("v"))
    whole = added.groupBy("regime").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("sums"))

    @F.arrow_udf(MODEL)
    def finished(sums: pa.Array) -> pa.Array:
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.float64(), *[pa.list_(pa.list_(pa.float64()))] * 2]
        names = ["n", "mean", "shrinkage", "covariance", "precision"]
        return pa.array([model_of(np.array(s), shrunk) for s in sums.to_pylist()], pa.struct(list(zip(names, kinds, strict=True))))

    return whole.select(F.col("regime").alias(regime), finished("sums").alias("m")).select(regime, "m.*")


def scores(windows: DataFrame, models: DataFrame, regime: str = "regime", x: str = "x") -> DataFrame:
    """`windows` with `score`, the Mahalanobis distance to the model of their regime: null where it has none, or where
    the vector is null or of another length. An input column `score` is replaced.

    Spark sends the models to all tasks if their measured size allows it, and shuffles else."""
    own = models.select(F.col(f"`{regime}`").alias("_regime"), F.col("mean").alias("_mean"), F.col("precision").alias("_precision"))
    both = windows.drop("score").join(own, F.col(f"`{regime}`") == F.col("_regime"), "left")
    both = both.withColumn("_off", F.zip_with(F.col(f"`{x}`").cast("array<double>"), "_mean", lambda a, b: a - b))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    # not below zero but by rounding
    squared = dot(F.transform("_precision", lambda row: dot(row, F.col("_off"))), F.col("_off"))
    return both.withColumn("score", F.sqrt(F.abs(squared))).drop("_regime", "_mean", "_precision", "_off")


def chi2_cdf(v: float, nu: float) -> float:
    """Chi-square distribution: the regularised lower incomplete gamma function by its series, or by the continued
    fraction of the upper one."""
    a, y = nu / 2, v / 2
    if y <= 0:
        return 0.0
    scale = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= y / k
            total += term
        return min(1.0, scale * total)
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_quantile(q: float, nu: float) -> float:
    low, high = 0.0, nu + 20 * math.sqrt(2 * nu) + 40
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, nu) < q else (low, mid)
        if high - low <= 1e-12 * high:
            break
    return (low + high) / 2


def analytic(n: int, low: float, high: float, q: float = ALERT_QUANTILE) -> float | None:
    """The q-quantile of a distance whose square is a scaled chi-square with these two quantiles (BODY); None if there
    are fewer than five windows or no such distribution."""
    if n < 5 or not 0 < low < high:
        return None

    def off(nu: float) -> float:
        return chi2_quantile(BODY[0], nu) / chi2_quantile(BODY[1], nu) - low / high

    a, b = FREEDOM
    if off(a) * off(b) > 0:
        return None
    while b - a > 1e-4:
        mid = (a + b) / 2
        a, b = (mid, b) if off(mid) < 0 else (a, mid)
    return math.sqrt(low / chi2_quantile(BODY[0], a) * chi2_quantile(q, a))


def thresholds(scored: DataFrame, regime: str = "regime") -> DataFrame:
    """One row per regime: n, threshold (the lower of both), empirical, analytic, ratio and contaminated (the windows
    hold more than their body accounts for). Null scores don't count; without a fit both thresholds are the empirical."""

    @F.arrow_udf("double")
    def fitted(n: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        return pa.array([analytic(*row) for row in zip(n.to_pylist(), low.to_pylist(), high.to_pylist(), strict=True)], pa.float64())

    rows = folders.kept(scored.select(F.col(f"`{regime}`").alias(regime), "score", (F.col("score") * F.col("score")).alias("d2")).where("score is not null"))
    body = quantiles(rows, [regime], "d2", list(BODY)).select(F.col(f"`{regime}`").alias("_of"), F.col("q").alias("body"))
    base = quantiles(rows, [regime], "score", [ALERT_QUANTILE]).withColumn("empirical", F.col("q")[0]).drop("q")
    base = base.join(body, F.col(f"`{regime}`").eqNullSafe(F.col("_of"))).drop("_of")
    both = base.withColumn("analytic", F.coalesce(fitted("n", F.col("body")[0], F.col("body")[1]), "empirical"))
    ratio = F.when(F.col("analytic") > 0, F.col("empirical") / F.col("analytic")).otherwise(float("inf"))
    return both.select(regime, "n", F.least("empirical", "analytic").alias("threshold"), "empirical", "analytic", ratio.alias("ratio"), (ratio > CONTAMINATED).alias("contaminated"))
