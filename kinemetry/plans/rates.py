"""Resampling, levels between samples, band shares and envelopes of signals of 64 samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinemetry.functions import arrays as A
from kinemetry.functions import rates
from kinemetry.plans.spectral import _S, N, _signals

#: Rates of the resampling, and the band in hertz at 16 kHz whose share is taken.
FROM, TO, FS, BAND = 12000.0, 6400.0, 16000.0, (3000.0, 6000.0)


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal at 8/15 of its rate."""
    y = _signals(spark, sf_dir).select("vec_id", rates.resampled(F.col("x"), F.lit(FROM), TO).alias("y"))
    return y.select("vec_id", F.posexplode("y").alias("i", "v")).select("vec_id", "i", F.round("v", 6).alias("v"))


def true_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", F.round(rates.true_peak(F.col("x")), 5).alias("dbtp"))


def band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", F.round(rates.band_share(F.col("x"), F.lit(FS), *BAND), 6).alias("share"))


def analytic_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrum of each signal's analytic envelope without its mean."""
    e = _signals(spark, sf_dir).select("vec_id", rates.analytic(F.col("x")).alias("e"))
    return e.select("vec_id", F.posexplode(A.magnitudes(F.col("e"), N)).alias("k", "mag")).select("vec_id", "k", F.round("mag", 5).alias("mag"))


def _filter(up: int, down: int, length: int) -> str:
    h = rates.taps(up, down)
    n = -(-length * up // down)
    values = ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(h.tolist()))
    return f""", h AS (SELECT * FROM (VALUES {values}) h(j, c)),
y AS (SELECT vec_id, n, sum(v * c) AS v FROM v, (SELECT unnest(range({n})) AS n) JOIN h ON h.j = n * {down} - v.i * {up} + {len(h) // 2} GROUP BY 1, 2)"""


SQL = {
    "resampled": _S + _filter(*rates.ratio(FROM, TO), N) + " SELECT vec_id, n::INTEGER AS i, round(v, 6) AS v FROM y",
    "true_peak": _S + _filter(rates.OVER, 1, N) + " SELECT vec_id, round(20 * log10(greatest(max(abs(v)), (SELECT max(abs(o.v)) FROM v o WHERE o.vec_id = y.vec_id))), 5) AS dbtp FROM y GROUP BY vec_id",
    "band_energy": _S + f""", c AS (SELECT vec_id, i, (v - avg(v) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS v FROM v),
p AS (SELECT vec_id, k, power(sum(v * cos(2 * pi() * k * i / 64)), 2) + power(sum(v * sin(2 * pi() * k * i / 64)), 2) AS p FROM c, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2)
SELECT vec_id, round(sum(CASE WHEN k * {FS} / 64 BETWEEN {BAND[0]} AND {BAND[1]} THEN p ELSE 0 END) / sum(p), 6) AS share FROM p GROUP BY 1""",
    "analytic_envelope": _S + """, q AS (SELECT a.vec_id, a.i, sum(CASE WHEN (a.i - b.i) % 2 <> 0 THEN b.v / 32 / tan(pi() * (a.i - b.i) / 64) ELSE 0 END) AS h FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2),
m AS (SELECT vec_id, i, sqrt(v * v + h * h) AS e FROM v JOIN q USING (vec_id, i)), z AS (SELECT vec_id, i, e - avg(e) OVER (PARTITION BY vec_id) AS v FROM m)
SELECT vec_id, k::INTEGER AS k, round(sqrt(power(sum(v * cos(2 * pi() * k * i / 64)), 2) + power(sum(v * sin(2 * pi() * k * i / 64)), 2)), 5) AS mag FROM z, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2""",
}
QUERIES = {f.__name__: f for f in (resampled, true_peak, band_energy, analytic_envelope)}
