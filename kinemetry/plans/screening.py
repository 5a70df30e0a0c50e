"""Screening without a baseline, physical severity, and how axes explain each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinemetry.functions import arrays as A
from kinemetry.operators import baseline, relations, screen, severity
from kinemetry.plans.ingest import _MS, _mean_spectra
from kinemetry.plans.learning import LEARN, VECTORS, _machine_windows, _windows
from kinemetry.sources.readings import table

#: Peaks of a spectrum, hertz between them, blades of a wheel.
PEAKS, APART, BLADES = 6, 3, (2, 3, 4, 5)
BAND = (3000.0, 6000.0)


def screen_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest combs of recordings that VECTORS embeddings in a row make at 16 kHz; an unfinished last one is left out."""
    e = table(spark, sf_dir, "embeddings").withColumn("id", F.floor(F.col("vec_id") / VECTORS))
    rows = e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v")).where(F.size("v") == VECTORS)
    found = screen.screen(rows.select("id", F.flatten("v.embedding").cast("array<double>").alias("audio"), F.lit(16000.0).alias("fs")))
    each = found.select("id", "low", "degenerate", F.posexplode("peaks").alias("place", "p"))
    return each.select("id", F.round("low", 4).alias("band_low"), "degenerate", "place", F.round("p.f0", 6).alias("f0"), F.round("p.score", 5).alias("score"), "p.flag")


def blade_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loudest lines of each label's mean spectrum, at least APART hertz from louder ones, and the speeds that they mean
    for each number of blades; lines near the mains say so."""
    lines = _mean_spectra(spark, sf_dir).groupBy("label").agg(F.sort_array(F.collect_list(F.struct((-F.round("mag", 9)).alias("less"), "k"))).alias("lines"))  # a spectrum of 32
    best = screen.chosen(F.col("lines"), lambda a, b: F.abs(a["k"] - b["k"]) < APART, PEAKS)
    each = lines.select("label", F.posexplode(best).alias("place", "p")).select("label", "place", F.col("p.k").alias("k"), F.explode(F.array(*map(F.lit, BLADES))).alias("blades"))
    return each.select("label", "place", "k", "blades", F.round(60.0 * F.col("k") / F.col("blades"), 6).alias("rpm"), A.mains_related(F.col("k").cast("double")).alias("mains"))


def physical_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and envelope lines of each machine's windows in one band, and their energy over that of its learn windows."""
    w = _machine_windows(spark, sf_dir)
    made = w.select("device", "window", "nth", severity.physical(F.col("audio"), F.col("fs_audio"), F.lit(BAND[0]), F.lit(BAND[1])).alias("s")).select("device", "window", "nth", "s.*")
    told = severity.relative(made, "device", F.col("nth") < LEARN)
    return told.select("device", "window", *[F.round(c, 5).alias(c) for c in (*severity.PARTS, "db_re_learn")])


def relative_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of each signal in dB over the median of its label's first LEARN signals."""
    w = _windows(spark, sf_dir)
    e = w.select("vec_id", "label", F.log10(A.total(F.transform("x", lambda v: v * v)) + 1e-12).alias("e"))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return severity.relative(e, "label", F.col("n") <= LEARN, "e").select("vec_id", F.round("db_re_learn", 5).alias("db"))


def corr_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of every two components of each label's vectors."""
    r = relations.correlations(baseline.learn(_windows(spark, sf_dir), "label", shrunk=False), "label")
    return r.select("label", "i", "j", F.round("r", 6).alias("r"))


def axis_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each component follows from the two after it (in a ring), by least squares."""
    m = baseline.learn(_windows(spark, sf_dir), "label", shrunk=False)
    n = 64
    r = relations.explained(m, "label", [(i, ((i + 1) % n, (i + 2) % n)) for i in range(n)])
    return r.select("label", "i", F.round("r2", 5).alias("r2"))


def _peaks_sql() -> str:
    steps, taken = [], "SELECT NULL::BIGINT AS label, NULL::BIGINT AS k, NULL::INTEGER AS place WHERE false"
    for i in range(PEAKS):
        steps.append(f"t{i} AS MATERIALIZED ({taken})")
        taken = (f"SELECT label, k, place FROM t{i} UNION ALL SELECT label, arg_max(k, (round(mag, 9), -k)), {i} FROM a WHERE NOT EXISTS (SELECT 1 FROM t{i} t WHERE t.label = a.label AND abs(t.k - a.k) < {APART}) GROUP BY label")
    return _MS + ", " + ", ".join(steps) + f""", t AS ({taken})
SELECT label::INTEGER AS label, place, k::INTEGER AS k, b::INTEGER AS blades, round(60.0 * k / b, 6) AS rpm, EXISTS (SELECT 1 FROM range(1, 9) q(q) WHERE abs(k - q * 50.0) <= 1.5 OR q >= 2 AND abs(q * k - 50.0) <= 1.5) AS mains FROM t, (SELECT unnest({list(BLADES)}) AS b)"""


_E = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), v AS (SELECT vec_id, label, i, x[i + 1] AS v FROM (SELECT vec_id, label, x, unnest(range(64)) AS i FROM e))"
SQL = {
    "blade_peaks": _peaks_sql(),
    "relative_severity": _E + f""", q AS (SELECT vec_id, label, log10(sum(v * v) + 1e-12) AS e FROM v GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM q),
m AS (SELECT label, quantile_cont(e, 0.5) AS mid FROM n WHERE n <= {LEARN} GROUP BY 1) SELECT vec_id, round(10 * (e - mid), 5) AS db FROM q JOIN m USING (label)""",
    "corr_axes": _E + " SELECT a.label, a.i::INTEGER AS i, b.i::INTEGER AS j, round(corr(a.v, b.v), 6) AS r FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2, 3",
    "axis_r2": _E + """, c AS (SELECT a.label, a.i, corr(a.v, b.v) AS ab, corr(a.v, c.v) AS ac, corr(b.v, c.v) AS bc FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 64 JOIN v c ON a.vec_id = c.vec_id AND c.i = (a.i + 2) % 64 GROUP BY 1, 2)
SELECT label, i::INTEGER AS i, round((ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc), 5) AS r2 FROM c""",
}
QUERIES = {f.__name__: f for f in (screen_peaks, blade_peaks, physical_severity, relative_severity, corr_axes, axis_r2)}
