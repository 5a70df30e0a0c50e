"""Signal, composition and spectrum queries: an embedding stands for a signal of 64 samples at 64 Hz."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinemetry.functions import arrays as A
from kinemetry.sources.readings import table

N = 64


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight parts per vector: the absolute sums of its eight blocks of eight."""
    part = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: A.total(F.transform(F.slice("x", k * 8 + 1, 8), lambda v: F.abs(v))))
    return _signals(spark, sf_dir).select("vec_id", part.alias("parts"))


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, k, mag), bins 0 to 32."""
    return _signals(spark, sf_dir).select("vec_id", "label", F.posexplode(A.magnitudes(F.col("x"), N)).alias("k", "mag"))


def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 rms, excess kurtosis, crest factor and skewness of each signal without its mean."""
    v = _signals(spark, sf_dir).select("vec_id", F.explode("x").alias("v"))
    rms = F.stddev_pop("v")
    top = F.greatest(F.max("v") - F.avg("v"), F.avg("v") - F.min("v"))
    return v.groupBy("vec_id").agg(F.round(F.log10(rms), 6).alias("log_rms"), F.round(F.kurtosis("v"), 6).alias("kurtosis"), F.round(top / rms, 6).alias("crest"), F.round(F.skewness("v"), 6).alias("skew"))


def dc_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("vec_id", F.round(A.mean(F.col("x")), 6).alias("dc"))


def clip_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of samples at full scale, and at the signal's own peak."""
    return _signals(spark, sf_dir).select("vec_id", F.round(A.clipped(F.col("x"), True), 6).alias("at_full_scale"), F.round(A.clipped(F.col("x"), False), 6).alias("clipped"))


def flat_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that both lie within a thousandth of the peak and differ by a millionth of it at most."""
    flat = A.bound(F.array_max(F.transform("x", lambda v: F.abs(v))), lambda p: F.filter(
        F.zip_with(F.slice("x", 1, N - 1), F.slice("x", 2, N - 1), lambda a, b: (F.least(F.abs(a), F.abs(b)) >= 0.999 * p) & (F.abs(a - b) <= 1e-6 * p)), lambda f: f))
    return _signals(spark, sf_dir).select("vec_id", F.size(flat).cast("long").alias("flat"))


def level_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of every hop of eight samples in dB."""
    v = _signals(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v"))
    return v.groupBy("vec_id", F.floor(F.col("i") / 8).alias("hop")).agg(F.round(20 * F.log10(F.greatest(F.stddev_pop("v"), F.lit(1e-12))), 5).alias("db"))


def clr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("vec_id", F.posexplode(A.clr(F.col("parts"))).alias("i", "y")).select("vec_id", "i", F.round("y", 6).alias("y"))


def ilr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("vec_id", F.posexplode(A.ilr(F.col("parts"), 8)).alias("i", "y")).select("vec_id", "i", F.round("y", 6).alias("y"))


def ilr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composition again from its coordinates."""
    y = _parts(spark, sf_dir).select("vec_id", A.ilr(F.col("parts"), 8).alias("y"))
    return y.select("vec_id", F.posexplode(A.ilr_inverse(F.col("y"), 8)).alias("i", "p")).select("vec_id", "i", F.round("p", 6).alias("p"))


def dft_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(spark, sf_dir).select("vec_id", "k", F.round("mag", 6).alias("mag"))


def spectral_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crest (peak over median) and the loudest bin above zero."""
    s = _spectrum(spark, sf_dir).where("k > 0")
    return s.groupBy("vec_id").agg(F.round(F.max("mag") / (F.percentile("mag", F.lit(0.5)) + 1e-12), 5).alias("crest"), F.max_by("k", F.struct("mag", -F.col("k"))).cast("long").alias("peak_k"))


def band_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy shares of the bands that begin at these bins."""
    edges = [1, 2, 4, 7, 11, 16, 22, 28, 33]
    s = _spectrum(spark, sf_dir).withColumn("e", F.col("mag") * F.col("mag")).where("k > 0")
    whole = F.sum("e") + 1e-12
    return s.groupBy("vec_id").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("k").between(a, b - 1), F.col("e"))), F.lit(0.0)) / whole, 6).alias(f"b{i}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def avg_spectrum_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(spark, sf_dir).groupBy("label", "k").agg(F.round(F.avg("mag"), 6).alias("mag"))


def comb_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comb scores of the mean spectra: candidates, harmonics and bins within one bin meet on the bin's
    number, so the range join is an equi-join; a candidate needs three harmonics."""
    s = _spectrum(spark, sf_dir).where("k > 0").groupBy("label", "k").agg(F.avg("mag").alias("mag"))
    middle = s.groupBy("label").agg(F.percentile("mag", F.lit(0.5)).alias("mid"))
    near = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda h: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.struct(h.alias("h"), (F.col("f0") * h + d).alias("k"))))))
    grid = s.where("k between 3 and 12").select("label", F.col("k").alias("f0")).select("label", "f0", near.alias("n")).select("label", "f0", "n.h", "n.k")
    tops = grid.join(s, ["label", "k"]).groupBy("label", "f0", "h").agg(F.max("mag").alias("top"))
    return (tops.join(middle, "label").groupBy("label", "f0").agg(F.count("*").alias("harmonics"), F.avg(F.col("top") / F.col("mid")).alias("comb"))
            .select("label", F.col("f0").cast("long").alias("f0"), "harmonics", F.round(F.when(F.col("harmonics") >= 3, F.col("comb")).otherwise(0.0), 5).alias("score")))


def peak_to_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak near bin 10 over the median of what lies outside the guard bands of multiples of 7."""
    s = _spectrum(spark, sf_dir).where("k > 0")
    guard = s.sparkSession.range(1, 5).select((F.col("id") * 7).alias("g"))
    clear = s.join(F.broadcast(guard), F.abs(F.col("k") - F.col("g")) <= 1, "left_anti")  # four rows
    return clear.groupBy("vec_id").agg(F.round(F.max(F.when(F.col("k").between(9, 11), F.col("mag"))) / F.percentile("mag", F.lit(0.5)), 5).alias("ratio"))


def bearing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fault frequencies of every bearing at the shaft rates 25 and 50 Hz, with mains coincidences."""
    b = spark.createDataFrame(A.BEARINGS, "bearing string, n int, ball double, pitch double").withColumn("fr", F.explode(F.array(F.lit(25.0), F.lit(50.0))))
    f = A.fault_frequencies(F.col("n"), F.col("ball"), F.col("pitch"), F.col("fr"))
    return b.select("bearing", "fr", *[F.round(v, 6).alias(k) for k, v in f.items()], A.mains_related(f["bpfo"]).alias("mains"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = _points(spark, sf_dir)
    return op.groupBy("label").agg(*[F.round(F.avg(c), 6).alias(c) for c in "abc"], F.count("*").alias("n"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operating points: mean, deviation and peak of each signal, standardised over all."""
    v = _signals(spark, sf_dir).select("vec_id", "label", F.explode("x").alias("v"))
    p = v.groupBy("vec_id", "label").agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("b"), F.max("v").alias("c"))
    scale = p.agg(*[f(c).alias(f"{c}_{n}") for c in "abc" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    both = p.join(F.broadcast(scale))  # one row
    return both.select("vec_id", "label", *[((F.col(c) - F.col(f"{c}_m")) / (F.col(f"{c}_s") + 1e-9)).alias(c) for c in "abc"])


def nearest_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime whose centre is nearest to each point: the centres travel as one array, so the search
    is an expression per row."""
    p = _points(spark, sf_dir)
    centres = p.groupBy("label").agg(*[F.avg(c).alias(c) for c in "abc"]).agg(F.sort_array(F.collect_list(F.struct("label", "a", "b", "c"))).alias("centres"))

    def far(x: Column) -> Column:
        return F.pow(F.col("a") - x["a"], 2) + F.pow(F.col("b") - x["b"], 2) + F.pow(F.col("c") - x["c"], 2)

    both = p.join(F.broadcast(centres))  # one row, of as many centres as there are regimes
    best = F.array_min(F.transform("centres", lambda x: F.struct(far(x).alias("d"), x["label"].alias("regime"))))
    return both.select("vec_id", best.alias("x")).select("vec_id", F.col("x.regime").alias("regime"), F.round(F.sqrt("x.d"), 5).alias("distance"))


def centroid_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _points(spark, sf_dir).groupBy("label").agg(*[F.avg(x).alias(x) for x in "abc"])
    two = c.alias("p").join(c.alias("q"), F.expr("p.label < q.label"))
    d = F.sqrt(sum((F.pow(F.col(f"p.{x}") - F.col(f"q.{x}"), 2) for x in "abc"), F.lit(0.0)))
    return two.agg(F.round(F.min(d), 5).alias("separation"))


_S = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), v AS (SELECT vec_id, label, i, x[i + 1] AS v FROM (SELECT vec_id, label, x, unnest(range(64)) AS i FROM e))"
_SP = _S + """, c AS (SELECT vec_id, label, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM v),
s AS (SELECT vec_id, label, k, sqrt(power(sum(v * cos(2 * pi() * k * i / 64)), 2) + power(sum(v * sin(2 * pi() * k * i / 64)), 2)) AS mag FROM c, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2, 3)"""
_P = _S + """, b AS (SELECT vec_id, i // 8 AS j, greatest(sum(abs(v)), 1e-9) AS p FROM v GROUP BY 1, 2), z AS (SELECT vec_id, j, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM b), l AS (SELECT vec_id, j, p, ln(p) AS l FROM z)"""
_O = _S + """, p0 AS (SELECT vec_id, label, avg(v) AS a, stddev_pop(v) AS b, max(v) AS c FROM v GROUP BY 1, 2),
p AS (SELECT vec_id, label, (a - avg(a) OVER ()) / (stddev_pop(a) OVER () + 1e-9) AS a, (b - avg(b) OVER ()) / (stddev_pop(b) OVER () + 1e-9) AS b, (c - avg(c) OVER ()) / (stddev_pop(c) OVER () + 1e-9) AS c FROM p0),
m AS (SELECT label, avg(a) AS a, avg(b) AS b, avg(c) AS c, count(*) AS n FROM p GROUP BY 1)"""
_EDGES = [1, 2, 4, 7, 11, 16, 22, 28, 33]
SQL = {
    "channel_stats": _S + """, m AS (SELECT *, v - avg(v) OVER (PARTITION BY vec_id) AS w FROM v) SELECT vec_id, round(log10(sqrt(avg(w * w))), 6) AS log_rms, round(avg(power(w, 4)) / power(avg(w * w), 2) - 3, 6) AS kurtosis,
  round(max(abs(w)) / sqrt(avg(w * w)), 6) AS crest, round(avg(power(w, 3)) / power(avg(w * w), 1.5), 6) AS skew FROM m GROUP BY 1""",
    "dc_level": _S + " SELECT vec_id, round(avg(v), 6) AS dc FROM v GROUP BY 1",
    "clip_fraction": _S + """, p AS (SELECT *, max(abs(v)) OVER (PARTITION BY vec_id) AS peak FROM v)
SELECT vec_id, round(avg(CASE WHEN abs(v) >= 0.999 THEN 1 ELSE 0 END), 6) AS at_full_scale, round(avg(CASE WHEN peak > 0 AND abs(v) >= peak * (1 - 1e-9) THEN 1 ELSE 0 END), 6) AS clipped FROM p GROUP BY 1""",
    "flat_top": _S + """, p AS (SELECT *, max(abs(v)) OVER (PARTITION BY vec_id) AS peak, lead(v) OVER (PARTITION BY vec_id ORDER BY i) AS w FROM v)
SELECT vec_id, count(CASE WHEN least(abs(v), abs(w)) >= 0.999 * peak AND abs(v - w) <= 1e-6 * peak THEN 1 END) AS flat FROM p WHERE w IS NOT NULL GROUP BY 1""",
    "level_envelope": _S + " SELECT vec_id, (i // 8)::BIGINT AS hop, round(20 * log10(greatest(stddev_pop(v), 1e-12)), 5) AS db FROM v GROUP BY 1, 2",
    "clr": _P + " SELECT vec_id, j::INTEGER AS i, round(l - avg(l) OVER (PARTITION BY vec_id), 6) AS y FROM l",
    "ilr": _P + " SELECT vec_id, (j - 1)::INTEGER AS i, round(sqrt(j / (j + 1.0)) * (m - l), 6) AS y FROM (SELECT *, avg(l) OVER (PARTITION BY vec_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM l) WHERE j > 0",
    "ilr_roundtrip": _P + " SELECT vec_id, j::INTEGER AS i, round(p, 6) AS p FROM l",
    "dft_spectrum": _SP + " SELECT vec_id, k::INTEGER AS k, round(mag, 6) AS mag FROM s",
    "spectral_peak": _SP + " SELECT vec_id, round(max(mag) / (quantile_cont(mag, 0.5) + 1e-12), 5) AS crest, arg_max(k, mag)::BIGINT AS peak_k FROM s WHERE k > 0 GROUP BY 1",
    "band_fractions": _SP + " SELECT vec_id, " + ", ".join(f"round(sum(CASE WHEN k BETWEEN {a} AND {b - 1} THEN mag * mag ELSE 0 END) / (sum(mag * mag) + 1e-12), 6) AS b{i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:], strict=False))) + " FROM s WHERE k > 0 GROUP BY 1",
    "avg_spectrum_by_label": _SP + " SELECT label, k::INTEGER AS k, round(avg(mag), 6) AS mag FROM s GROUP BY 1, 2",
    "comb_screen": _SP + """, a AS (SELECT label, k, avg(mag) AS mag FROM s WHERE k > 0 GROUP BY 1, 2), mid AS (SELECT label, quantile_cont(mag, 0.5) AS mid FROM a GROUP BY 1),
t AS (SELECT c.label, c.k AS f0, h, max(a.mag) AS top FROM a c, (VALUES (1), (2), (3), (4), (5)) q(h), a WHERE c.k BETWEEN 3 AND 12 AND a.label = c.label AND abs(a.k - c.k * h) <= 1 GROUP BY 1, 2, 3)
SELECT label, f0::BIGINT AS f0, count(*) AS harmonics, round(CASE WHEN count(*) >= 3 THEN avg(top / mid) ELSE 0.0 END, 5) AS score FROM t JOIN mid USING (label) GROUP BY 1, 2""",
    "peak_to_background": _SP + " SELECT vec_id, round(max(CASE WHEN k BETWEEN 9 AND 11 THEN mag END) / quantile_cont(mag, 0.5), 5) AS ratio FROM s WHERE k > 0 AND NOT EXISTS (SELECT 1 FROM (VALUES (7), (14), (21), (28)) g(g) WHERE abs(k - g) <= 1) GROUP BY 1",
    "bearing_table": "WITH b AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}, {d}::DOUBLE, {p}::DOUBLE)" for n, k, d, p in A.BEARINGS) + """) t(bearing, n, ball, pitch), (VALUES (25.0::DOUBLE), (50.0::DOUBLE)) f(fr)),
f AS (SELECT *, n * fr / 2 * (1 - ball / pitch) AS o FROM b) SELECT bearing, fr, round(fr / 2 * (1 - ball / pitch), 6) AS ftf, round(o, 6) AS bpfo, round(n * fr / 2 * (1 + ball / pitch), 6) AS bpfi,
  round(pitch / (2 * ball) * fr * (1 - ball / pitch * ball / pitch), 6) AS bsf, round(pitch / ball * fr * (1 - ball / pitch * ball / pitch), 6) AS bsf_2x,
  EXISTS (SELECT 1 FROM range(1, 9) k(k) WHERE abs(o - k * 50.0) <= 1.5 OR k >= 2 AND abs(k * o - 50.0) <= 1.5) AS mains FROM f""",
    "centroids": _O + " SELECT label, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, n FROM m",
    "nearest_regime": _O + """ SELECT vec_id, regime, round(sqrt(d), 5) AS distance FROM (SELECT vec_id, m.label AS regime, power(p.a - m.a, 2) + power(p.b - m.b, 2) + power(p.c - m.c, 2) AS d FROM p, m)
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, regime) = 1""",
    "centroid_separation": _O + " SELECT round(min(sqrt(power(p.a - q.a, 2) + power(p.b - q.b, 2) + power(p.c - q.c, 2))), 5) AS separation FROM m p JOIN m q ON p.label < q.label",
}
QUERIES = {f.__name__: f for f in (channel_stats, dc_level, clip_fraction, flat_top, level_envelope, clr, ilr, ilr_roundtrip, dft_spectrum, spectral_peak, band_fractions, avg_spectrum_by_label, comb_screen,
                                   peak_to_background, bearing_table, centroids, nearest_regime, centroid_separation)}
