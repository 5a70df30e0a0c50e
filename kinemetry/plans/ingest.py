"""Audits, preparation and screening of signals: an embedding stands for a signal of 64 samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinemetry.functions import arrays as A
from kinemetry.functions import audit
from kinemetry.plans.spectral import _S, _SP, N, _signals, _spectrum
from kinemetry.sources.readings import table

#: Frames of the short spectra, and Mel bands over them at 64 samples a second.
FRAME, HOP, BANDS = 32, 16, 8


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, peak, rms, dc, clipped, finite, fs), where fs grows with the label."""
    x = F.col("x")
    ok = ~F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return _signals(spark, sf_dir).select(
        "vec_id", "label", F.array_max(F.transform(x, lambda v: F.abs(v))).alias("peak"), F.sqrt(A.total(F.transform(x, lambda v: v * v)) / F.size(x)).alias("rms"), A.mean(x).alias("dc"),
        A.clipped(x, True).alias("clipped"), ok.alias("finite"), (4000.0 + 2000 * F.col("label")).alias("fs"))


def audio_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _levels(spark, sf_dir)
    found = audit.audio(*[F.col(c) for c in ("peak", "rms", "dc", "clipped", "finite", "fs")], 16000.0, True)
    return v.select("vec_id", found.alias("found")).select("vec_id", F.concat_ws(",", F.transform("found", lambda f: f["kind"])).alias("kinds"), audit.worst(F.col("found")).alias("worst"))


def accel_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three axes that take turns at the samples; gravity, dead axes and clock jitter."""
    def axis(a: int) -> Column:
        return F.filter("x", lambda v, i: i % 3 == a)

    axes = [axis(a) for a in range(3)]
    means = F.array(*[A.bound(a, A.mean) for a in axes])
    spread = F.array(*[A.bound(a, lambda x: F.array_max(x) - F.array_min(x)) for a in axes])
    found = audit.acceleration(means, spread, F.when(F.col("label") % 2 == 0, F.col("label") / 20.0))
    return _signals(spark, sf_dir).select("vec_id", F.concat_ws(",", F.transform(found, lambda f: f["kind"])).alias("kinds"))


def gain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal's own gain, and the common one of its batch, which keeps relative levels; peaks meet in one row a batch."""
    v = _levels(spark, sf_dir).select("vec_id", "label", "peak")
    top = v.groupBy("label").agg(F.max("peak").alias("top"))
    return v.join(top, "label").select("vec_id", *[F.round(audit.gain(F.col(c), n), 6).alias(f"{name}{'_normalised' if n else ''}") for c, name in (("peak", "own"), ("top", "common")) for n in (False, True)])


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels of 32 samples mixed down, trimmed to half their length from a quarter on, without their mean."""
    mono = F.zip_with(F.slice("x", 1, 32), F.slice("x", 33, 32), lambda a, b: (a + b) / 2)
    return _signals(spark, sf_dir).select("vec_id", F.posexplode(A.centred(F.slice(mono, 9, 16))).alias("i", "v")).select("vec_id", "i", F.round("v", 6).alias("v"))


def signal_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level in dBFS, the noise floor (median level of frames of eight), and the loudest line of the Hann-windowed
    spectrum, between bins by the parabola through its neighbours' logarithms."""
    x = F.col("x")
    mag = A.magnitudes(x, N, window=True)
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.sqrt(A.total(F.transform(F.slice("x", k * 8 + 1, 8), lambda v: v * v)) / 8))
    db = lambda c: 20 * F.log10(F.greatest(c, F.lit(1e-12)))
    s = _signals(spark, sf_dir).select("vec_id", F.sqrt(A.total(F.transform(x, lambda v: v * v)) / N).alias("rms"), F.sort_array(frames).alias("frames"), mag.alias("m"))
    s = s.withColumn("k", F.expr("array_max(transform(sequence(1, 31), k -> struct(round(m[k], 9) as v, -k as n))).n * -1"))
    log = lambda d: F.log(F.expr(f"m[k + {d}]") + 1e-20)
    s = s.select("*", log(-1).alias("a"), log(0).alias("b"), log(1).alias("c"))
    bend = F.col("a") - 2 * F.col("b") + F.col("c")
    shift = F.when(F.abs(bend) > 1e-30, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("a") - F.col("c")) / bend))).otherwise(0.0)
    return s.select("vec_id", F.round(db(F.col("rms")), 5).alias("dbfs"), F.round(db((F.col("frames")[3] + F.col("frames")[4]) / 2), 5).alias("floor_dbfs"), F.round(F.col("k") + shift, 5).alias("peak_hz"))


def agc_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the level falls with distance: median of the first third of hops less that of the last, of 12.04 dB expected."""
    v = _signals(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "v"))
    hops = v.groupBy("vec_id", F.floor(F.col("i") / 8).alias("hop")).agg((20 * F.log10(F.greatest(F.stddev_pop("v"), F.lit(1e-12)))).alias("db"))
    third = lambda c: F.percentile(F.when(c, F.col("db")), F.lit(0.5))
    d = hops.groupBy("vec_id").agg((third(F.col("hop") < 2) - third(F.col("hop") >= 6)).alias("drop"))
    return d.select("vec_id", F.round("drop", 5).alias("drop_db"), F.when(F.col("drop") >= 8, "none").when(F.col("drop") >= 4, "some").otherwise("agc").alias("agc"))


def mel_bank(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """(m, k, w): triangular Mel filters over the bins of a frame, each side at least a bin wide."""
    top = 2595.0 * math.log10(1 + N / 2 / 700.0)
    edge = lambda d: F.floor((FRAME + 1) * A.hertz((F.col("m") + d) * (top / (BANDS + 1))) / N)
    m = spark.range(BANDS).select(F.col("id").alias("m")).select("m", edge(0).alias("l"), edge(1).alias("c"), edge(2).alias("r"))
    m = m.withColumn("c", F.greatest("c", F.col("l") + 1)).withColumn("r", F.greatest("r", F.col("c") + 1))
    k = F.col("k")
    w = F.when(k < F.col("c"), (k - F.col("l")) / (F.col("c") - F.col("l"))).otherwise((F.col("r") - k) / (F.col("r") - F.col("c")))
    return m.select("*", F.explode(F.expr(f"sequence(l, least(r - 1, {FRAME // 2}))")).alias("k")).select("m", "k", w.alias("w")).where("w > 0").select("m", "k", F.round("w", 9).alias("w"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _signals(spark, sf_dir).select("vec_id", F.posexplode(A.short_spectra(F.col("x"), N, FRAME, HOP)).alias("frame", "mags"))
    return f.select("vec_id", "frame", F.posexplode("mags").alias("k", "mag"))


def short_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("vec_id", "frame", "k", F.round("mag", 6).alias("mag"))


def _mels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter bank has a fixed size; frames stay where they are."""
    m = _frames(spark, sf_dir).join(F.broadcast(mel_bank(spark)), "k").groupBy("vec_id", "frame", "m").agg(F.log1p(F.sum(F.col("w") * F.col("mag"))).alias("mel"))
    return m


def log_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the frames of the logarithmic Mel spectrum."""
    return _mels(spark, sf_dir).groupBy("vec_id", "m").agg(F.round(F.avg("mel"), 6).alias("mel"))


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mel frames scaled to 0 to 1 by the least and greatest of all."""
    m = _mels(spark, sf_dir)
    ends = m.agg(F.min("mel").alias("a"), F.max("mel").alias("z"))
    return m.join(F.broadcast(ends)).select("vec_id", "frame", "m", F.round((F.col("mel") - F.col("a")) / (F.col("z") - F.col("a")), 5).alias("shade"))  # one row


def scaled_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of 32 samples every 16, scaled by the first and 99th percentile of their label and clipped to 0 to 1."""
    s = _signals(spark, sf_dir)
    ends = s.select("label", F.explode("x").alias("v")).groupBy("label").agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    p = s.join(ends, "label").select("vec_id", "p", F.posexplode(F.expr("transform(sequence(1, 33, 16), s -> slice(x, s, 32))")).alias("patch", "v"))
    scale = F.transform("v", lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.col("p")[0]) / (F.col("p")[1] - F.col("p")[0] + 1e-9))))
    return p.select("vec_id", "patch", F.round(A.bound(scale, A.mean), 6).alias("mean"))


def faded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of each signal with raised-cosine ends of eight samples, and how much of it the fade took."""
    ramp = [0.5 - 0.5 * math.cos(math.pi * i / 8) for i in range(8)]
    w = F.array(*map(F.lit, ramp + [1.0] * (N - 16) + ramp[::-1]))
    energy = lambda x: A.total(F.transform(x, lambda v: v * v))
    s = _signals(spark, sf_dir).select("vec_id", energy(F.col("x")).alias("whole"), energy(F.zip_with("x", w, lambda a, b: a * b)).alias("kept"))
    return s.select("vec_id", F.round("kept", 5).alias("energy"), F.round(1 - F.col("kept") / F.col("whole"), 6).alias("lost"))


def _mean_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(spark, sf_dir).where("k > 0").groupBy("label", "k").agg(F.avg("mag").alias("mag"))


def dominant_comb_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one line on which each comb candidate of a mean spectrum mostly rests: the loudest within a bin of its harmonics."""
    s = _mean_spectra(spark, sf_dir)
    near = F.explode(F.expr("flatten(transform(sequence(1, 5), h -> transform(sequence(-1, 1), d -> f0 * h + d)))"))
    grid = s.where("k between 3 and 12").select("label", F.col("k").alias("f0")).select("label", "f0", near.alias("k")).distinct()
    return grid.join(s, ["label", "k"]).groupBy("label", "f0").agg(F.max_by("k", F.struct(F.round("mag", 9), -F.col("k"))).alias("k"))


def comb_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that say the same as a stronger one: they rest on its line or are its multiple or part."""
    d = dominant_comb_bin(spark, sf_dir)
    a, b = d.alias("a"), d.alias("b")
    both = a.join(b, F.expr("a.label = b.label and a.f0 <> b.f0"))  # candidates of a spectrum are ten
    alias = (F.col("a.k") == F.col("b.k")) | A.ratio_alias(F.col("a.f0") * 1.0, F.col("b.f0") * 1.0)
    return both.groupBy("a.label", "a.f0").agg(F.sum(alias.cast("long")).alias("aliases"))


def pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording (label) of an odd number against the one before it, bin by bin: where it is more than 3 dB louder."""
    s = _mean_spectra(spark, sf_dir).withColumn("pair", F.floor(F.col("label") / 2))
    side = lambda odd, name: s.where(F.col("label") % 2 == odd).select("pair", "k", F.col("mag").alias(name))
    both = side(0, "healthy").join(side(1, "faulty"), ["pair", "k"])
    db = 20 * F.log10(F.col("faulty") / F.col("healthy"))
    return both.select("pair", "k", F.round(db, 5).alias("db"), F.when(db > 3, "raised").when(db < -3, "lowered").otherwise("inconclusive").alias("verdict"))


def race_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label and bearing at 5 Hz: the loudest line within a bin of its outer, inner and ball frequencies over the median of the mean spectrum."""
    s = _mean_spectra(spark, sf_dir)
    mid = s.groupBy("label").agg(F.percentile("mag", F.lit(0.5)).alias("mid"))  # 32 lines
    f = A.fault_frequencies(F.col("n"), F.col("ball"), F.col("pitch"), F.lit(5.0))
    races = F.explode(F.array(*[F.struct(F.lit(k).alias("race"), f[k].alias("f")) for k in ("bpfo", "bpfi", "bsf_2x")]))
    b = spark.createDataFrame(A.BEARINGS, "bearing string, n int, ball double, pitch double").select("bearing", races.alias("r")).select("bearing", "r.race", "r.f")
    near = b.withColumn("k", F.explode(F.expr("sequence(cast(ceil(f - 1) as int), cast(floor(f + 1) as int))")))
    top = s.join(F.broadcast(near), "k").groupBy("label", "bearing", "race").agg(F.max("mag").alias("top"))  # a few lines of each bearing of the list
    return top.join(mid, "label").select("label", "bearing", "race", F.round(F.col("top") / F.col("mid"), 5).alias("ratio"))


def blade_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds that the loudest line of each label's mean spectrum means for two to five blades; lines near the mains say so."""
    s = _mean_spectra(spark, sf_dir).groupBy("label").agg(F.max_by("k", F.struct(F.round("mag", 9), -F.col("k"))).alias("k"))
    return s.select("label", "k", F.explode(F.array(*map(F.lit, range(2, 6)))).alias("blades")).select(
        "label", "blades", F.round(60.0 * F.col("k") / F.col("blades"), 6).alias("rpm"), A.mains_related(F.col("k").cast("double")).alias("mains"))


def labelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files classed by their names (unknown ones as faulty), a manifest's label first: pages stand for files, labels for the manifest."""
    f = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lower(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)).alias("stem"))
    m = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "healthy").when(F.col("quality") == 0, "faulty").alias("told"))
    own = F.when(F.col("stem").rlike("^[0-9]*[02468]$"), "healthy").otherwise("faulty")
    return f.join(m, "id", "left").groupBy(F.coalesce("told", own).alias("label"), F.col("told").isNotNull().alias("by_manifest")).agg(F.count("*").alias("files"))


_LV = _S + ", q AS (SELECT vec_id, any_value(label) AS label, max(abs(v)) AS peak, sqrt(avg(v * v)) AS rms, avg(v) AS dc, avg(CASE WHEN abs(v) >= 0.999 THEN 1 ELSE 0 END) AS clipped, any_value(4000.0 + 2000 * label) AS fs FROM v GROUP BY 1)"
_MS = _SP + ", a AS (SELECT label, k, avg(mag) AS mag FROM s WHERE k > 0 GROUP BY 1, 2)"
_HANN = sum(0.5 - 0.5 * math.cos(2 * math.pi * i / FRAME) for i in range(FRAME))
_FR = _S + f""", w AS (SELECT vec_id, f AS frame, i - {HOP} * f AS j, v * (0.5 - 0.5 * cos(2 * pi() * (i - {HOP} * f) / {FRAME})) / {_HANN!r} AS v FROM v, (SELECT unnest(range(3)) AS f) WHERE i >= {HOP} * f AND i < {HOP} * f + {FRAME}),
fr AS (SELECT vec_id, frame, k, sqrt(power(sum(v * cos(2 * pi() * k * j / {FRAME})), 2) + power(sum(v * sin(2 * pi() * k * j / {FRAME})), 2)) AS mag FROM w, (SELECT unnest(range({FRAME // 2 + 1})) AS k) GROUP BY 1, 2, 3)"""
_MEL = f"""mp AS (SELECT m, floor({FRAME + 1} * 700 * (power(10, (m + 0) * x / 2595) - 1) / {N}) AS l, floor({FRAME + 1} * 700 * (power(10, (m + 1) * x / 2595) - 1) / {N}) AS c0, floor({FRAME + 1} * 700 * (power(10, (m + 2) * x / 2595) - 1) / {N}) AS r0
  FROM (SELECT unnest(range({BANDS})) AS m, 2595 * log10(1 + {N // 2} / 700.0) / {BANDS + 1} AS x)), mq AS (SELECT m, l, greatest(c0, l + 1) AS c, greatest(r0, greatest(c0, l + 1) + 1) AS r FROM mp),
bank AS (SELECT m, k, round(CASE WHEN k < c THEN (k - l) / (c - l) ELSE (r - k) / (r - c) END, 9) AS w FROM mq, (SELECT unnest(range({FRAME // 2 + 1})) AS k) WHERE k >= l AND k < r AND CASE WHEN k < c THEN k > l ELSE true END)"""
_MELS = _FR + ", " + _MEL + ", mel AS (SELECT vec_id, frame, m, ln(1 + sum(w * mag)) AS mel FROM fr JOIN bank USING (k) GROUP BY 1, 2, 3)"
_GRID = _MS + """, d AS (SELECT label, f0, arg_max(k, (round(mag, 9), -k)) AS k FROM (SELECT DISTINCT c.label, c.k AS f0, a.k, a.mag FROM a c, (VALUES (1), (2), (3), (4), (5)) q(h), a WHERE c.k BETWEEN 3 AND 12 AND a.label = c.label AND abs(a.k - c.k * h) <= 1) GROUP BY 1, 2)"""
SQL = {
    "audio_audit": _LV + """ SELECT vec_id, concat_ws(',', CASE WHEN fs / 2 <= 3000 THEN 'no_band' END, CASE WHEN fs / 2 > 3000 AND fs / 2 < 6000 THEN 'part_band' END, CASE WHEN fs < 16000 THEN 'upsampled' END, CASE WHEN clipped > 0.001 THEN 'clipped' END,
  CASE WHEN clipped > 0 AND clipped <= 0.001 THEN 'few_clipped' END, CASE WHEN peak > 0 AND peak < 0.02 THEN 'quiet' END, CASE WHEN rms = 0 THEN 'silent' END, CASE WHEN abs(dc) > 0.01 * greatest(peak, 1e-9) THEN 'dc' END) AS kinds,
  CASE WHEN fs / 2 <= 3000 OR rms = 0 THEN 'blind' WHEN fs / 2 < 6000 OR clipped > 0.001 OR peak > 0 AND peak < 0.02 THEN 'warn' WHEN fs < 16000 OR clipped > 0 OR abs(dc) > 0.01 * greatest(peak, 1e-9) THEN 'info' ELSE 'none' END AS worst FROM q""",
    "accel_audit": _S + """, x AS (SELECT vec_id, label, i % 3 AS a, avg(v) AS m, max(v) - min(v) AS s FROM v GROUP BY 1, 2, 3), y AS (SELECT vec_id, label, sqrt(sum(m * m)) AS g, min(s) AS s FROM x GROUP BY 1, 2)
SELECT vec_id, concat_ws(',', CASE WHEN g NOT BETWEEN 0.7 AND 1.4 THEN 'gravity' END, CASE WHEN g BETWEEN 0.7 AND 1.4 THEN 'gravity_ok' END, CASE WHEN label % 2 = 0 AND label / 20.0 > 0.25 THEN 'jitter' END, CASE WHEN s = 0 THEN 'dead_axis' END) AS kinds FROM y""",
    "gain_plan": _LV + """, t AS (SELECT *, max(peak) OVER (PARTITION BY label) AS top FROM q) SELECT vec_id, round(CASE WHEN peak > 0.999 THEN 0.9 / (peak + 1e-12) ELSE 1 END, 6) AS own, round(0.9 / (peak + 1e-12), 6) AS own_normalised,
  round(CASE WHEN top > 0.999 THEN 0.9 / (top + 1e-12) ELSE 1 END, 6) AS common, round(0.9 / (top + 1e-12), 6) AS common_normalised FROM t""",
    "prepared": _S + ", y AS (SELECT a.vec_id, a.i - 8 AS i, (a.v + b.v) / 2 AS v FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.i = a.i + 32 WHERE a.i BETWEEN 8 AND 23) SELECT vec_id, i::INTEGER AS i, round(v - avg(v) OVER (PARTITION BY vec_id), 6) AS v FROM y",
    "signal_level": _S + """, f AS (SELECT vec_id, i // 8 AS f, sqrt(avg(v * v)) AS r FROM v GROUP BY 1, 2), fl AS (SELECT vec_id, quantile_cont(r, 0.5) AS fl FROM f GROUP BY 1), lv AS (SELECT vec_id, sqrt(avg(v * v)) AS rms FROM v GROUP BY 1),
h AS (SELECT vec_id, i, (v - avg(v) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS v FROM v), hs AS (SELECT vec_id, k, sqrt(power(sum(v * cos(2 * pi() * k * i / 64)), 2) + power(sum(v * sin(2 * pi() * k * i / 64)), 2)) AS mag FROM h, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2),
t AS (SELECT vec_id, arg_max(k, (round(mag, 9), -k)) AS k FROM hs WHERE k BETWEEN 1 AND 31 GROUP BY 1), p AS (SELECT t.vec_id, t.k, ln(a.mag + 1e-20) AS a, ln(b.mag + 1e-20) AS b, ln(c.mag + 1e-20) AS c FROM t JOIN hs a ON a.vec_id = t.vec_id AND a.k = t.k - 1 JOIN hs b ON b.vec_id = t.vec_id AND b.k = t.k JOIN hs c ON c.vec_id = t.vec_id AND c.k = t.k + 1)
SELECT p.vec_id, round(20 * log10(greatest(rms, 1e-12)), 5) AS dbfs, round(20 * log10(greatest(fl, 1e-12)), 5) AS floor_dbfs, round(k + CASE WHEN abs(a - 2 * b + c) > 1e-30 THEN greatest(-0.5, least(0.5, 0.5 * (a - c) / (a - 2 * b + c))) ELSE 0 END, 5) AS peak_hz
FROM p JOIN fl USING (vec_id) JOIN lv USING (vec_id)""",
    "agc_distance": _S + """, h AS (SELECT vec_id, i // 8 AS hop, 20 * log10(greatest(stddev_pop(v), 1e-12)) AS db FROM v GROUP BY 1, 2), d AS (SELECT vec_id, quantile_cont(CASE WHEN hop < 2 THEN db END, 0.5) - quantile_cont(CASE WHEN hop >= 6 THEN db END, 0.5) AS d FROM h GROUP BY 1)
SELECT vec_id, round(d, 5) AS drop_db, CASE WHEN d >= 8 THEN 'none' WHEN d >= 4 THEN 'some' ELSE 'agc' END AS agc FROM d""",
    "mel_bank": "WITH " + _MEL + " SELECT m, k, w FROM bank",
    "short_spectra": _FR + " SELECT vec_id, frame::INTEGER AS frame, k::INTEGER AS k, round(mag, 6) AS mag FROM fr",
    "log_mel": _MELS + " SELECT vec_id, m, round(avg(mel), 6) AS mel FROM mel GROUP BY 1, 2",
    "heatmap": _MELS + " SELECT vec_id, frame::INTEGER AS frame, m, round((mel - min(mel) OVER ()) / (max(mel) OVER () - min(mel) OVER ()), 5) AS shade FROM mel",
    "scaled_patches": _S + """, z AS (SELECT label, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM v GROUP BY 1)
SELECT vec_id, p::INTEGER AS patch, round(avg(least(1.0, greatest(0.0, (v - a) / (b - a + 1e-9)))), 6) AS mean FROM v JOIN z USING (label), (SELECT unnest(range(3)) AS p) WHERE i >= 16 * p AND i < 16 * p + 32 GROUP BY 1, 2""",
    "faded": _S + """, w AS (SELECT vec_id, v, v * CASE WHEN i < 8 THEN 0.5 - 0.5 * cos(pi() * i / 8) WHEN i >= 56 THEN 0.5 - 0.5 * cos(pi() * (63 - i) / 8) ELSE 1 END AS f FROM v)
SELECT vec_id, round(sum(f * f), 5) AS energy, round(1 - sum(f * f) / sum(v * v), 6) AS lost FROM w GROUP BY 1""",
    "dominant_comb_bin": _GRID + " SELECT label, f0::INTEGER AS f0, k::INTEGER AS k FROM d",
    "comb_aliases": _GRID + """ SELECT x.label, x.f0::INTEGER AS f0, sum(CASE WHEN x.k = y.k OR abs(x.f0 - y.f0) <= 2 OR abs(x.f0 / y.f0 - round_even(x.f0 / y.f0, 0)) <= 0.02 OR abs(y.f0 / x.f0 - round_even(y.f0 / x.f0, 0)) <= 0.02 THEN 1 ELSE 0 END)::BIGINT AS aliases
FROM d x JOIN d y ON x.label = y.label AND x.f0 <> y.f0 GROUP BY 1, 2""",
    "pair_report": _MS + """, b AS (SELECT h.label // 2 AS pair, h.k, 20 * log10(f.mag / h.mag) AS db FROM a h JOIN a f USING (k) WHERE h.label % 2 = 0 AND f.label = h.label + 1)
SELECT pair::BIGINT AS pair, k::INTEGER AS k, round(db, 5) AS db, CASE WHEN db > 3 THEN 'raised' WHEN db < -3 THEN 'lowered' ELSE 'inconclusive' END AS verdict FROM b""",
    "race_evidence": _MS + ", b AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k}, {d}::DOUBLE, {p}::DOUBLE)" for n, k, d, p in A.BEARINGS) + """) t(bearing, n, ball, pitch)),
f AS (SELECT bearing, 'bpfo' AS race, n * 2.5 * (1 - ball / pitch) AS f FROM b UNION ALL SELECT bearing, 'bpfi', n * 2.5 * (1 + ball / pitch) FROM b UNION ALL SELECT bearing, 'bsf_2x', pitch / ball * 5 * (1 - ball / pitch * ball / pitch) FROM b)
SELECT label, bearing, race, round(max(mag) / any_value(mid), 5) AS ratio FROM f, a JOIN (SELECT label, quantile_cont(mag, 0.5) AS mid FROM a GROUP BY 1) m USING (label) WHERE abs(a.k - f.f) <= 1 GROUP BY 1, 2, 3""",
    "blade_speeds": _MS + """, t AS (SELECT label, arg_max(k, (round(mag, 9), -k)) AS k FROM a GROUP BY 1)
SELECT label, b::INTEGER AS blades, round(60.0 * k / b, 6) AS rpm, EXISTS (SELECT 1 FROM range(1, 9) q(q) WHERE abs(k - q * 50.0) <= 1.5 OR q >= 2 AND abs(q * k - 50.0) <= 1.5) AS mains FROM t, (SELECT unnest(range(2, 6)) AS b)""",
    "labelled_files": """WITH f AS (SELECT page_id AS id, lower(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1)) AS stem FROM pages), j AS (SELECT stem, CASE quality WHEN 1 THEN 'healthy' WHEN 0 THEN 'faulty' END AS told FROM f LEFT JOIN labels ON labels.doc_id = f.id)
SELECT coalesce(told, CASE WHEN regexp_matches(stem, '^[0-9]*[02468]$') THEN 'healthy' ELSE 'faulty' END) AS label, told IS NOT NULL AS by_manifest, count(*) AS files FROM j GROUP BY 1, 2""",
}
QUERIES = {f.__name__: f for f in (audio_audit, accel_audit, gain_plan, prepared, signal_level, agc_distance, mel_bank, short_spectra, log_mel, heatmap, scaled_patches, faded, dominant_comb_bin, comb_aliases, pair_report,
                                   race_evidence, blade_speeds, labelled_files)}
