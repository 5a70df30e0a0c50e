"""Checks of a sensor on the bench: what a recording of a still board, or of a known tone, says about it.

Everything is measured from the samples that arrived, the rate too. Numbers are aggregates and spectra averaged over
segments, so a long recording is many tasks' work; verdicts are findings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinemetry.functions import audit

#: Fixed values of an accelerometer: tolerance of gravity, noise in micro-g per root hertz, full scale in g, least share of the nominal rate.
GRAVITY, NOISE, FULL_G, RATE = 0.10, 500.0, 15.9, 0.5
#: Fixed values of a microphone: tolerance of rate and tone in percent, offset, least level that lives, different values, levels in
#: dBFS, full scale and headroom, noise floor, prominence and distortion in dB, the tone's range in hertz.
OFF, DC, ALIVE, VALUES, LEVELS, FULL, HEADROOM, FLOOR, PROMINENT, DISTORTED, TONES = 1.0, 0.05, 1e-6, 16, (-80.0, -3.0), 0.999, 0.95, -20.0, 20.0, -20.0, (1000.0, 6000.0)
#: Samples of a segment of the spectrum, and of a frame of the noise floor.
SEGMENT, FRAME = 4096, 512


def _db(x: Column) -> Column:
    return F.when(x.isNotNull(), 20 * F.log10(F.greatest(x, F.lit(1e-12))))


def accelerometer(recordings: DataFrame, nominal_hz: float) -> DataFrame:
    """Per recording (id, x, y, z in g, elapsed_s): rate_hz, gravity, noise_density (of the worst axis), peak and `findings`. Axes
    that are null or empty don't count; a recording without a sample has the finding `no_samples` and nulls."""
    axes = F.explode_outer(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in "xyz"]))
    each = recordings.select("id", "elapsed_s", axes.alias("a")).select("id", "elapsed_s", "a.axis", F.explode_outer("a.v").alias("v"))
    own = each.groupBy("id", "axis").agg(F.max("elapsed_s").alias("s"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.max(F.abs("v")).alias("peak"))
    whole = own.groupBy("id").agg((F.max("n") / F.max("s")).alias("rate_hz"), F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("gravity"), F.max("sd").alias("sd"), F.max("peak").alias("peak"), F.max("n").alias("n"))
    whole = whole.withColumn("noise_density", F.col("sd") * 1e6 / F.sqrt(F.greatest(F.col("rate_hz"), F.lit(1.0)) / 2))
    some = lambda c: F.coalesce(c, F.lit(False))
    found = audit.findings((F.col("n") == 0, "blind", "no_samples"), (some((F.col("n") > 0) & (F.col("rate_hz") <= RATE * nominal_hz)), "blind", "slow"), (some(F.abs(F.col("gravity") - 1) > GRAVITY), "warn", "gravity"),
                           (some(F.col("noise_density") >= NOISE), "warn", "noisy"), (some(F.col("peak") >= FULL_G), "warn", "saturated"))
    return whole.select("id", "rate_hz", "gravity", "noise_density", "peak", found.alias("findings"))


def _power(xs: pa.Array) -> pa.Array:
    out = []
    for x in xs:
        v = x.values.to_numpy(zero_copy_only=False).astype(float)
        out.append((np.abs(np.fft.rfft((v - v.mean()) * np.hanning(len(v)))) ** 2).tolist())
    return pa.array(out, pa.list_(pa.float64()))


def microphone(recordings: DataFrame, fs: float, tone_hz: float) -> DataFrame:
    """Per recording of a tone (id, audio, elapsed_s): rate_off_pct, dc, level_dbfs, floor_dbfs (the median frame), clipped (samples),
    and, from the spectra of its whole segments, tone_off_pct, prominence_db, distortion_db (second and third harmonic over
    the tone; null where they lie beyond the half of the rate), and `findings`. A recording shorter than a segment has no
    tone; one without a sample has the finding `no_samples`."""
    x = F.col("audio")
    base = recordings.select("id", "elapsed_s", "audio").withColumn("n", F.coalesce(F.when(x.isNotNull(), F.size(x)), F.lit(0)))
    each = base.select("id", "elapsed_s", "n", F.posexplode_outer("audio").alias("i", "v"))
    frames = each.groupBy("id", F.floor(F.col("i") / FRAME).alias("f")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"),
                                                                     F.max(F.abs("v")).alias("peak"), F.count(F.when(F.abs("v") >= FULL, 1)).alias("clipped"), F.count("v").alias("m"))
    whole = frames.groupBy("id").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("peak").alias("peak"), F.sum("clipped").alias("clipped"), F.nullif(F.sum("m"), F.lit(0)).alias("m"), F.percentile("rms", F.lit(0.5)).alias("floor"))
    starts = F.sequence(F.lit(1), F.col("n") - SEGMENT + 1, F.lit(SEGMENT))
    cut = base.where(F.col("n") >= SEGMENT).select("id", "audio", F.explode(starts).alias("at")).select("id", "at", F.slice(x, F.col("at"), SEGMENT).alias("x")).repartition("id", "at")
    bins = cut.select("id", F.posexplode(F.arrow_udf(_power, "array<double>")("x")).alias("k", "p")).groupBy("id", "k").agg(F.sqrt(F.avg("p")).alias("mag"))
    lines = bins.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "mag"))), lambda b: b["mag"]).alias("mag"))  # SEGMENT / 2 + 1
    hz = fs / SEGMENT
    low, high = int(np.ceil(TONES[0] / hz)), int(min(TONES[1], fs / 2 * 0.95) / hz)
    near = F.slice("mag", low + 1, high - low + 1)
    told = lines.withColumn("top", F.array_max(F.transform(near, lambda m, i: F.struct(m.alias("m"), (-i - low).alias("k")))))
    told = told.withColumn("k", -F.col("top.k")).withColumn("middle", F.sort_array("mag")[SEGMENT // 4])
    a, b, c = (F.log(F.get("mag", F.col("k") + d) + 1e-30) for d in (-1, 0, 1))
    bend = a - 2 * b + c
    told = told.withColumn("f", (F.col("k") + F.when(F.abs(bend) > 1e-30, 0.5 * (a - c) / bend).otherwise(0.0)) * hz)
    # of each harmonic the loudest line within two bins
    loud = lambda h: F.array_max(F.slice("mag", F.round(F.col("f") * h / hz).cast("int") - 1, 5))
    distortion = F.when(3 * F.col("f") < fs / 2 - 3 * hz, _db((loud(2) + loud(3)) / (loud(1) + 1e-30)))
    told = told.select("id", (100 * (F.col("f") / tone_hz - 1)).alias("tone_off_pct"), _db(F.col("top.m") / (F.col("middle") + 1e-30)).alias("prominence_db"), distortion.alias("distortion_db"))
    values = base.select("id", "elapsed_s", F.least(F.size(F.array_distinct(x)), F.lit(VALUES + 1)).alias("values"))
    both = whole.join(values, "id").join(told, "id", "left")
    dc = F.col("s") / F.col("m")
    alive = F.when(F.col("m").isNotNull(), F.sqrt(F.greatest(F.col("q") / F.col("m") - dc * dc, F.lit(0.0))))
    out = both.select("id", (100 * (F.col("m") / F.col("elapsed_s") / fs - 1)).alias("rate_off_pct"), dc.alias("dc"), _db(F.sqrt(F.col("q") / F.col("m"))).alias("level_dbfs"), _db(F.col("floor")).alias("floor_dbfs"),
                      "clipped", "tone_off_pct", "prominence_db", "distortion_db", alive.alias("alive"), "values", "peak", "m")
    some = lambda c: F.coalesce(c, F.lit(False))
    found = audit.findings(
        (F.col("m").isNull(), "blind", "no_samples"), (some(F.abs("rate_off_pct") > OFF), "blind", "rate"), (some(F.col("alive") <= ALIVE), "blind", "dead"), (some((F.col("values") <= VALUES) & F.col("m").isNotNull()), "blind", "stuck"),
        (some(F.abs("dc") >= DC), "warn", "dc"), (some(~F.col("level_dbfs").between(*LEVELS)), "warn", "level"), (some(F.col("clipped") > 0), "warn", "clipped"), (some(F.col("peak") >= HEADROOM), "warn", "headroom"),
        (some(F.col("floor_dbfs") >= FLOOR), "warn", "floor"), (some(F.abs("tone_off_pct") > OFF), "blind", "tone"), (some(F.col("prominence_db") <= PROMINENT), "warn", "faint"), (some(F.col("distortion_db") >= DISTORTED), "warn", "distorted"))
    return out.select(*out.columns[:9], found.alias("findings"))
