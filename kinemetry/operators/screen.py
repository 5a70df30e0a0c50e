"""Screening of recordings without a baseline: which harmonic combs stand out of the envelope's spectrum.

The spectra of a recording's windows are averaged by Spark; candidates are scored on the mean spectrum, and the best
are taken one after another, each one out that says the same as a better one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinemetry.functions import arrays as A
from kinemetry.functions import vibration as V
from kinemetry.operators import features

#: The least rate, seconds of a window, lines of the spectrum, candidates and the least step between them in
#: hertz, harmonics, half the width of a line, harmonics that a comb needs, peaks, and the ratio below which a band holds nothing.
LEAST_FS, WINDOW_S, LINES, RANGE, STEP, HARMONICS, WIDTH, NEEDED, TOP, NOTHING = 12_000.0, 10.0, (1.0, 600.0), (8.0, 300.0), 0.25, 5, 1.5, 3, 5, 1e-3


def chosen(ordered: Column, clash: Callable[[Column, Column], Column], most: int) -> Column:
    """Of an array in order of preference the first `most` that clash with none taken before: ordered greedy selection."""
    none = F.slice(ordered, 1, 0)
    return F.aggregate(ordered, none, lambda taken, x: F.when((F.size(taken) >= most) | F.exists(taken, lambda y: clash(x, y)), taken).otherwise(F.concat(taken, F.array(x))))


def combs(f: np.ndarray, mag: np.ndarray) -> list[dict]:
    """Every candidate with a score: the mean over its harmonics of the loudest line near each, over the median line, and
    the one line on which it mostly rests (the loudest of all these; of equals the lowest)."""
    if len(f) < 2 or not (middle := np.median(mag)) > 0:
        return []
    step = max(f[1] - f[0], STEP)
    f0 = np.arange(RANGE[0], RANGE[1] + step, step)
    at = f0[:, None] * np.arange(1, HARMONICS + 1)
    low, high = np.searchsorted(f, at - WIDTH, "left"), np.searchsorted(f, at + WIDTH, "right")
    reach = np.arange((high - low).max(initial=0))
    place = np.minimum(low[..., None] + reach, len(f) - 1)
    near = np.where(reach < (high - low)[..., None], mag[place], -1.0)
    loud = near.max(-1, initial=-1.0)
    there = loud >= 0
    score = np.where(there, loud, 0).sum(1) / np.maximum(there.sum(1), 1) / middle
    lines = place.reshape(len(f0), -1)[np.arange(len(f0)), near.reshape(len(f0), -1).argmax(1)]
    return [{"f0": float(a), "score": float(s), "line": int(k)} for a, s, k, n in zip(f0, score, lines, there.sum(1), strict=True) if n >= NEEDED and s > 0]


def _samples(x: pa.Scalar) -> np.ndarray:
    return np.zeros(0) if x.values is None else x.values.to_numpy(zero_copy_only=False).astype(float)


def _band(first: pa.Array, fs: pa.Array) -> pa.Array:
    rows = []
    for x, r in zip(first, fs, strict=True):
        _, bands, _, crests = features.searched(_samples(x), r.as_py())
        top = int(np.argmax(crests))
        rows.append({"low": bands[top][0], "high": bands[top][1], "crest": float(crests[top])})
    return pa.array(rows, pa.struct([(n, pa.float64()) for n in ("low", "high", "crest")]))


def _spectrum(audio: pa.Array, fs: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    rows = []
    for x, r, a, b in zip(audio, fs, low, high, strict=True):
        x, r = _samples(x), r.as_py()
        e = V.Envelopes(x, r, b.as_py() - a.as_py()).envelope(a.as_py(), b.as_py())
        f, mag = np.fft.rfftfreq(len(e), V.DECIMATE / r), np.abs(np.fft.rfft((e - e.mean()) * np.hanning(len(e))))
        some = (f >= LINES[0]) & (f <= LINES[1])
        rows.append({"f": f[some].tolist(), "mag": mag[some].tolist(), "inside": float((e * e).mean()), "whole": float((x * x).mean())})
    return pa.array(rows, pa.struct([("f", pa.list_(pa.float64())), ("mag", pa.list_(pa.float64())), ("inside", pa.float64()), ("whole", pa.float64())]))


def _combs(f: pa.Array, mag: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("f0", pa.float64()), ("score", pa.float64()), ("line", pa.int32())]))
    return pa.array([combs(_samples(a), _samples(m)) for a, m in zip(f, mag, strict=True)], kind)


def screen(recordings: DataFrame, mains: float = 50.0, window_s: float = WINDOW_S) -> DataFrame:
    """One row per recording (id, audio, fs): `refused` or the band searched (low, high, crest), `degenerate` (the band holds
    next to nothing), `clipped` (share of samples at the peak) and `peaks`, at most TOP of (f0, score, flag) in falling order,
    of which none is another's multiple or part or rests on the same line. Peaks that lie on the mains keep their place and
    say so in `flag`. Equal scores go by the lower f0.

    Refused are recordings with a null or non-finite sample or none, of fewer than 64 samples, and of a null or too low
    rate: a damaged one would read as healthy. One of two windows or more is the mean of its whole windows' spectra,
    whose tasks are windows, not recordings; a shorter one has one spectrum."""
    x, fs = F.col("audio"), F.col("fs")
    band = F.arrow_udf(_band, "struct<low:double,high:double,crest:double>")
    spectrum = F.arrow_udf(_spectrum, "struct<f:array<double>,mag:array<double>,inside:double,whole:double>")
    combs_of = F.arrow_udf(_combs, "array<struct<f0:double,score:double,line:int>>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    why = (F.when(x.isNull() | (F.size(x) < 64), "too short").when(bad, "samples that are no numbers").when(fs.isNull() | F.isnan(fs) | (fs == float("inf")), "no rate")
           .when(fs < LEAST_FS, "rate below 12 kHz"))
    every = recordings.select("id", "audio", fs.cast("double").alias("fs")).withColumn("refused", why)
    good = every.where("refused is null").withColumn("size", F.floor(window_s * fs).cast("int"))
    good = good.withColumn("band", band(F.slice(x, 1, F.greatest(F.col("size"), F.lit(64))), fs)).withColumn("clipped", A.clipped(x, False))
    starts = F.when(F.size(x) >= 2 * F.col("size"), F.sequence(F.lit(1), F.size(x) - F.col("size") + 1, F.col("size"))).otherwise(F.array(F.lit(1)))
    length = F.when(F.size(x) >= 2 * F.col("size"), F.col("size")).otherwise(F.size(x))
    parts = good.select("id", "fs", "band", "clipped", length.alias("n"), "audio", F.explode(starts).alias("at")).select("id", "fs", "band", "clipped", "at", F.slice(x, F.col("at"), F.col("n")).alias("audio"))
    # dealt by window: a long recording is many tasks' work
    spectra = parts.repartition("id", "at").withColumn("s", spectrum(x, fs, F.col("band.low"), F.col("band.high")))
    lines = spectra.select("id", F.posexplode(F.arrays_zip("s.f", "s.mag")).alias("i", "l")).groupBy("id", "i").agg(F.max("l.f").alias("f"), F.avg("l.mag").alias("mag"))
    mean = lines.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "f", "mag"))).alias("l"))  # as many as lines of a window
    level = spectra.groupBy("id").agg(F.first("band").alias("band"), F.first("clipped").alias("clipped"), (F.sqrt(F.avg("s.inside")) / (F.sqrt(F.avg("s.whole")) + 1e-30) < NOTHING).alias("degenerate"))
    best = F.sort_array(F.transform(combs_of(F.col("l.f"), F.col("l.mag")), lambda c: F.struct((-c["score"]).alias("less"), c["f0"].alias("f0"), c["line"].alias("line"))))
    taken = chosen(F.col("best"), lambda a, b: A.ratio_alias(a["f0"], b["f0"]) | (a["line"] == b["line"]), TOP)
    flag = lambda f0: F.when(A.mains_related(f0, mains), f"mains {mains:g} Hz").otherwise("")
    peaks = mean.select("id", best.alias("best")).select("id", F.transform(taken, lambda c: F.struct(c["f0"].alias("f0"), (-c["less"]).alias("score"), flag(c["f0"]).alias("flag"))).alias("peaks"))
    found = level.join(peaks, "id", "left").select("id", "band.*", "degenerate", "clipped", F.coalesce("peaks", F.slice(F.array(F.struct(F.lit(0.0).alias("f0"), F.lit(0.0).alias("score"), F.lit("").alias("flag"))), 1, 0)).alias("peaks"))
    return every.select("id", "refused").join(found, "id", "left")
