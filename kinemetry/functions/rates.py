"""Rates and levels of whole signals: resampling, true peaks, band shares, envelopes, codec limits, taps.

The array functions take matrices of one signal a row, so that a batch's signals of equal length are
handled together; the column functions take an array column, and a null signal gives null."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinemetry.functions import arrays as A

#: The window's Kaiser parameter, taps each side per step of the larger rate, the largest denominator.
KAISER, REACH, LARGEST = 5.0, 10, 1000
#: Fixed values of the true peak: oversampling, samples at either end.
OVER, EDGE = 4, 64
#: Fixed values of the band's share: the longest segment, how many at most, the shortest; of the codec's limit: segment, band in hertz, fall in dB.
SEGMENT, SEGMENTS, SHORTEST, WELCH, STEP, FALL = 1 << 15, 16, 64, 8192, 1000.0, 40.0
#: Fixed values of taps: times the median level, seconds of ring-down and the least of them, the lowest resonance in hertz.
LOUD, RING, SPECK, RESONANCE = 8.0, 0.05, 0.005, 800.0
#: Samples handled at once.
BLOCK = 1 << 20


def ratio(fs_in: float, fs_out: float) -> tuple[int, int]:
    """The integers by which a signal is stretched and then thinned."""
    part = Fraction(fs_out / fs_in).limit_denominator(LARGEST)
    return part.numerator, part.denominator


@lru_cache(maxsize=64)
def taps(up: int, down: int) -> np.ndarray:
    """The low-pass at the lower of both Nyquist rates: a Kaiser-windowed sinc with a gain of `up`."""
    wide = max(up, down)
    at = np.arange(-REACH * wide, REACH * wide + 1)
    h = np.sinc(at / wide) * np.kaiser(len(at), KAISER)
    return up * h / h.sum()


def _stretched(x: np.ndarray, up: int, down: int) -> Iterator[np.ndarray]:
    """Consecutive blocks of x (.., samples) at up/down of its rate, silent beyond its ends. Only the taps that
    meet a sample are multiplied, so memory grows with neither `up` nor the signal."""
    h = taps(up, down)
    n, size = -(-x.shape[-1] * up // down), x.shape[-1]
    reach = np.arange(len(h) // up + 1)
    block = max(1, BLOCK // (len(reach) * max(1, x[..., :1].size)))
    for s in range(0, n, block):
        at = np.arange(s, min(n, s + block)) * down + len(h) // 2
        m = (at // up)[:, None] - reach  # the samples from the latest whose tap is not before the first
        tap = at[:, None] - m * up
        ok = (m >= 0) & (m < size) & (tap < len(h))
        yield np.einsum("...ij,ij->...i", x[..., np.clip(m, 0, size - 1)], np.where(ok, h[np.minimum(tap, len(h) - 1)], 0.0))


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x (.., samples) at up/down of its rate."""
    shared = math.gcd(up, down)
    if up == down or not x.size:
        return np.asarray(x, float)
    return np.concatenate(list(_stretched(x, up // shared, down // shared)), axis=-1)


def peak_dbtp(x: np.ndarray) -> np.ndarray:
    """The highest level, between samples too, in decibels of full scale; minus infinity for silence. A signal begins
    and ends in silence, which rings: among its first and its last EDGE samples only the samples count, unless it has no
    others; so they do where it has fewer than EDGE."""
    top, at, n = np.abs(x).max(-1, initial=0.0), 0, x.shape[-1]
    low, high = (EDGE * OVER, (n - EDGE) * OVER) if n > 2 * EDGE else (0, n * OVER)
    for y in _stretched(x, OVER, 1) if x.size and n >= EDGE else ():
        here = y[..., max(0, low - at) : max(0, high - at)]
        top, at = np.maximum(top, np.abs(here).max(-1, initial=0.0)), at + y.shape[-1]
    with np.errstate(divide="ignore"):
        return 20 * np.log10(top)


def _power(x: np.ndarray, size: int, starts: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Mean power per bin over the segments of x (.., samples) that begin at `starts`, each without its mean."""
    total = 0.0
    for part in np.array_split(starts, -(-len(starts) * size * max(1, x[..., 0].size) // BLOCK)):
        cut = sliding_window_view(x, size, axis=-1)[..., part, :]
        total = total + (np.abs(np.fft.rfft((cut - cut.mean(-1, keepdims=True)) * window)) ** 2).sum(-2)
    return total / len(starts)


def share(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """Share of the power from `low` to `high` hertz, over Hann-windowed segments spread evenly from end to end, which
    overlap by half where there is room for few; NaN if the signal is too short or silent."""
    size, spare = min(x.shape[-1], SEGMENT), max(0, x.shape[-1] - SEGMENT)
    if size < SHORTEST:
        return np.full(x.shape[:-1], np.nan)
    starts = np.linspace(0, spare, min(SEGMENTS, 1 + -(-2 * spare // size))).round().astype(int)
    p = _power(x, size, starts, np.hanning(size))
    a, b = np.searchsorted(np.fft.rfftfreq(size, 1 / fs), [low, np.nextafter(high, np.inf)])
    with np.errstate(invalid="ignore"):
        return p[..., a:b].sum(-1) / p.sum(-1)


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal: negative frequencies dropped, positive ones doubled."""
    n = x.shape[-1]
    turns = np.sign(np.fft.fftfreq(n))
    gain = 1 + np.where(np.arange(n) * 2 == n, 0, turns)
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def cutoff(x: np.ndarray, fs: float) -> np.ndarray:
    """Where a codec cut the spectrum off: the start of the run of 1 kHz bands, up to the last one, that lie FALL below
    the median of the lowest third. NaN without such a run, or if the signal is silent or too short or has few bands."""
    size, bands = min(x.shape[-1], WELCH), math.ceil(fs / 2 / STEP) - 1
    none = np.full(x.shape[:-1], np.nan)
    if bands < 4 or size < 2:
        return none
    hann = np.hanning(size + 1)[:-1]
    p = _power(x, size, np.arange(0, x.shape[-1] - size + 1, max(1, size - size // 2)), hann)
    f = np.fft.rfftfreq(size, 1 / fs)
    edge = np.searchsorted(f, STEP * np.arange(1, bands + 2))
    area = np.concatenate([np.zeros((*p.shape[:-1], 1)), np.cumsum((p[..., 1:] + p[..., :-1]) / 2, -1)], -1)  # trapezoids up to each bin
    level = area[..., np.maximum(edge[1:] - 1, edge[:-1])] - area[..., edge[:-1]]
    usual = np.median(level[..., : max(2, bands // 3)], -1, keepdims=True)
    dead = 10 * np.log10(np.maximum(level, 1e-300)) < 10 * np.log10(np.maximum(usual, 1e-300)) - FALL
    run = np.logical_and.accumulate(dead[..., ::-1], -1).sum(-1)
    return np.where((run > 0) & (usual[..., 0] > 0), STEP * (bands + 1 - run), none)


def ring(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """The strongest resonance of each ring-down, in hertz, and its quality: that over the width at half its power,
    whose ends are interpolated. Zeros where no resonance of RESONANCE or more can show."""
    x = np.atleast_2d(x)
    f = np.fft.rfftfreq(x.shape[-1], 1 / fs)
    first = int(np.searchsorted(f, RESONANCE))
    if first == len(f):
        return np.zeros(len(x)), np.zeros(len(x))
    mag = np.abs(np.fft.rfft(x * np.hanning(x.shape[-1])))
    top = first + mag[:, first:].argmax(1)
    over = mag / np.maximum(mag[np.arange(len(x)), top], 1e-300)[:, None] - math.sqrt(0.5)
    bins = np.arange(len(f))

    def crossing(side: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """The place on the way from the bin `at`, at or below half power, one step on towards the top."""
        rows = np.arange(len(x))
        a, b = over[rows, at], over[rows, np.clip(at + step, 0, len(f) - 1)]
        return np.where(side.any(1) & (b > a), at - step * a / np.where(b > a, b - a, 1), at)

    under = over <= 0
    left, right = under & (bins <= top[:, None]), under & (bins >= top[:, None])
    low = crossing(left, np.where(left.any(1), (left * bins).max(1), 0), 1)
    high = crossing(right, np.where(right.any(1), right.argmax(1), len(f) - 1), -1)
    width = (high - low) * (f[1] - f[0])
    return f[top], np.where(width > 0, f[top] / np.where(width > 0, width, 1), 0.0)


def _column(of: Callable, kind: str) -> Callable:
    """A column function of `of`, which takes a matrix of signals of one length and their common further arguments."""

    def each(x: pd.Series, *more: pd.Series) -> pd.Series:
        alike, out = defaultdict(list), np.full(len(x), None, object)
        for i, (v, *args) in enumerate(zip(x, *more, strict=True)):
            if v is not None and not any(pd.isna(a) for a in args):
                alike[len(v), *args].append(i)
        for (n, *args), rows in alike.items():
            step = max(1, BLOCK // max(n, 1))
            for s in range(0, len(rows), step):
                found = of(np.array([x.iloc[i] for i in rows[s : s + step]], float), *args)
                for i, v in zip(rows[s : s + step], found, strict=True):
                    out[i] = v
        return pd.Series(out, dtype=object)

    return F.pandas_udf(each, kind)


def resampled(x: Column, fs_in: Column, fs_out: float) -> Column:
    return _column(lambda v, fs: list(resample(v, *ratio(fs, fs_out))), "array<double>")(x, fs_in)


def true_peak(x: Column) -> Column:
    return _column(peak_dbtp, "double")(x)


def band_share(x: Column, fs: Column, low: float, high: float) -> Column:
    return _column(lambda v, r: share(v, r, low, high), "double")(x, fs)


def analytic(x: Column) -> Column:
    return _column(lambda v: list(envelope(v)) if v.size else list(v), "array<double>")(x)


def lossy_cutoff(x: Column, fs: Column) -> Column:
    """`cutoff`, null where there is none."""
    return _column(lambda v, r: [None if math.isnan(c) else c for c in cutoff(v, r)], "double")(x, fs)


def ringing(x: Column, fs: Column) -> Column:
    """(resonance, q) of a ring-down."""
    both = _column(lambda v, r: np.stack(ring(v, r), -1).tolist(), "array<double>")(x, fs)
    return F.struct(both[0].alias("resonance"), both[1].alias("q"))


def tap_starts(x: Column, fs: Column) -> Column:
    """The samples before a mounting test's taps rise above LOUD times the median level. A rise within the ring-down of
    a tap belongs to it, and one cut short by the end is none."""
    n = F.size(x)
    ring_for, least = F.floor(RING * fs).cast("int"), SPECK * fs

    def found(level: Column) -> Column:
        return A.bound(F.sort_array(level), lambda order: A.bound(
            LOUD * ((F.get(order, F.floor((n - 1) / 2).cast("int")) + F.get(order, F.floor(n / 2).cast("int"))) / 2 + 1e-12), lambda limit: F.filter(
                F.zip_with(F.slice(level, 1, n - 1), F.transform(F.slice(level, 2, n - 1), lambda b, i: F.struct(b.alias("b"), i.alias("i"))),
                           lambda a, b: F.when((a <= limit) & (b["b"] > limit), b["i"])), lambda i: F.least(ring_for, n - i) > least)))

    def apart(rises: Column) -> Column:
        return F.aggregate(rises, F.struct(F.array().cast("array<int>").alias("taps"), F.lit(0).alias("free")), lambda s, i: F.when(
            i >= s["free"], F.struct(F.concat(s["taps"], F.array(i)).alias("taps"), (i + ring_for).alias("free"))).otherwise(s), lambda s: s["taps"])

    return F.when(n > 1, apart(found(F.transform(x, lambda v: F.abs(v))))).when(x.isNotNull(), F.array().cast("array<int>"))


def tapped(recordings: DataFrame, signal: str = "audio", fs: str = "fs") -> DataFrame:
    """A row per tap of `recordings`: their other columns, start, stop (samples), resonance and q of the ring-down. A
    recording without taps, with a null or empty signal or a null rate, has none."""
    x, rate = F.col(signal), F.col(fs)
    each = recordings.withColumn("start", F.explode(tap_starts(x, rate))).withColumn("stop", F.least(F.col("start") + F.floor(RING * rate).cast("int"), F.size(x)))
    rung = each.withColumn(signal, F.slice(x, F.col("start") + 1, F.col("stop") - F.col("start")))
    return rung.withColumn("ring", ringing(x, rate)).select("*", "ring.*").drop("ring", signal)
