import numpy as np
import pytest
from pyspark.sql import functions as F

from kinemetry.functions import rates


def plain(x, up, down):
    """Zeros between samples, the whole convolution, every down-th sample."""
    h = rates.taps(up, down)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    y = np.convolve(wide, h)[len(h) // 2 :]
    return y[: len(wide)][::down]


@pytest.mark.parametrize("n, up, down", [(64, 8, 15), (100, 160, 441), (1, 4, 1), (0, 1, 3), (50, 3, 1), (20000, 4, 1)])
def test_resampling_is_the_whole_convolution(n, up, down):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(rates.resample(x, up, down), plain(x, up, down) if n else np.zeros(0), atol=1e-12)


def test_ratios_and_tones():
    assert [rates.ratio(*p) for p in ((44100, 16000), (48000, 16000), (12000, 6400))] == [(160, 441), (1, 3), (8, 15)]
    t = np.arange(12000) / 12000
    y = rates.resample(np.sin(2 * np.pi * 440 * t), 8, 15)
    assert len(y) == 6400 and np.allclose(y[200:-200], np.sin(2 * np.pi * 440 * np.arange(6400) / 6400)[200:-200], atol=1e-2)
    assert np.abs(rates.resample(np.sin(2 * np.pi * 5000 * t), 8, 15)[200:-200]).max() < 0.01


def test_true_peak_lies_between_samples():
    x = np.sin(2 * np.pi * np.arange(4000) / 4 + np.pi / 4)
    assert abs(20 * np.log10(np.abs(x).max()) + 3.01) < 0.01 and abs(rates.peak_dbtp(x)) < 0.1
    assert rates.peak_dbtp(np.zeros(100)) == rates.peak_dbtp(np.zeros(0)) == -np.inf
    assert rates.peak_dbtp(np.array([0.5])) == 20 * np.log10(0.5)


def test_shares_envelopes_and_cutoffs():
    t = np.arange(40000) / 16000
    both = np.sin(2 * np.pi * 4000 * t) + np.sin(2 * np.pi * 1000 * t)
    assert abs(rates.share(both, 16000.0, 3000, 6000) - 0.5) < 0.01 and np.isnan(rates.share(t[:10], 16000.0, 1, 2))
    assert np.isnan(rates.share(np.zeros(100), 16000.0, 3000, 6000))
    slow = 1 + 0.5 * np.sin(2 * np.pi * 10 * t)
    assert np.allclose(rates.envelope(slow * np.sin(2 * np.pi * 3000 * t)), slow, atol=1e-6)
    noise = np.random.default_rng(1).normal(size=160000)
    spectrum = np.fft.rfft(noise)
    f = np.fft.rfftfreq(len(noise), 1 / 44100)
    cut = np.fft.irfft(np.where(f < 10000, spectrum, spectrum * 1e-4))
    notch = np.fft.irfft(np.where((f >= 10000) & (f < 11000), spectrum * 1e-4, spectrum))
    both = np.fft.irfft(np.where((f < 10000) & ((f < 5000) | (f >= 6000)), spectrum, spectrum * 1e-4))
    got = rates.cutoff(np.stack((cut, noise, notch, both)), 44100.0)
    assert got[0] in (10000.0, 11000.0) and np.isnan(got[1:3]).all() and got[3] == got[0]
    assert np.isnan(rates.cutoff(np.zeros(9000), 44100.0)) and np.isnan(rates.cutoff(noise[:9000], 8000.0)) and np.isnan(rates.cutoff(noise[:1], 44100.0))


def test_null_and_empty_signals(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0.5] * 80)], "id int, x array<double>")
    x, fs = F.col("x"), F.lit(16000.0)
    got = {r.id: r for r in rows.select("id", rates.true_peak(x).alias("p"), rates.resampled(x, fs, 8000.0).alias("y"), rates.band_share(x, fs, 1.0, 2.0).alias("s"), rates.lossy_cutoff(x, fs).alias("c")).collect()}
    assert got[1].p is None and got[1].y is None and got[1].s is None and got[2].y == [] and len(got[3].y) == 40 and got[3].c is None


def test_taps_and_their_ringing(spark):
    fs, t = 16000.0, np.arange(1600) / 16000
    x = np.random.default_rng(2).normal(size=16000) * 1e-3
    for at in (2000, 7000, 15950):
        n = min(1600, len(x) - at)
        x[at : at + n] += (np.exp(-60 * t) * np.sin(2 * np.pi * 2000 * t + 1))[:n]
    rows = spark.createDataFrame([(1, x.tolist()), (2, None), (3, [0.0] * 100), (4, []), (5, [1.0])], "id int, audio array<double>").withColumn("fs", F.lit(fs))
    found = rates.tapped(rows).orderBy("start").collect()
    got = [r.asDict() for r in found if r.id == 1]
    assert len(got) == len(found)
    first = {g["start"] for g in got}
    assert {1999, 6999} <= first and all(b["start"] >= a["stop"] for a, b in zip(got, got[1:], strict=False))
    assert all(g["stop"] - g["start"] > 80 for g in got) and 15949 not in first  # 50 samples are a speck
    assert all(abs(g["resonance"] - 2000) <= 20 and abs(g["q"] / quality(x[g["start"] : g["stop"]], fs) - 1) < 0.35 for g in got if g["start"] in (1999, 6999))
    assert [v.tolist() for v in rates.ring(np.ones(8), 800.0)] == [[0.0], [0.0]]
    assert [r.t for r in rows.orderBy("id").select(rates.tap_starts(F.col("audio"), F.col("fs")).alias("t")).collect()][1:] == [None, [], [], []]


def quality(x, fs):
    """By a spectrum so fine that its bins are the width."""
    fine = np.abs(np.fft.rfft(x * np.hanning(len(x)), 64 * len(x)))
    f = np.fft.rfftfreq(64 * len(x), 1 / fs)
    top = int(np.where(f >= 800, fine, 0).argmax())
    low = np.flatnonzero(fine <= fine[top] / np.sqrt(2))
    return f[top] / (f[low[low > top][0]] - f[low[low < top][-1]])


def test_width_at_half_power_is_interpolated():
    fs, n = 16000.0, 800
    t = np.arange(n) / fs
    for rate in (1500.0, 2010.0, 3333.0):
        x = np.exp(-300 * t) * np.sin(2 * np.pi * rate * t)
        near, q = rates.ring(x, fs)
        assert abs(near[0] - rate) <= fs / n and abs(q[0] / quality(x, fs) - 1) < 0.35


def test_matrices_are_their_rows():
    x = np.random.default_rng(5).normal(size=(3, 70000))
    assert np.allclose(rates.share(x, 16000.0, 100, 3000), [rates.share(v, 16000.0, 100, 3000) for v in x])
    assert np.allclose(rates.peak_dbtp(x[:, :5000]), [rates.peak_dbtp(v) for v in x[:, :5000]])
    assert np.allclose(rates.resample(x[:, :500], 8, 15), [rates.resample(v, 8, 15) for v in x[:, :500]])
    assert np.allclose(rates.ring(x[:, :800], 16000.0), np.transpose([[v[0] for v in rates.ring(r, 16000.0)] for r in x[:, :800]]))
    assert abs(rates.share(x[0], 16000.0, 0, 4000) - 0.5) < 0.02
