import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_features import recursion

from kinemetry.functions import vibration as V
from kinemetry.operators import baseline, features, relations, screen, severity
from kinemetry.plans import learning, screening
from kinemetry.sources.readings import table


def brute(x, fs, mains=50.0, window_s=10.0):
    """The screen of one recording, candidate by candidate."""
    n = int(window_s * fs)
    _, bands, _, crests = features.searched(x[:n], fs)
    low, high = bands[int(np.argmax(crests))]
    parts = [x[i : i + n] for i in range(0, len(x) - n + 1, n)] if len(x) >= 2 * n else [x]
    mags, inside = [], []
    for part in parts:
        e = V.Envelopes(part, fs, high - low).envelope(low, high)
        f = np.fft.rfftfreq(len(e), V.DECIMATE / fs)
        mags.append(np.abs(np.fft.rfft((e - e.mean()) * np.hanning(len(e)))))
        inside.append((e * e).mean())
    some = (f >= 1) & (f <= 600)
    f, mag = f[some], np.mean(mags, 0)[some]
    scored = []
    f0 = 8.0
    step = max(f[1] - f[0], 0.25)
    for i in range(int(np.ceil((300 + step - 8) / step))):
        f0 = 8 + i * step
        near = [np.flatnonzero((f >= f0 * k - 1.5) & (f <= f0 * k + 1.5)) for k in range(1, 6)]
        near = [b for b in near if len(b)]
        if len(near) >= 3:
            every = sorted(b for bins in near for b in bins)
            scored.append((-np.mean([mag[b].max() for b in near]) / np.median(mag), f0, max(every, key=lambda b: (mag[b], -b))))
    peaks, lines = [], []
    whole = lambda r: abs(r - round(r)) <= 0.02
    for s, f0, line in sorted(scored):
        if len(peaks) == 5:
            break
        if line not in lines and not any(abs(f0 - p) <= 2 or whole(f0 / p) or whole(p / f0) for p, *_ in peaks):
            mainsy = any(abs(f0 - k * mains) <= 1.5 or k > 1 and abs(k * f0 - mains) <= 1.5 for k in range(1, 9))
            peaks.append((f0, -s, "mains 50 Hz" if mainsy else ""))
            lines.append(line)
    return low, bool(np.sqrt(np.mean(inside)) / np.sqrt(np.mean(x * x)) < 1e-3), peaks


def impacts(rate, seconds, fs=16000.0, seed=0, hum=0.0):
    r, t = np.random.default_rng(seed), np.arange(int(seconds * fs)) / fs
    at = t % (1 / rate)
    return 0.02 * r.normal(size=len(t)) + np.exp(-at * 900) * np.sin(2 * np.pi * 3300 * at) + hum * np.sin(2 * np.pi * 50 * t)


def test_screen_finds_planted_rates_and_is_brute_force(spark):
    rows = [(1, impacts(37.0, 1.5), 16000.0), (2, impacts(91.0, 2.6, seed=3), 16000.0), (3, impacts(50.0, 1.0, seed=4), 16000.0), (4, np.random.default_rng(5).normal(size=16000), 16000.0), (5, np.zeros(4000), 16000.0)]
    bad = [(10, None, 16000.0), (11, [], 16000.0), (12, [0.0] * 50, 16000.0), (13, [0.5] * 100 + [math.nan], 16000.0), (14, [0.5] * 100, 8000.0), (15, [0.5] * 100, None), (16, [0.5] * 99 + [None], 16000.0)]
    df = spark.createDataFrame([(i, list(map(float, x)), fs) for i, x, fs in rows] + bad, "id int, audio array<double>, fs double")
    got = {r.id: r for r in screen.screen(df.repartition(3), window_s=0.5).collect()}
    assert len(got) == len(rows) + len(bad)
    for i, x, fs in rows[:4]:
        low, degenerate, peaks = brute(np.array(x), fs, window_s=0.5)
        assert got[i].refused is None and abs(got[i].low - low) < 1e-9 and got[i].degenerate == degenerate and len(got[i].peaks) == len(peaks)
        for p, (f0, score, flag) in zip(got[i].peaks, peaks, strict=True):
            assert abs(p.f0 - f0) < 1e-9 and abs(p.score - score) < 1e-6 * score and p.flag == flag
    assert any(abs(k * got[1].peaks[0].f0 - 37) < 2.5 or abs(got[1].peaks[0].f0 - k * 37) < 2.5 for k in (1, 2, 3)) and got[1].peaks[0].score > 5
    assert got[3].peaks[0].flag == "mains 50 Hz" and got[5].peaks == [] and got[5].refused is None
    assert [got[i].refused for i in (10, 11, 12)] == ["too short"] * 3 and got[13].refused == got[16].refused == "samples that are no numbers" and got[14].refused == "rate below 12 kHz" and got[15].refused == "no rate"
    assert screen.screen(df.limit(0)).count() == 0


def test_screen_query(spark, data):
    e = {r.vec_id: np.array(r.embedding, float) for r in table(spark, data, "embeddings").collect()}
    got = screening.screen_peaks(spark, data).collect()
    n = learning.VECTORS
    for w in {r.id for r in got}:
        low, degenerate, peaks = brute(np.concatenate([e[w * n + i] for i in range(n)]), 16000.0)
        own = sorted((r for r in got if r.id == w), key=lambda r: r.place)
        assert [(r.f0, r.score, r.flag) for r in own] == [(pytest.approx(f0, abs=1e-5), pytest.approx(s, abs=1e-4), flag) for f0, s, flag in peaks] and {r.degenerate for r in own} == {degenerate}
        assert abs(own[0].band_low - low) < 1e-3


def test_severity_is_the_time_domain_filters(spark, data):
    e = {r.vec_id: np.array(r.embedding, float) for r in table(spark, data, "embeddings").collect()}
    got = {(r.device, r.window): r for r in screening.physical_severity(spark, data).collect()}
    n, (low, high), fs = learning.SHORT, screening.BAND, 16000.0
    energies = {}
    for device, w in got:
        x = np.concatenate([e[w * n + i] for i in range(n)])
        band = recursion(x, fs, low, high)
        env = recursion(np.abs(band), fs, None, V.LOW_PASS)[:: V.DECIMATE]
        mag = np.abs(np.fft.rfft((env - env.mean()) * np.hanning(len(env))))
        f = np.fft.rfftfreq(len(env), V.DECIMATE / fs)
        some = (f >= 5) & (f <= 500)
        f, mag = f[some], mag[some]
        rms, r = np.sqrt(np.mean(band**2)), got[device, w]
        energies[device, w] = np.log10((mag**2).sum() + 1e-12)
        want = (rms, 20 * np.log10(rms), f[mag.argmax()], mag.max() / (np.median(mag) + 1e-12), 20 * np.log10(mag.max()), energies[device, w])
        assert np.allclose([r[p] for p in severity.PARTS], want, atol=2e-5, rtol=1e-5)
    for (device, w), v in energies.items():
        learnt = [x for (d, k), x in energies.items() if d == device and k // learning.MACHINES < learning.LEARN]
        assert abs(got[device, w].db_re_learn - 10 * (v - np.median(learnt))) < 1e-4


def test_severity_of_short_and_odd_windows(spark):
    rows = [(1, [0.5, -0.5] * 4, 16000.0), (2, None, 16000.0), (3, [], 16000.0), (4, [math.nan] * 90, 16000.0), (5, [1.0] * 90, None), (6, [1.0] * 90, 4000.0)]
    df = spark.createDataFrame(rows, "id int, x array<double>, fs double").withColumn("s", severity.physical(F.col("x"), F.col("fs"), F.lit(3000.0), F.lit(6000.0)))
    got = {r.id: r.s for r in df.collect()}
    assert math.isnan(got[1].peak_hz) and math.isnan(got[1].energy_log10) and got[1].band_rms > 0 and all(got[i] is None for i in (2, 3, 4, 5, 6))
    made = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("a", None, True), ("a", math.nan, True), ("a", 4.0, False), ("b", 1.0, False), (None, 2.0, True)], "d string, e double, learn boolean")
    assert sorted(map(str, (r.db_re_learn for r in severity.relative(made, "d", F.col("learn"), "e").collect()))) == sorted(map(str, [-10.0, 10.0, None, math.nan, 20.0, None, 0.0]))


def test_axes_that_explain_each_other(spark):
    r = np.random.default_rng(1)
    a = r.normal(size=(400, 6))
    a[:, 3] = 2 * a[:, 0] - a[:, 1] + 0.1 * r.normal(size=400)
    a[:, 4] = 5.0
    a[:, 5] = a[:, 0]
    df = spark.createDataFrame([("m", v.tolist()) for v in a] + [("one", a[0].tolist()), (None, a[0].tolist())], "k string, x array<double>").repartition(4)
    models = baseline.learn(df, "k", shrunk=False)
    wanted = [(3, (0, 1, 2)), (0, (1, 2)), (2, (0, 5, 1)), (4, (0,)), (5, (0, 3))]
    got = {(x.k, x.i): x.r2 for x in relations.explained(models, "k", wanted).collect()}
    for i, others in wanted:
        y, m = a[:, i], np.column_stack([np.ones(400), a[:, list(others)]])
        left = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
        assert got["m", i] is None if i == 4 else abs(got["m", i] - (1 - left.var() / y.var())) < 1e-9
    assert all(v is None for (k, _), v in got.items() if k == "one")
    c = {(x.i, x.j): x.r for x in relations.correlations(models, "k").where("k = 'm'").collect()}
    assert len(c) == 15 and c[0, 4] is None and abs(c[0, 5] - 1) < 1e-12 and abs(c[1, 3] - np.corrcoef(a[:, 1], a[:, 3])[0, 1]) < 1e-12
