import numpy as np

from kinemetry.functions import vibration as V
from kinemetry.operators import features as O

FS, FA = 16000.0, 6400.0


def recursion(x, fs, low, high):
    """The same Butterworth filter by its poles, one sample after another."""
    n = V.ORDER
    p = np.exp(1j * np.pi * (2 * np.arange(n) + n + 1) / (2 * n))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if low is None:
        wc = warp(high)
        poles, zeros, gain = p * wc, np.zeros(0), wc**n
    else:
        bw, centre = warp(high) - warp(low), warp(high) * warp(low)
        half = p * bw / 2
        root = np.sqrt(half * half - centre)
        poles, zeros, gain = np.concatenate((half + root, half - root)), np.zeros(n), bw**n
    k = 2 * fs
    gain = gain * np.prod(k - zeros) / np.prod(k - poles)
    pz, zz = (k + poles) / (k - poles), np.concatenate(((k + zeros) / (k - zeros), -np.ones(len(poles) - len(zeros))))
    y = x.astype(complex) * gain
    for a, b in zip(pz, zz, strict=True):  # a first-order section each
        out, last_x, last_y = np.zeros_like(y), 0, 0
        for i, v in enumerate(y):
            last_y = v - b * last_x + a * last_y
            last_x = v
            out[i] = last_y
        y = out
    return y.real


def machine(rng, seconds=2.0, impacts=0.0):
    t = np.arange(int(FS * seconds)) / FS
    x = 0.02 * rng.normal(size=len(t)) + 0.1 * sum(np.sin(2 * np.pi * 25 * h * t) / h for h in (1, 2, 3))
    if impacts:
        at = t % (1 / impacts)
        x += 0.5 * np.exp(-at * 900) * np.sin(2 * np.pi * 3300 * at)
    ta = np.arange(int(FA * seconds)) / FA
    a = np.stack([0.01 * rng.normal(size=len(ta)) + 0.05 * sum(np.sin(2 * np.pi * 25 * h * ta) / h for h in (1, 2, 3)) for _ in range(3)])
    return x, a


def test_envelope_is_the_recursions():
    x = np.random.default_rng(0).normal(size=4000)
    band = recursion(x, FS, 1000.0, 1400.0)
    want = recursion(np.abs(band), FS, None, V.LOW_PASS)[:: V.DECIMATE]
    got = V.Envelopes(x, FS, 400.0).envelope(1000.0, 1400.0)
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-10)


def test_parts():
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, size=5000)
    z = (x - x.mean()) / x.std()
    assert np.allclose(V.moments(x), [np.log10(x.std()), (z**4).mean() - 3, np.abs(z).max(), (z**3).mean()])
    assert V.moments(np.full(100, 3.0)) == [-9.0, 0.0, 0.0, 0.0]
    f, p = np.arange(0, 600.0, 0.5), rng.random(1200)
    parts, whole = V.shares(f, p, O.RHYTHM)
    want = [sum(v for g, v in zip(f, p, strict=True) if a <= g < b) for a, b in zip(O.RHYTHM, O.RHYTHM[1:], strict=False)]
    assert np.allclose(parts * whole, want) and np.isclose(whole, sum(want) + p[f == 500.0].sum())
    y = V.ilr(np.array([0.2, 0.3, 0.5]))
    assert np.allclose(y, [np.sqrt(1 / 2) * np.log(0.2 / 0.3), np.sqrt(2 / 3) * (np.log(0.2 * 0.3) / 2 - np.log(0.5))])
    f, p = V.welch(rng.normal(size=64000), 1000.0, 1000)
    assert np.isclose(p.sum() * (f[1] - f[0]), 1.0, atol=0.05)  # white noise of variance one


def test_rates():
    x, a = machine(np.random.default_rng(2), 10.0)
    assert abs(V.shaft_rate(x, FS) - 25) < 0.2 and abs(V.shaft_rate(a[0], FA) - 25) < 0.2
    assert V.shaft_rate(np.zeros(1000), FS) == 0.0 and V.shaft_rate(np.ones(5), FS) == 0.0
    assert V.agreed_rate(25.0, 25.5) == (25.5, True) and V.agreed_rate(50.0, 25.0) == (25.0, False)
    assert V.agreed_rate(50.0, 0.0) == (50.0, False) and V.agreed_rate(0.0, 0.0) == (0.0, False)


def test_windows(spark):
    rng = np.random.default_rng(3)
    (x, a), (y, b) = machine(rng), machine(rng, impacts=87.0)
    rows = [(0, x.tolist(), FS, *a.tolist(), FA, "z"), (1, y.tolist(), FS, *b.tolist(), FA, "z"), (2, x.tolist(), FS, a[0].tolist(), None, None, FA, "z"),
            (3, None, FS, *a.tolist(), FA, "z"), (4, [float("nan")] * 100, FS, *a.tolist(), FA, "z"), (5, x.tolist(), None, *a.tolist(), FA, "z"), (6, x.tolist(), FS, [], None, None, FA, "z")]
    df = spark.createDataFrame(rows, "id int, audio array<double>, fs_audio double, accel_x array<double>, accel_y array<double>, accel_z array<double>, fs_accel double, dc string")
    got = {r.id: r for r in O.with_features(df).collect()}
    assert len(O.NAMES) == 37 and all(got[i].vector is None for i in (3, 4, 5, 6))
    assert all(len(got[i].vector) == 37 for i in (0, 1, 2)) and got[2].vector[8:16] == [-9.0, 0.0, 0.0, 0.0] * 2
    assert got[0].band_low == 3000.0 and got[1].band_crest > 10 > got[0].band_crest and got[1].band_low < 3300 < got[1].band_high
    assert got[0].fr_reliable and abs(got[0].fr_hz - 25) < 0.6 and np.isclose(got[0].dc[0], x.mean())
    assert O.with_features(df.limit(0)).count() == 0
