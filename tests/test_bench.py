import numpy as np

from kinemetry.operators import bench


def kinds(row):
    return {f.kind for f in row.findings}


def test_planted_noise_gravity_and_saturation(spark):
    r = np.random.default_rng(1)
    n, fs = 8000, 4000.0

    def board(noise_ug, g=(0.0, 0.6, 0.8)):
        return [(m + r.normal(size=n) * noise_ug * 1e-6 * np.sqrt(fs / 2)).tolist() for m in g]

    rows = [("good", *board(100), 2.0), ("noisy", *board(900), 2.0), ("tilted", *board(100, (0.0, 0.0, 1.3)), 2.0), ("slow", *board(100), 9.0), ("hit", *board(100), 2.0), ("none", None, [], None, 2.0)]
    rows[4][1][5] = 16.0
    got = {x.id: x for x in bench.accelerometer(spark.createDataFrame(rows, "id string, x array<double>, y array<double>, z array<double>, elapsed_s double"), 4000.0).collect()}
    assert kinds(got["good"]) == set() and kinds(got["noisy"]) == {"noisy"} and kinds(got["tilted"]) == {"gravity"} and "slow" in kinds(got["slow"]) and {"saturated", "noisy"} <= kinds(got["hit"])
    assert abs(got["good"].noise_density - 100) < 5 and abs(got["noisy"].noise_density - 900) < 40 and abs(got["good"].gravity - 1) < 0.01 and got["good"].rate_hz == 4000
    assert kinds(got["none"]) == {"no_samples"} and got["none"].gravity is None


def test_planted_tones_and_harmonics(spark):
    r, fs, n = np.random.default_rng(2), 16000.0, 40000
    t = np.arange(n) / fs

    def tone(f=2000.0, level=0.1, h2=0.0, h3=0.0, noise=1e-4, dc=0.0):
        return (dc + level * (np.sin(2 * np.pi * f * t) + h2 * np.sin(4 * np.pi * f * t) + h3 * np.sin(6 * np.pi * f * t)) + noise * r.normal(size=n)).tolist()

    rows = [("good", tone(), 2.5), ("distorted", tone(h2=0.1, h3=0.05), 2.5), ("shifted", tone(2050.0), 2.5), ("fast", tone(), 2.0), ("dc", tone(dc=0.2), 2.5), ("loud", tone(level=1.2), 2.5), ("noise", (0.3 * r.normal(size=n)).tolist(), 2.5),
            ("dead", [0.0] * n, 2.5), ("short", tone()[:600], 600 / fs), ("none", None, 1.0), ("empty", [], 1.0)]
    got = {x.id: x for x in bench.microphone(spark.createDataFrame(rows, "id string, audio array<double>, elapsed_s double").repartition(3), fs, 2000.0).collect()}
    assert kinds(got["good"]) == set() and abs(got["good"].tone_off_pct) < 0.02 and got["good"].prominence_db > 40 and got["good"].distortion_db < -50
    assert kinds(got["distorted"]) == {"distorted"} and abs(got["distorted"].distortion_db - 20 * np.log10(0.15)) < 0.3
    assert kinds(got["shifted"]) == {"tone"} and abs(got["shifted"].tone_off_pct - 2.5) < 0.05 and "rate" in kinds(got["fast"]) and abs(got["fast"].rate_off_pct - 25) < 1e-9
    assert kinds(got["dc"]) == {"dc", "floor"} and {"clipped", "headroom"} <= kinds(got["loud"]) and {"floor", "faint"} <= kinds(got["noise"])  # an offset counts in the level of a frame
    assert {"dead", "stuck"} <= kinds(got["dead"]) and got["short"].tone_off_pct is None and kinds(got["none"]) == kinds(got["empty"]) == {"no_samples"}
    assert abs(got["good"].level_dbfs - 20 * np.log10(0.1 / np.sqrt(2))) < 0.01
