import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinemetry.functions import arrays as A
from kinemetry.operators.gate import episodes, marked
from kinemetry.sources import readings, signals


def wav(samples, bits, channels=1, kind=1):
    body = samples.tobytes()
    head = struct.pack("<HHIIHH", kind, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def test_wav_kinds():
    assert signals.parse_wav(wav(np.array([0, 128, 255], np.uint8), 8))[1][:, 0].tolist() == [-1.0, 0.0, 127 / 128]
    assert signals.parse_wav(wav(np.array([-32768, 16384], "<i2"), 16))[1][:, 0].tolist() == [-1.0, 0.5]
    fs, x = signals.parse_wav(wav(np.array([0.25, -1, 0.5, 0], "<f4"), 32, 2, 3))
    assert fs == 8000 and x.tolist() == [[0.25, -1.0], [0.5, 0.0]]
    with pytest.raises(ValueError):
        signals.parse_wav(b"RIFF....AVI ")


def test_wav_files_and_windows(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(np.arange(10, dtype="<i2"), 16))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    got = signals.wav_files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: len(r.audio) for r in got.collect()} == {"a.wav": 10, "bad.wav": 0}
    w = signals.windows(got, F.lit(4), F.lit(3)).select("window", F.size("audio").alias("n")).collect()
    assert sorted((r.window, r.n) for r in w) == [(0, 4), (1, 4), (2, 4)]


def test_labels_of_names(spark):
    rows = spark.createDataFrame([("x/IR007_2.mat",), ("Normal_0.mat",), ("odd.csv",)], "p string")
    got = [r[0].asDict() for r in rows.select(signals.labelled(F.col("p"))).collect()]
    assert got[0] == {"healthy": False, "race": "IR", "fault_size_in": 0.007, "load_hp": 2}
    assert got[1]["healthy"] and got[1]["load_hp"] == 0
    assert not got[2]["healthy"] and got[2]["race"] is None


def gate(flags, need, clear):
    streak = quiet = 0
    held, out = False, []
    for i, f in enumerate(flags):
        streak, quiet = (streak + 1, 0) if f else (0, quiet + 1)
        if f and not held and streak >= need:
            held = True
            out.append(i + 1)
        elif not f and held and quiet >= clear:
            held = False
    return out


def test_gate_against_a_loop(spark):
    rng = random.Random(3)
    runs = {d: ([rng.random() < 0.6 for _ in range(40)], rng.randrange(1, 4), rng.randrange(1, 4)) for d in range(60)}
    rows = spark.createDataFrame([(d, i + 1, f, n, c) for d, (fs, n, c) in runs.items() for i, f in enumerate(fs)], "d int, idx int, f boolean, n int, c int")
    got = episodes(marked(rows, ["d"], ["idx"], "f", F.col("n"), F.col("c")), ["d"], ["idx"], "idx", F.col("n")).collect()
    for d, (fs, n, c) in runs.items():
        assert sorted(r.alert_idx for r in got if r.d == d) == gate(fs, n, c)


def test_messages_and_fields(spark):
    sent = spark.createDataFrame([("devices/1/telemetry", "{}"), ("devices/9/telemetry", "{}"), ("devices/1/other", "{}"), ("devices/1/status", "{"), ("x", "{}")], "topic string, payload string")
    assert readings.routed(sent, spark.createDataFrame([("1",)], "device_id string")).count() == 1
    one = spark.createDataFrame([(r"a\:b:c",)], "l string").select(readings.terse_fields(F.col("l"), 4)).first()[0]
    assert one == ["a:b", "c", "", ""]
    x = spark.createDataFrame([("nan",), ("Infinity",), ("7.5",), (None,), ("<b>",)], "x string").select(readings.finite(F.col("x"))).collect()
    assert [r[0] for r in x] == [None, None, 7.5, None, None]


def test_spectrum_is_numpys(spark):
    x = np.random.default_rng(0).normal(size=16)
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(A.magnitudes(F.col("x"), 16)).first()[0]
    assert np.allclose(got, np.abs(np.fft.rfft(x - x.mean())))
