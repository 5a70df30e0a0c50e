import json
import struct

import numpy as np
from pyspark.sql import functions as F

from kinemetry.operators import features
from kinemetry.sources import bundles


def wav(x, fs=8000):
    body = np.round(np.asarray(x) * 32768).astype("<i2").tobytes()
    channels = np.ndim(x) if np.ndim(x) == 1 else np.shape(x)[1]
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, fs, 2 * channels * fs, 2 * channels, 16) + b"data" + struct.pack("<I", len(body)) + body


def csv(n, fs, axes=3, by=","):
    return "\n".join([by.join(["t_s", *"xyz"[:axes]]), *(by.join(repr(float(v)) for v in (i / fs, *[i * (a + 1) for a in range(axes)])) for i in range(n))])


def test_bundles_and_windows_on_one_clock(spark, tmp_path):
    r = np.random.default_rng(1)
    x = np.round(r.uniform(-0.5, 0.5, 8000 * 3 + 100) * 32768) / 32768
    (tmp_path / "run").mkdir()
    at = tmp_path / "run"
    (at / "whole.wav").write_bytes(wav(x))
    (at / "whole.csv").write_text(csv(1600 * 2 + 5, 1600.0, by="\t"))
    (at / "whole.json").write_text(json.dumps({"machine": "fan"}))
    (at / "sound.WAV").write_bytes(wav(np.stack([x[:16000], -x[:16000]], 1)))
    (at / "one.axis.wav").write_bytes(wav(x[:8000]))
    (at / "one.axis.csv").write_text(csv(1600, 1600.0, axes=1))
    (at / "moved.csv").write_text(csv(50, 100.0))
    (at / "bad.wav").write_bytes(b"nothing")
    (at / "bad.csv").write_text("t,x\n0,1\n0,2\n0,3\n0,4")
    (at / "bad.json").write_text("{")
    (at / "notes.md").write_text("left alone")
    found = bundles.bundles(spark, str(tmp_path))
    got = {b.stem.rsplit("/", 1)[1]: b for b in found.collect()}
    assert set(got) == {"whole", "sound", "one.axis", "moved", "bad"}
    assert got["whole"].missing == got["whole"].findings == [] and json.loads(got["whole"].sidecar) == {"machine": "fan"} and abs(got["whole"].fs_accel - 1600) < 1e-6
    assert got["sound"].missing == ["acceleration", "sidecar"] and got["moved"].missing == ["audio", "sidecar"] and got["one.axis"].accel_y is None
    assert got["bad"].missing == [] and [f.split(":")[0] for f in got["bad"].findings] == ["audio", "acceleration", "sidecar"] and got["bad"].audio is None
    assert np.allclose(got["sound"].audio, x[:16000])
    w = {(b.stem.rsplit("/", 1)[1], b.window): b for b in bundles.windows(found, 1.0).collect()}
    assert set(w) == {("whole", 0), ("whole", 1), ("sound", 0), ("sound", 1), ("one.axis", 0)}  # two seconds of acceleration end the third
    for i in (0, 1):
        assert np.allclose(w["whole", i].audio, x[8000 * i : 8000 * (i + 1)]) and np.allclose(w["whole", i].accel_z, 3 * np.arange(1600 * i, 1600 * (i + 1)))
        assert w["sound", i].accel_x == [0.0] * 6400 and w["sound", i].fs_accel == 6400.0
    assert w["one.axis", 0].accel_y == [0.0] * 1600 and w["one.axis", 0].accel_x[7] == 7.0
    made = features.with_features(bundles.windows(found, 1.0)).where(F.col("vector").isNotNull())
    assert made.count() == 5 and len(made.first().vector) == 37
    assert bundles.windows(found.limit(0)).count() == 0
