import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinemetry.sources import recordings, signals


def csv(rows, header=""):
    return (header + "\n".join(",".join(repr(float(v)) for v in r) for r in rows)).encode()


@pytest.fixture
def parse(spark):
    def one(data, **more):
        return recordings.csv_signals(spark.createDataFrame([("p", data.decode())], "path string, text string"), **more).first()

    return one


def test_csv_with_time_and_header(parse):
    got = parse(csv([(i / 100, i, -i) for i in range(50)], "t_s,x,y\n"))
    assert got["header"] and got["time_column"] and abs(got["fs"] - 100) < 1e-9 and got["channels"] == 2
    assert got["samples"] == [[float(i) for i in range(50)], [-float(i) for i in range(50)]] and got["jitter"] < 1e-9 and abs(got["seconds"] - 0.49) < 1e-12


@pytest.mark.parametrize("by", [",", ";", "\t"])
def test_csv_by_any_separator(parse, by):
    rows = [(i / 100, i, -i) for i in range(50)]
    for head in ("", "t_s,x,y\n", "\ufeff\n t,x ,y\n\n"):
        got = parse(csv(rows, head).decode().replace(",", f" {by}" if by != "\t" else by).replace("\n", "\r\n").encode())
        assert got["error"] is None and got["header"] == bool(head) and got["time_column"] and got["samples"][1] == [-float(i) for i in range(50)]
    assert parse(csv(rows).replace(b",", by.encode()), channel=1)["samples"] == [[-float(i) for i in range(50)]]


def test_csv_without_header_keeps_its_first_row(parse):
    got = parse(csv([(v,) for v in (3, 1, 4, 1, 5)]), fs=8000.0)
    assert not got["header"] and not got["time_column"] and got["samples"] == [[3, 1, 4, 1, 5]] and got["fs"] == 8000


def test_lost_rows_are_jitter_and_not_a_refusal(parse):
    t = [i / 100 for i in range(200) if i != 90]
    got = parse(csv([(v, 0) for v in t]))
    assert got["time_column"] and abs(got["jitter"] - 1) < 1e-6
    is_time = lambda t: parse(csv([(v, 0) for v in t]), fs=1.0)["time_column"]
    assert not is_time([0, 1, 2, 9, 10, 30.0]) and not is_time(range(6, 20)) and not is_time([0, 1, 1, 2.0]) and is_time(range(5, 20))


@pytest.mark.parametrize("data, more, says", [
    (b"", {}, "empty"), (b"a,b\n", {}, "no numeric rows"), (b"1\n2\n3\n", {"fs": 8.0}, "only 3 rows"), (b"1\n2\n1\n2\n", {}, "no stated rate"), (b"1\nx\n1\n2\n", {"fs": 8.0}, "x"),
    (b"1,2\n3\n4,5\n6,7", {"fs": 8.0}, "row of numbers: 3"), (b"1,2\n3,\n4,5\n6,7", {"fs": 8.0}, "row of numbers: 3,"),
    (csv([(i / 100, 1) for i in range(9)]), {"fs": 102.0}, "stated rate 102.000 Hz, but 100.000"), (csv([(i / 100, 1) for i in range(9)]), {"channel": 1}, "no channel 1"),
    (csv([(1, 1), (2, 1), (2, 1), (3, 1)]), {"strict": True}, "rising")])
def test_csv_refusals(parse, data, more, says):
    got = parse(data, **more)
    assert says in got["error"] and got["findings"][0] == got["error"] and got["samples"] is None and got["fs"] is None


def test_csv_gives_all_its_findings(parse):
    assert parse(b"1\n2\n3\n", channel=3)["findings"] == ["only 3 rows", "no time column and no stated rate", "no channel 3 among 1"]


def test_files_of_all_kinds_and_round_trip(spark, tmp_path):
    made = spark.createDataFrame([("a", 8000.0, [0.25, -0.5, 0.75]), ("loud", 8000.0, [2.0, -4.0]), ("none", 8000.0, None), ("zero", 8000.0, [])], "name string, fs double, audio array<double>")
    got = {r.name: r for r in recordings.canonical(made).collect()}
    assert got["none"].wav is None and got["none"].sha256 is None and got["a"].applied_gain == 1
    assert got["a"].sha256 == hashlib.sha256(got["a"].wav).hexdigest()
    assert signals.parse_wav(bytes(got["a"].wav))[1][:, 0].tolist() == [0.25, -0.5, 0.75]
    assert np.allclose(signals.parse_wav(bytes(got["loud"].wav))[1][:, 0], [0.45, -0.9], atol=1e-4)
    for name in ("a", "zero"):
        (tmp_path / f"{name}.wav").write_bytes(bytes(got[name].wav))
    (tmp_path / "t.csv").write_bytes(csv([(i / 100, i) for i in range(9)]))
    (tmp_path / "bad.csv").write_bytes(b"t,x\n")
    (tmp_path / "m.mat").write_bytes(b"x")
    (tmp_path / "not.csv").write_bytes(b"\xff\xfe1,2")
    rows = {r.path.rsplit("/", 1)[1]: r for r in recordings.signal_files(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].samples == [[0.25, -0.5, 0.75]] and rows["zero.wav"].samples == [[]] and rows["t.csv"].channels == 1
    assert rows["bad.csv"].error == "no numeric rows" and "mat" in rows["m.mat"].error and rows["m.mat"].samples is None and rows["not.csv"].error == "not UTF-8" and len(rows) == 6
    only = recordings.signal_files(spark, str(tmp_path), need=8000.0).where("error is null").select(F.regexp_extract("path", "([^/]+)$", 1).alias("p"))
    assert sorted(r.p for r in only.collect()) == ["a.wav", "zero.wav"]
