import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from kinemetry.plans import live
from kinemetry.streaming import commands, outbox, store

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def stream_of(spark, at, schema, batches):
    """A stream whose micro-batches are these lists of rows, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/tmp-{i}")
        name = next(n for n in os.listdir(f"{at}/tmp-{i}") if n.startswith("part-"))
        os.makedirs(f"{at}/in", exist_ok=True)
        os.rename(f"{at}/tmp-{i}/{name}", f"{at}/in/{i:03}.parquet")
        os.utime(f"{at}/in/{i:03}.parquet", (1e9 + i, 1e9 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_commands_name_stored_windows_and_late_rows_are_dropped(spark, tmp_path):
    reading, command = "device_id long, event_id long, score double, ts timestamp", "device_id long, ts_from timestamp, ts_to timestamp, issued timestamp"
    readings = [[(1, 1, 0.5, at(0)), (1, 2, 0.5, at(1)), (2, 3, 0.5, at(1)), (1, 4, None, at(1.5)), (1, None, 0.5, None)],
                [(1, 5, 0.5, at(100)), (1, 6, 0.5, at(98.5))],
                [(1, 7, 0.5, at(90))],  # late, but what names it still waits
                [(1, 8, 0.5, at(400))], [(1, 9, 0.5, at(402))],
                [(1, 10, 0.5, at(1.2))], [(1, 11, 0.5, at(403))]]  # the commands of then are gone
    said = [[(1, at(0.5), at(2), at(3)), (1, at(1), at(1.5), at(3)), (None, at(0), at(9), at(9)), (3, at(0), at(9), at(9))],
            [(1, at(80), at(101), at(102))], [(2, None, at(3), at(60))],
            [(1, at(0), at(400), at(401))], [(1, at(300), at(301), at(402))],
            [(1, at(0), at(0.2), at(50))], [(1, at(300), at(301), at(403))]]  # the reading that it names is gone
    r, c = stream_of(spark, tmp_path / "r", reading, readings), stream_of(spark, tmp_path / "c", command, said)
    got = sorted(x.event_id for x in live.run(commands.named(r, c)).collect())
    # 2 and 4 once, though two spans hold them; 3 is another device's; 1 lies before one span, and over seven days before the other
    assert got == [2, 4, 5, 6, 7, 8]


def test_readings_wait_for_commands_of_their_day_in_one_store(spark, tmp_path):
    reading, command = "device_id long, event_id long, score double, ts timestamp", "device_id long, ts_from timestamp, ts_to timestamp, issued timestamp"
    readings = [(1, i, 0.5, at(i)) for i in range(24 * 9)]
    said = [(1, at(-900), at(900), at(200)), (1, at(20), at(50), at(60)), (1, at(9), at(5), at(60)), (1, None, at(5), at(6)), (1, at(1), None, at(6)), (1, at(1), at(5), None)]
    r, c = stream_of(spark, tmp_path / "r", reading, [readings]), stream_of(spark, tmp_path / "c", command, [said])
    q = commands.named(r, c).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(x.event_id for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [*range(20, 201)]
    join = next(o for o in q.recentProgress[0]["stateOperators"] if o["operatorName"] == "symmetricHashJoin")
    assert join["numStateStoreInstances"] == join["numShufflePartitions"]
    assert any(m.startswith("rocksdb") for m in join["customMetrics"])


def outbox_of(rows, need, clear):
    """The same in order, device by device."""
    out = []
    for device in {r[0] for r in rows}:
        streak, quiet, held, up, queue = 0, 0, False, True, []
        for _, event, t, flag, link in sorted((r for r in rows if r[0] == device), key=lambda r: (r[2], r[1])):
            up = link == "up" if link else up
            streak, quiet = (streak + 1, 0) if flag else (0, quiet + 1)
            if flag and not held and streak >= need:
                held = True
                queue.append(event)
            elif not flag and held and quiet >= clear:
                held = False
            if up:
                out += [(device, e, "alert", t, i + 1) for i, e in enumerate(queue[-outbox.QUEUE :])] + [(device, event, "telemetry", t, 0)]
                queue = []
    return sorted(out)


def test_shuffled_rows_leave_the_outbox_in_order(spark, tmp_path, monkeypatch):
    r = random.Random(9)
    rows = []
    for i in range(900):
        t = START.timestamp() + 60.0 * i
        rows += [(d, 1000 * d + i, t, r.random() < 0.6, r.choice([None] * 30 + ["down", "up"])) for d in (1, 2, 3)]
    # a long outage with more alerts than wait
    rows += [(9, i, START.timestamp() + 30.0 * i, i % 3 > 0, "down" if i == 0 else "up" if i == 1790 else None) for i in range(1795)]
    end = START.timestamp() + 60.0 * 900
    rows.sort(key=lambda x: x[2] + r.random() * 3000)  # each at most 50 minutes late
    batches = [rows[i : i + 1200] for i in range(0, len(rows), 1200)]
    batches.append([(99, 1, end + 9000, False, None)])  # the watermark passes all of them
    schema = "device_id long, event_id long, t double, flag boolean, link string, ts timestamp"
    full = [[(*x, dt.datetime.fromtimestamp(x[2], dt.timezone.utc)) for x in b] for b in batches]
    got = live.run(outbox.sent(stream_of(spark, tmp_path, schema, full), 2, 1)).where("device_id < 99").collect()
    want = outbox_of(rows, 2, 1)
    assert sorted((x.device_id, x.event_id, x.kind, x.sent_t, x.place) for x in got) == want
    late = [w for w in want if w[0] == 9 and w[2] == "alert" and w[3] == START.timestamp() + 30.0 * 1790]
    assert len(late) == outbox.QUEUE and late[0][1] > 200


def test_outbox_state_has_a_key_per_bucket_not_per_device(spark, tmp_path):
    r = random.Random(3)
    devices = [None, 0, 2**53 + 1, *range(1, 120)]
    rows = [(d, 100 * k + i, START.timestamp() + 60.0 * i + k / 8, r.random() < 0.7, r.choice([None, None, "down", "up"])) for i in range(12) for k, d in enumerate(devices)]
    rows.append(rows[40])  # came twice
    cut = len(rows) // 2
    rows = [(8, 5, None, True, None), *rows]  # without a time
    batches = [rows[:cut], [(999, 1, START.timestamp() + 9000, False, None), *rows[cut:]], [(999, 2, START.timestamp() + 90000, False, None)]]
    schema = "device_id long, event_id long, t double, flag boolean, link string, ts timestamp"
    full = [[(*x, x[2] and dt.datetime.fromtimestamp(x[2], dt.timezone.utc)) for x in b] for b in batches]
    out = outbox.sent(stream_of(spark, tmp_path, schema, full), 2, 1)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(-1 if x.device_id is None else x.device_id, x.event_id, x.kind, x.sent_t, x.place) for x in spark.read.parquet(str(tmp_path / "out")).collect() if x.device_id != 999]
    assert sorted(got) == outbox_of([(-1 if r[0] is None else r[0], *r[1:]) for r in rows[1:]], 2, 1)
    # after the first batch the rows wait in a block, under the keys of the buckets they fell into
    small = outbox.sent(stream_of(spark, tmp_path / "b", schema, full[:1]), 2, 1, buckets=4)
    q = small.writeStream.format("parquet").option("path", str(tmp_path / "b" / "out")).option("checkpointLocation", str(tmp_path / "b" / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.recentProgress[0]["stateOperators"][0]["numRowsTotal"] < 30


def test_state_keeps_a_week_and_knows_what_came_twice(spark, tmp_path):
    schema = "device_id long, event_id long, t double, ts timestamp"
    row = lambda event, hours: (1, event, at(hours).timestamp(), at(hours))
    batches = [[row(1, 0), row(2, 100), row(1, 0)], [row(1, 0), row(3, 171)], [row(4, 260)], [row(5, 300), row(6, 262)], [row(7, 300)]]
    got = [(x.event_id, x.action) for x in live.run(outbox.retained(stream_of(spark, tmp_path, schema, batches), store.KEEP)).collect()]
    assert sorted(got) == sorted([(e, "stored") for e in (1, 2, 3, 4, 5, 6, 7)] + [(1, "pruned"), (2, "pruned")])


def test_retention_state_has_a_key_per_bucket_not_per_row(spark, tmp_path):
    schema = "device_id long, event_id long, t double, ts timestamp"
    row = lambda device, event, hours: (device, event, at(hours).timestamp(), at(hours))
    old = [row(d, 1, 0.01 * i) for i, d in enumerate([None, 0, 2**53 + 1, *range(1, 60)])]
    batches = [[*old, row(7, 2, 100), old[5]], [*old[3:9], (5, 9, None, None), row(None, 2, 171)], [row(7, 3, 300)]]
    out = outbox.retained(stream_of(spark, tmp_path, schema, batches), store.KEEP, buckets=4)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((str(x.device_id), x.event_id, x.action) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    ids = [(str(r[0]), r[1]) for r in old] + [("7", 2), ("None", 2), ("7", 3)]
    assert got == sorted([(*i, "stored") for i in ids] + [(*i, "pruned") for i in ids[: len(old) + 1]])
    assert q.recentProgress[0]["stateOperators"][0]["numRowsTotal"] < 30


class Stopped(Exception):
    pass


@pytest.mark.parametrize("where", ["anomalies", "commits", "after"])
def test_a_stopped_run_goes_on_to_the_same_store(spark, tmp_path, where, monkeypatch):
    r = random.Random(1)
    batches = [[(d, 100 * i + d, at(24.0 * i + d).timestamp(), "a", r.random(), r.random() < 0.3) for d in range(5)] for i in range(12)]
    batches[4].append((1, 7, at(24.0 * 4 + 1).timestamp(), "b", 2.0, True))  # again, a later row of the same time
    batches[6].append((1, 1, at(1).timestamp(), "late", 3.0, False))  # already past retention later
    batches[8].append((1, 9, at(90_000).timestamp(), "jump", 3.0, False))  # a clock that jumped
    wall = at(24.0 * 12).timestamp()

    def rows(at):
        return sorted(map(tuple, store.readings(spark, at, live.STORED).collect())), sorted(map(tuple, store.anomalies(spark, at, live.STORED).collect()))

    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    store.fold(stream_of(spark, tmp_path / "a", live.STORED, batches), whole, wall)
    real, made = store._prune if where == "after" else store._any if where == "anomalies" else store._trusted, []

    def stop(*args):
        if len(made) == 5 and made.append(0) is None:
            raise Stopped
        if len(made) < 5:
            made.append(0)
        return real(*args)

    monkeypatch.setattr(store, real.__name__, stop)
    stream = stream_of(spark, tmp_path / "b", live.STORED, batches)
    with pytest.raises(Exception, match="Stopped"):
        store.fold(stream, cut, wall)
    store.fold(stream, cut, wall)
    monkeypatch.undo()
    assert rows(cut) == rows(whole)
    kept, bad = rows(whole)
    newest = min(max(x[2] for b in batches for x in b), wall + store.AHEAD)
    want = {(x[0], x[2]): x for b in batches for x in b if x[2] >= newest - store.KEEP}
    assert kept == sorted(want.values()) and bad == sorted(x for b in batches for x in b if x[5])
    store.write(spark.createDataFrame(batches[11], live.STORED), 11, whole, wall)  # the last unit again
    assert rows(whole) == (kept, bad)
    assert store.readings(spark, str(tmp_path / "none"), live.STORED).count() == 0
