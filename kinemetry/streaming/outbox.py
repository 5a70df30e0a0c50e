"""Devices' uplinks as keyed state: rows in the order of their time, alerts that wait for the link, retention.

Rows may arrive in any order within the lateness that their watermark allows. What the watermark has not passed waits
in the state; a timer of event time then takes each device's rows in their order through link, gate and queue. A key of
the outbox's state is a bucket of devices, whose rows wait as blocks: a call from Python to the state store takes
milliseconds, and there are as many of them as buckets, however many devices there are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Fixed value: alerts that wait for the link at most; beyond it the oldest go.
QUEUE = 500
#: Buckets of devices. A task holds the rows of one at a time; a stream keeps the number that it began with.
BUCKETS = 1024
#: Rows of a frame that is handed on.
ROWS = 50_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = ["device", "known", "t", "event_id", "flag", "link"]
HELD = ["device", "known", "t", "event_id"]
SENT = "device_id long, event_id long, t double, kind string, sent_t double, place int"


def _packed(rows: pd.DataFrame | pa.Table) -> tuple[bytes]:
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(block: tuple[bytes]) -> pa.Table:
    return pa.ipc.open_stream(block[0]).read_all()


def _frame(sent: list[tuple]) -> pd.DataFrame:
    """Rows of SENT; device ids stay whole numbers beside one that is null."""
    out = pd.DataFrame(sent, columns=[c.split()[0] for c in SENT.split(", ")])
    return out.assign(device_id=pd.array([r[0] for r in sent], dtype="Int64"))


class _OfBucket(StatefulProcessor):
    """State of a bucket of devices: rows as blocks, and one timer, at what is due first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, t: float, after: int = 0) -> None:
        at, had = max(int(t * 1000) + 1, after + 1), self.timer.get()
        if had is None or at < had[0]:
            if had is not None:
                self.handle.deleteTimer(had[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


class Outbox(_OfBucket):
    """Takes rows (bucket, device, known, event_id, t, flag, link, ts) of a bucket's devices (no id where not known) through
    the alert gate and a link that goes down and up (link `down`, `up` or null) and says what is sent: telemetry only
    while the link is up, each alert at once or when the link comes back, in order, the newest QUEUE of them."""

    def __init__(self, need: int, clear: int) -> None:
        self.need, self.clear = need, clear

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.gates = handle.getValueState("gates", "devices binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([b[ROW] for b in rows], ignore_index=True)
        new = new.assign(event_id=new["event_id"].astype("int64"), flag=new["flag"].fillna(False).astype(bool), link=new["link"].astype("category").cat.set_categories(["down", "up"]).cat.codes)
        self.waiting.appendValue(_packed(new))
        self._wake(float(new["t"].min()))
        yield _frame([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() / 1000
        self.timer.clear()
        rows = pa.concat_tables([_unpacked(b) for b in self.waiting.get()])
        is_due = rows["t"].to_numpy() <= until
        later = rows.filter(pa.array(~is_due))
        if len(later):
            self.waiting.put([_packed(later)])
            self._wake(float(later["t"].to_numpy().min()), timerValues.getCurrentWatermarkInMs())
        else:
            self.waiting.clear()
        due = [c.to_numpy()[is_due] for c in rows.select(ROW)]
        order = np.lexsort([due[i] for i in (5, 4, 3, 2, 0, 1)])  # by device, t, event_id; the last two part rows that came twice
        device, known, *rest = [c[order] for c in due]
        ends = np.flatnonzero((device[1:] != device[:-1]) | (known[1:] != known[:-1])) + 1
        block = self.gates.get()
        gates = {} if block is None else {(r.pop("device"), r.pop("known")): tuple(r.values()) for r in _unpacked(block).to_pylist()}
        sent = []
        for i, j in zip([0, *ends], [*ends, len(device)], strict=True) if len(device) else ():
            who = (int(device[i]), bool(known[i]))
            gates[who] = self._device(who[0] if who[1] else None, gates.get(who, (0, 0, False, True, [], [])), [c[i:j].tolist() for c in rest], sent)
            if len(sent) >= ROWS:
                yield _frame(sent)
                sent = []
        if len(device):
            names = ("streak", "quiet", "held", "up", "queue_t", "queue_id")
            held = [{"device": d, "known": k, **dict(zip(names, g, strict=True))} for (d, k), g in gates.items()]
            self.gates.update(_packed(pa.Table.from_pylist(held, GATES)))
        yield _frame(sent)

    def _device(self, device: int | None, gate: tuple, rows: list[list], sent: list[tuple]) -> tuple:
        """Takes a device's rows (t, event_id, flag, link) in their order through its gate, and adds to `sent`."""
        streak, quiet, held, up, queue_t, queue_id = gate
        queue = list(zip(queue_t, queue_id, strict=True))
        for t, event, flag, link in zip(*rows, strict=True):
            up = up if link < 0 else link == 1
            streak, quiet = (streak + 1, 0) if flag else (0, quiet + 1)
            fired = flag and not held and streak >= self.need
            held = fired or held and not (not flag and quiet >= self.clear)
            if fired:
                queue = [*queue, (t, event)][-QUEUE:]
            if up:
                sent += [(device, e, at, "alert", t, i + 1) for i, (at, e) in enumerate(queue)]
                sent.append((device, event, t, "telemetry", t, 0))
                queue = []
        return streak, quiet, held, up, [q[0] for q in queue], [q[1] for q in queue]


#: A device of a bucket: its gate, its link and the alerts that wait for it.
GATES = pa.schema([("device", pa.int64()), ("known", pa.bool_()), ("streak", pa.int64()), ("quiet", pa.int64()), ("held", pa.bool_()), ("up", pa.bool_()),
                   ("queue_t", pa.list_(pa.float64())), ("queue_id", pa.list_(pa.int64()))])


class Retained(_OfBucket):
    """Keeps the rows (bucket, device, known, event_id, t, ts) of a bucket's devices for `keep_s` seconds of event time, says
    `stored` of each new one and `pruned` of each that goes. A row delivered again changes nothing; one that is too old
    by now isn't stored."""

    def __init__(self, keep_s: float) -> None:
        self.keep_s = keep_s

    def _oldest(self, timerValues: TimerValues) -> float:
        return timerValues.getCurrentWatermarkInMs() / 1000 - self.keep_s

    def _held(self) -> pd.DataFrame:
        return pa.concat_tables([_unpacked(b) for b in self.waiting.get()]).to_pandas() if self.waiting.exists() else pd.DataFrame(columns=HELD)

    def _said(self, rows: pd.DataFrame, action: str) -> pd.DataFrame:
        device = rows["device"].astype("Int64").where(rows["known"].astype(bool))
        return pd.DataFrame({"device_id": device, "event_id": rows["event_id"].astype("int64"), "t": rows["t"].astype(float), "action": action})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([b[HELD] for b in rows], ignore_index=True)
        new = new[new["t"] > self._oldest(timerValues)].astype({"event_id": "int64"})
        held, by = self._held(), ["device", "known", "event_id"]
        every = pd.concat([held[by], new[by]]) if len(held) else new[by]
        new = new[~every.duplicated().to_numpy()[len(held) :]]
        if len(new):
            self.waiting.appendValue(_packed(new))
            self._wake(float(new["t"].min()) + self.keep_s)
        yield self._said(new, "stored")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        held = self._held()
        gone = held["t"] <= self._oldest(timerValues)
        left = held[~gone]
        if len(left):
            self.waiting.put([_packed(left)])
            self._wake(float(left["t"].min()) + self.keep_s, timerValues.getCurrentWatermarkInMs())
        else:
            self.waiting.clear()
        yield self._said(held[gone], "pruned")


def _stateful(rows: DataFrame, columns: list[str], processor: StatefulProcessor, schema: str, late: str, buckets: int) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    dealt = rows.where("t is not null and ts is not null").select(
        F.pmod(F.xxhash64("device_id"), F.lit(buckets)).cast("int").alias("bucket"), F.coalesce("device_id", F.lit(0)).cast("long").alias("device"),
        F.col("device_id").isNotNull().alias("known"), *columns, "ts")
    return dealt.withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")


def sent(rows: DataFrame, need: int, clear: int, late: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """What the devices of a stream (device_id, event_id, t, flag, link, ts) send (SENT): see Outbox. Rows without a time
    never come to their turn."""
    return _stateful(rows, ROW[2:], Outbox(need, clear), SENT, late, buckets)


def retained(rows: DataFrame, keep_s: float, late: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """What the store of a stream (device_id, event_id, t, ts) does with its rows: see Retained."""
    return _stateful(rows, HELD[2:], Retained(keep_s), "device_id long, event_id long, t double, action string", late, buckets)
