"""The live path: readings scored against thresholds, and the alert gate as keyed state.

Rows of a device are ordered within a micro-batch; a row that arrives after later ones of its device
counts where it arrives. Fed in time order, the stream gives the alerts of the batch gate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALERT = "device_id long, event_id long, t double, windows long"
STATE = "streak long, quiet long, held boolean"


def scored(events: DataFrame, thresholds: DataFrame) -> DataFrame:
    """A stream of events against the static thresholds of their regimes (regime, threshold)."""
    ts = F.col("ts").cast("timestamp")
    return (events.select(F.col("user_id").alias("device_id"), "event_id", (F.unix_micros(ts) / 1e6).alias("t"), F.col("event_type").alias("regime"), F.col("value").alias("score"))
            .join(thresholds, "regime").withColumn("anomalous", F.col("score") > F.col("threshold")))


def alerts(flags: DataFrame, need: int, clear: int = 2) -> DataFrame:
    """One row per alert of a stream with device_id, event_id, t and anomalous: the window that fired
    it, and how many windows had persisted."""
    need = max(1, need)

    def feed(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, quiet, held = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        fired = []
        for event, t, flag in zip(rows["event_id"], rows["t"], rows["anomalous"], strict=True):
            streak, quiet = (streak + 1, 0) if flag else (0, quiet + 1)
            if flag and not held and streak >= need:
                held = True
                fired.append((key[0], event, t, streak))
            elif not flag and held and quiet >= clear:
                held = False
        state.update((streak, quiet, held))
        yield pd.DataFrame(fired, columns=["device_id", "event_id", "t", "windows"])

    return flags.groupBy("device_id").applyInPandasWithState(feed, ALERT, STATE, "append", "NoTimeout")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly mean score of each device, of rows at most `late` behind the newest."""
    rows = events.select(F.col("user_id").alias("device_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"))
    return rows.withWatermark("ts", late).groupBy("device_id", F.window("ts", "1 hour").alias("w")).agg(F.avg("score").alias("mean")).select("device_id", F.col("w.start").alias("hour"), "mean")
