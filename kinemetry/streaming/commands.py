"""Commands on stored windows: "these were normal", as a stream that meets the stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinemetry.streaming.outbox import ROCKSDB

#: How far back a command may reach: what retention keeps. It bounds the readings that wait for one.
REACH = "7 days"


def named(readings: DataFrame, commands: DataFrame, late: str = "2 hours") -> DataFrame:
    """Readings (device_id, event_id, ts, score) that a command (device_id, ts_from, ts_to, issued) of their device names,
    each once, both ends of its span included.

    A command names readings of at most REACH before it was issued, and none after. Both sides have a watermark `late`
    behind their newest time, so a reading waits for commands no longer than REACH and that, and a command for readings no
    longer than that; a later row meets only what still waits. Nulls meet nothing."""
    conf = readings.sparkSession.conf
    # what waits lies in RocksDB, in one store for both sides of a partition, instead of maps on an executor's heap
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    conf.set("spark.sql.streaming.join.stateFormatVersion", "3")
    # a command goes to each day that it reaches (eight at most), so a reading is held against the commands of its day
    first, last = F.greatest("ts_from", F.col("issued") - F.expr(f"interval {REACH}")), F.least("ts_to", "issued")
    r = readings.select("device_id", "event_id", "score", "ts").withWatermark("ts", late).withColumn("day", F.to_date("ts")).alias("r")
    c = commands.select("device_id", "ts_from", "ts_to", "issued").withWatermark("issued", late).where(first <= last)
    c = c.withColumn("day", F.explode(F.sequence(F.to_date(first), F.to_date(last)))).alias("c")
    met = r.join(c, F.expr(f"r.device_id = c.device_id and r.day = c.day and r.ts between c.ts_from and c.ts_to and r.ts <= c.issued and r.ts >= c.issued - interval {REACH}"))
    return met.select("r.device_id", "r.event_id", "r.score", F.col("r.ts").alias("ts")).dropDuplicatesWithinWatermark(["device_id", "event_id"])
