"""A store of readings that micro-batches write: each batch one unit, keyed by its number.

A unit is the batch's readings, its anomalies and, last of all, its commit, which carries the newest time that is
trusted and so what retention keeps. What has no commit isn't there; a batch that is written again replaces itself.
So a run that is stopped anywhere and started anew gives the same tables. Days that retention has left go from disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinemetry.sources import folders

#: Seconds that readings are kept, and seconds by which a reading may be ahead of the clock.
KEEP, AHEAD = 7 * 86400.0, 3600.0
DAY = 86400.0


def _committed(spark: SparkSession, at: str) -> dict[int, str]:
    """Paths of the commits by batch: those that were finished."""
    named = [n for n in folders.names(spark, f"{at}/commits") if n.startswith("number=")]
    return {int(n[7:]): f"{at}/commits/{n}" for n in named if folders.exists(spark, f"{at}/commits/{n}/_SUCCESS")}


def _trusted(spark: SparkSession, at: str, before: int | None = None) -> float | None:
    """The newest trusted time that the last commit says (the last before a batch)."""
    done = {n: p for n, p in _committed(spark, at).items() if before is None or n < before}
    return spark.read.parquet(done[max(done)]).first()["newest"] if done else None


def write(batch: DataFrame, number: int, at: str, wall: float) -> None:
    """One unit of a batch (device_id, event_id, t, ..., anomalous). `wall` is the time by the clock in seconds: no reading
    moves the newest time farther than AHEAD beyond it, so one from a clock that jumped prunes nothing."""
    spark, day = batch.sparkSession, F.floor(F.col("t") / DAY).cast("int")
    batch.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{at}/readings/number={number}")
    rows = spark.read.parquet(f"{at}/readings/number={number}") if _any(spark, f"{at}/readings/number={number}") else None
    batch.where("anomalous").write.mode("overwrite").parquet(f"{at}/anomalies/number={number}")
    newest = None if rows is None else rows.agg(F.max("t").alias("t")).first()["t"]
    known = [v for v in (_trusted(spark, at, number), None if newest is None else min(newest, wall + AHEAD)) if v is not None]
    spark.createDataFrame([(max(known) if known else None,)], "newest double").coalesce(1).write.mode("overwrite").parquet(f"{at}/commits/number={number}")
    if known:
        _prune(spark, at, max(known) - KEEP)


def _any(spark: SparkSession, path: str) -> bool:
    return any(n.startswith("day=") for n in folders.names(spark, path))


def _prune(spark: SparkSession, at: str, oldest: float) -> None:
    for number in folders.names(spark, f"{at}/readings"):
        for day in folders.names(spark, f"{at}/readings/{number}"):
            if day.startswith("day=") and (int(day[4:]) + 1) * DAY <= oldest:
                folders.drop(spark, f"{at}/readings/{number}/{day}")


def readings(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """What is stored and kept: of rows of the same device and time the last that was written."""
    newest, done = _trusted(spark, at), _committed(spark, at)
    paths = [f"{at}/readings/number={n}" for n in sorted(done) if _any(spark, f"{at}/readings/number={n}")]
    if not paths or newest is None:
        return spark.createDataFrame([], schema)
    # the number of a batch is part of its path, so a row's place in order needs no column of its own
    rows = spark.read.option("basePath", f"{at}/readings").schema(f"{schema}, number int, day int").parquet(*paths).where(F.col("t") >= newest - KEEP)
    own = [c for c in rows.columns if c not in ("number", "day")]
    last = rows.groupBy("device_id", "t").agg(F.max_by(F.struct(*own), F.struct("number", "event_id")).alias("r"))
    return last.select("r.*")


def anomalies(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """Every anomaly of the committed batches; retention leaves them."""
    paths = [f"{at}/anomalies/number={n}" for n in sorted(_committed(spark, at))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def fold(stream: DataFrame, at: str, wall: float, checkpoint: str | None = None) -> None:
    """Everything that the stream has to say, written to the store below `at`. The checkpoint lies beside it unless one
    is named, so a second call goes on where the first ended."""
    (stream.writeStream.foreachBatch(lambda batch, number: write(batch, number, at, wall)).option("checkpointLocation", checkpoint or f"{at}/state")
     .trigger(availableNow=True).start().awaitTermination())
