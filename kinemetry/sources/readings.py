"""The canonical readings, and how raw telemetry becomes one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinemetry.operators.quantiles import quantiles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def readings(events: DataFrame, quantile: float = 0.75) -> DataFrame:
    """device_id, event_id, ts, t (epoch seconds), regime, score, threshold, anomalous, idx.

    The threshold is the regime's quantile of all scores, rounded to six digits; the regimes are few,
    so the thresholds are joined as a small side that Spark may broadcast; a regime without any score has none. idx counts a device's
    windows in time order, from 1."""
    limits = quantiles(events, ["event_type"], "value", [quantile]).select(F.col("event_type").alias("regime"), F.round(F.col("q")[0], 6).alias("threshold"))
    base = events.select(F.col("user_id").alias("device_id"), "event_id", "ts", epoch(F.col("ts")).alias("t"), F.col("event_type").alias("regime"), F.col("value").alias("score"), "props")
    order = Window.partitionBy("device_id").orderBy("t", "event_id")
    return (base.where("regime is not null").join(limits, "regime", "left").withColumn("anomalous", F.col("score") > F.col("threshold"))
            .withColumn("idx", F.row_number().over(order)))


def finite(value: Column) -> Column:
    """A number from anything: null for text that is none, for NaN and the infinities."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def routed(messages: DataFrame, devices: DataFrame, topic: str = "topic", payload: str = "payload") -> DataFrame:
    """Messages of topics `devices/<id>/<kind>` with a known kind, valid JSON and a registered device."""
    parts = F.split(topic, "/")
    kinds = ("telemetry", "anomaly", "status")
    return (messages.withColumn("device_id", parts[1]).withColumn("kind", parts[2])
            .where((F.size(parts) == 3) & F.col("kind").isin(*kinds) & F.try_parse_json(F.col(payload)).isNotNull())
            .join(devices.select("device_id").distinct(), "device_id", "left_semi"))


def terse_fields(line: Column, n: int) -> Column:
    r"""The fields of a `:`-separated line whose own colons are written `\:`, padded with '' to n."""
    parts = F.transform(F.split(F.regexp_replace(line, r"\\:", "\x01"), ":"), lambda x: F.replace(x, F.lit("\x01"), F.lit(":")))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, F.greatest(F.lit(n), F.size(parts)))
