"""The live path as streams that read what is there and end: each writes a table, which the query returns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinemetry.plans.monitoring import BASE, CLEAR, LEARNED, NEED, STARTED, STARTUP, _gate, mismatch
from kinemetry.operators.gate import marked
from kinemetry.sources.folders import folder
from kinemetry.sources.readings import readings, table
from kinemetry.streaming import commands, gate, outbox, store

TIERED = "event_id long, tier string, ts_from double, ts_to double, persisted_minutes double"
#: Fixed value: seconds of a window.
WINDOW_S = 30.0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    # a pattern, as a stream takes a plain path for a folder; the table may be a file or a folder
    return spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parque[t]")


def run(stream: DataFrame) -> DataFrame:
    """Everything that an append stream has to say, as a table."""
    at = folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = readings(table(spark, sf_dir, "events")).select("regime", "threshold").distinct()
    return gate.scored(_events(spark, sf_dir), limits)


def stream_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier for every window, from the gate fed with that same window; the window that fires an alert also says since when."""
    def feed(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak, quiet, held = state.get if state.exists else (0, 0, False)
        out = []
        for event, t, flag in sorted((r for b in batches for r in zip(b["event_id"], b["t"], b["anomalous"], strict=True)), key=lambda r: (r[1], r[0])):
            streak, quiet = (streak + 1, 0) if flag else (0, quiet + 1)
            fired = flag and not held and streak >= NEED
            held = held and not (not flag and quiet >= CLEAR) or fired
            out.append((event, "red" if held else "amber" if flag else "green", t - NEED * WINDOW_S if fired else None, t if fired else None, NEED * WINDOW_S / 60 if fired else None))
        state.update((streak, quiet, bool(held)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TIERED.split(", ")])

    rows = run(_scored(spark, sf_dir).groupBy("device_id").applyInPandasWithState(feed, TIERED, gate.STATE, "append", "NoTimeout"))
    return rows.select("event_id", "tier", *[F.round(c, 6).alias(c) for c in ("ts_from", "ts_to", "persisted_minutes")])


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means, of the hours that rows at most two hours late can't change any more."""
    return run(gate.hourly(_events(spark, sf_dir))).select("device_id", F.round(F.unix_micros("hour") / 3.6e9, 0).cast("long").alias("hour"), F.round("mean", 6).alias("mean"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are delivered twice are kept once."""
    e = _events(spark, sf_dir).select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    twice = e.unionByName(_events(spark, sf_dir).select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")))
    kept = run(twice.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]))
    return kept.groupBy("event_type").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 3).alias("total"))


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("device_id").agg(F.max_by(F.struct("at", "value"), "at").alias("r")).select("device_id", "r.*")


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's newest reading: every micro-batch leaves its own, under its number, and the newest of them counts."""
    at = folder(spark)
    e = _events(spark, sf_dir).select(F.col("user_id").alias("device_id"), F.struct("ts", "event_id").alias("at"), "value")
    e.writeStream.foreachBatch(lambda batch, number: _newest(batch).write.mode("overwrite").parquet(f"{at}/folds/number={number}")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = _newest(spark.read.schema(e.schema).parquet(f"{at}/folds"))
    return rows.select("device_id", F.col("at.event_id").alias("event_id"), F.round("value", 6).alias("value"))


def stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored windows that commands say were normal: a command, given with an alert, names the windows from its first on."""
    gated = marked(readings(table(spark, sf_dir, "events")), ["device_id"], ["t", "event_id"], "anomalous", F.lit(NEED), F.lit(CLEAR))
    first = F.lag("ts", NEED - 1).over(Window.partitionBy("device_id").orderBy("t", "event_id"))
    spans = gated.withColumn("first", first).where("alert").select("device_id", *[F.col(a).cast("timestamp").alias(b) for a, b in (("first", "ts_from"), ("ts", "ts_to"), ("ts", "issued"))])
    at = folder(spark)
    spans.write.parquet(f"{at}/commands")
    told = spark.readStream.schema(spans.schema).parquet(f"{at}/commands")
    r = _events(spark, sf_dir).select(F.col("user_id").alias("device_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"))
    return run(commands.named(r, told)).select("device_id", "event_id", F.round("score", 6).alias("score"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events; the link goes down with an `error` and comes back with a `signup`."""
    link = F.when(F.col("regime") == "error", "down").when(F.col("regime") == "signup", "up")
    return _scored(spark, sf_dir).select("device_id", "event_id", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")).alias("ts"), "t", F.col("anomalous").alias("flag"), link.alias("link"))


def stream_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What devices send over a link that goes down: telemetry of when it is up, alerts at once or when it comes back."""
    rows = run(outbox.sent(_linked(spark, sf_dir), NEED, CLEAR))
    return rows.select("device_id", "event_id", "kind", F.round("sent_t", 6).alias("sent_t"), F.col("place").cast("long").alias("place"))


def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a device's state holds at the end of the stream: those of the last week."""
    rows = run(outbox.retained(_linked(spark, sf_dir).select("device_id", "event_id", "t", "ts"), store.KEEP))
    return rows.groupBy("device_id").agg(F.count(F.when(F.col("action") == "stored", 1)).alias("stored"), F.count(F.when(F.col("action") == "pruned", 1)).alias("pruned"))


STORED = "device_id long, event_id long, t double, regime string, score double, anomalous boolean"


def stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that the store keeps, by regime, and all its anomalies; the clock stands 29 days after the first reading."""
    wall = table(spark, sf_dir, "events").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).first()["t"]
    at = folder(spark)
    store.fold(_scored(spark, sf_dir).select("device_id", "event_id", "t", "regime", "score", "anomalous"), at, (wall or 0.0) + 29 * 86400)
    kept, bad = store.readings(spark, at, STORED), store.anomalies(spark, at, STORED)
    return (kept.groupBy("regime").agg(F.count("*").alias("kept")).join(bad.groupBy("regime").agg(F.count("*").alias("anomalies")), "regime", "full")
            .select("regime", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "anomalies")]))


def stream_startup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each device once the windows of its start are in: the share above the threshold, their median ratio, and
    the 95th percentile of the learn windows before them."""
    def feed(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        had = len(seen)
        new = sorted(r for b in batches for r in zip(b["t"], b["event_id"], b["score"] / b["threshold"], strict=True))
        seen = (seen + [float(r[2]) for r in new])[: LEARNED + STARTUP]
        state.update((seen,))
        if had < len(seen) == LEARNED + STARTUP:
            learned, s = pd.Series(seen[:LEARNED]), pd.Series(seen[LEARNED:])
            yield pd.DataFrame({"device_id": [key[0]], "share": [float((s > 1).mean())], "median": [float(s.median())], "p95": [float(learned.quantile(0.95))]})

    rows = run(_scored(spark, sf_dir).where("threshold > 0").groupBy("device_id").applyInPandasWithState(feed, "device_id long, share double, median double, p95 double", "seen array<double>", "append", "NoTimeout"))
    return rows.select("device_id", *[F.round(c, 6).alias(c) for c in ("share", "median", "p95")], mismatch(F.col("share"), F.col("median"), F.col("p95")).alias("mismatch"))


SQL = {
    "stream_tiers": BASE + _gate() + f""" SELECT event_id, CASE WHEN in_episode THEN 'red' WHEN anomalous THEN 'amber' ELSE 'green' END AS tier, CASE WHEN alert THEN round(t - {NEED * WINDOW_S}, 6) END AS ts_from, CASE WHEN alert THEN round(t, 6) END AS ts_to,
  CASE WHEN alert THEN {NEED * WINDOW_S / 60}::DOUBLE END AS persisted_minutes FROM g""",
    "stream_hourly": "SELECT user_id AS device_id, (epoch_us(ts) // 3600000000)::BIGINT AS hour, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2 HAVING (max(epoch_us(ts) // 3600000000) + 1) * 3600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 7200000000 FROM events)",
    "stream_ingest": "SELECT event_type, count(*) AS rows, round(sum(value), 3) AS total FROM events GROUP BY 1",
    "stream_state": "SELECT user_id AS device_id, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_feedback": BASE + _gate() + f""", a AS (SELECT *, lag(ts, {NEED - 1}) OVER (PARTITION BY device_id ORDER BY t, event_id) AS ts_from FROM g)
SELECT DISTINCT r.device_id, r.event_id, round(r.score, 6) AS score FROM r JOIN a ON a.alert AND a.device_id = r.device_id AND r.ts BETWEEN a.ts_from AND a.ts AND r.ts >= a.ts - INTERVAL 7 DAY""",
    "stream_outbox": BASE + _gate() + """, l AS (SELECT *, CASE regime WHEN 'error' THEN 'down' WHEN 'signup' THEN 'up' END AS link FROM g WHERE epoch_us(ts) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 7200000 FROM r)),
o AS (SELECT *, coalesce(last_value(link IGNORE NULLS) OVER w, 'up') = 'up' AS up, min(CASE WHEN link = 'up' THEN t END) OVER (PARTITION BY device_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back
  FROM l WINDOW w AS (PARTITION BY device_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT device_id, event_id, t, CASE WHEN up THEN t ELSE back END AS sent_t FROM o WHERE alert),
k AS (SELECT *, row_number() OVER (PARTITION BY device_id, sent_t ORDER BY t DESC, event_id DESC) AS late, row_number() OVER (PARTITION BY device_id, sent_t ORDER BY t, event_id) AS place, count(*) OVER (PARTITION BY device_id, sent_t) AS n FROM s WHERE sent_t IS NOT NULL)
SELECT device_id, event_id, 'alert' AS kind, round(sent_t, 6) AS sent_t, place - greatest(n - 500, 0) AS place FROM k WHERE late <= 500
UNION ALL SELECT device_id, event_id, 'telemetry', round(t, 6), 0 FROM o WHERE up""",
    "stream_retention": """SELECT user_id AS device_id, count(*) AS stored, count(CASE WHEN epoch_us(ts) / 1e6 <= (SELECT max(epoch_us(ts)) // 1000 - 7200000 FROM events) / 1000.0 - 604800 THEN 1 END) AS pruned FROM events GROUP BY 1""",
    "stream_store": BASE + """, n AS (SELECT least(max(t), min(t) + 29 * 86400 + 3600) AS now FROM r), u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY device_id, t ORDER BY event_id DESC) = 1)
SELECT regime, (SELECT count(*) FROM u, n WHERE u.regime = x.regime AND t >= now - 604800) AS kept, count(CASE WHEN anomalous THEN 1 END) AS anomalies FROM r x GROUP BY 1""",
    "stream_startup": BASE + STARTED,
}
QUERIES = {f.__name__: f for f in (stream_tiers, stream_hourly, stream_ingest, stream_state, stream_startup, stream_feedback, stream_outbox, stream_retention, stream_store)}
