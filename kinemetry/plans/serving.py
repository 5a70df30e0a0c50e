"""Queries behind the service: latest state, pages, joins of alerts, feedback and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinemetry.functions.arrays import display_index
from kinemetry.plans.monitoring import BASE, EPISODES, NEED, _gate, _gated, _readings
from kinemetry.sources.readings import finite, routed, table

PAGE, QUEUE, WEEK = 500, 500, 7 * 86400


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("event_id", "regime", "score", "anomalous"), F.struct("t", "event_id"))
    return _readings(spark, sf_dir).groupBy("device_id").agg(last.alias("x")).select("device_id", "x.event_id", "x.regime", F.round("x.score", 6).alias("score"), F.when(F.col("x.anomalous"), "red").otherwise("green").alias("health"))


def readings_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest readings of one device, in ascending order."""
    newest = _readings(spark, sf_dir).where("device_id = 1").orderBy(F.desc("t"), F.desc("event_id")).limit(PAGE)
    return newest.orderBy("t", "event_id").select("event_id", "regime", F.round("score", 6).alias("score"))


def anomalies_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(spark, sf_dir).where("anomalous").orderBy(F.desc("t"), F.desc("event_id")).limit(PAGE).select("event_id", "device_id", F.round("score", 6).alias("score"))


def alert_log_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sent alerts, a row per channel of each error event, with their events."""
    events = table(spark, sf_dir, "events")
    channels = F.filter(F.array(F.when(F.col("user_id") % 3 != 0, "email"), F.when(F.col("user_id") % 2 == 0, "webhook")), lambda x: x.isNotNull())
    alerts = events.where("event_type = 'error'").select("event_id", F.explode(channels).alias("channel"))
    return alerts.join(events, "event_id").select("event_id", "channel", F.col("user_id").alias("device_id"), F.round("value", 6).alias("score"))


def owned_device_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id")).distinct().where("device_id % 5 = 2")
    return _readings(spark, sf_dir).join(owned, "device_id", "left_semi").groupBy("device_id").agg(F.count("*").alias("windows"))


def route_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "anomaly").when(F.col("event_type") == "signup", "cmd").otherwise("telemetry")
    sent = events.select("event_id", F.concat(F.lit("devices/"), F.col("user_id"), F.lit("/"), kind).alias("topic"), F.col("props").alias("payload"))
    known = events.where("user_id % 7 <> 0").select(F.col("user_id").cast("string").alias("device_id"))
    return routed(sent, known).groupBy("device_id", "kind").agg(F.count("*").alias("messages"))


def sparkline_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean of the display index, or of the score where a device never sent one; last week."""
    index = F.when(F.col("device_id") % 4 != 3, display_index(F.col("score"), F.col("threshold")))
    r = _readings(spark, sf_dir).withColumn("display", index)
    newest = r.agg(F.max("t").alias("newest"))
    has = F.max(F.col("display").isNotNull()).over(Window.partitionBy("device_id"))
    own = r.withColumn("value", F.when(has, F.col("display")).otherwise(F.col("score")))
    recent = own.join(F.broadcast(newest)).where(F.col("t") >= F.col("newest") - WEEK).where("value is not null")
    return recent.groupBy("device_id", F.floor(F.col("t") / 3600).alias("hour")).agg(F.round(F.avg("value"), 6).alias("mean"))


def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readings(spark, sf_dir).groupBy("device_id").agg(
        F.count("*").alias("windows"), F.count(F.when(F.col("anomalous"), 1)).alias("anomalies"), F.round(F.max("score"), 6).alias("worst"), F.count_distinct("regime").alias("regimes"))


def feedback_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings inside an alert's span, each once: what a "this was normal" answer would learn."""
    g = _gated(spark, sf_dir)
    # an alert's span is the beginning of its run: at most NEED rows of a run meet its one alert
    begin = g.where(F.col("anomalous") & (F.col("streak") <= NEED)).select("device_id", "run", "event_id", "score")
    fired = g.where("alert").select("device_id", "run")
    return begin.join(fired, ["device_id", "run"], "left_semi").select("device_id", "event_id", F.round("score", 6).alias("score")).distinct()


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of readings keyed by device and hour: the later row wins."""
    r = _readings(spark, sf_dir).withColumn("hour", F.floor(F.col("t") / 3600))
    both = r.withColumn("delivery", F.lit(1)).unionByName(r.where("event_id % 3 = 0").withColumn("score", -F.col("score")).withColumn("delivery", F.lit(2)))
    return both.groupBy("device_id", "hour").agg(F.round(F.max_by("score", F.struct("delivery", "t", "event_id")), 6).alias("score"), F.count("*").alias("rows"))


def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a week's retention keeps, measured from the newest reading that a clock step can't move."""
    r = _readings(spark, sf_dir)
    trusted = r.agg(F.least(F.max("t"), F.min("t") + 29 * 86400 + 3600).alias("now"))
    return r.join(F.broadcast(trusted)).where(F.col("t") >= F.col("now") - WEEK).groupBy("regime").agg(F.count("*").alias("kept"))


def queue_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded outbox of each device: its newest anomalies."""
    newest = Window.partitionBy("device_id").orderBy(F.desc("t"), F.desc("event_id"))
    kept = _readings(spark, sf_dir).where("anomalous").withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= QUEUE)
    return kept.groupBy("device_id").agg(F.count("*").alias("queued"), F.min("event_id").alias("first_id"))


def missing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours between a device's first and last reading that have none."""
    r = _readings(spark, sf_dir).select("device_id", F.floor(F.col("t") / 3600).alias("hour"))
    every = r.groupBy("device_id").agg(F.explode(F.sequence(F.min("hour"), F.max("hour"))).alias("hour"))
    return every.join(r.distinct(), ["device_id", "hour"], "left_anti").groupBy("device_id").agg(F.count("*").alias("missing"))


def retrain_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learn rows with the rows that feedback adds, as one bag."""
    r = _readings(spark, sf_dir)
    both = r.where("idx <= 8").select("device_id", "score").unionByName(feedback_interval_join(spark, sf_dir).select("device_id", "score"))
    return both.groupBy("device_id").agg(F.count("*").alias("rows"), F.round(F.sum("score"), 5).alias("total_score"))


def severity_by_regime_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst score of each day, a column for every regime of the table."""
    return _readings(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400)).groupBy("day").pivot("regime").agg(F.round(F.max("score"), 6))


def coerce_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that should be a number: none, NaN and infinities become null."""
    sent = F.when(F.col("event_id") % 5 == 0, "nan").when(F.col("event_id") % 7 == 0, "-inf").when(F.col("event_id") % 11 == 0, "<script>").otherwise(F.round("value", 3).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", finite(F.regexp_replace(sent, "^-inf$", "-Infinity")).alias("number"))


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("present"))


SQL = {
    "latest_status": BASE + """ SELECT device_id, event_id, regime, round(score, 6) AS score, CASE WHEN anomalous THEN 'red' ELSE 'green' END AS health
  FROM r QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY t DESC, event_id DESC) = 1""",
    "readings_page": BASE + " SELECT event_id, regime, round(score, 6) AS score FROM r WHERE device_id = 1 ORDER BY t DESC, event_id DESC LIMIT 500",
    "anomalies_page": BASE + " SELECT event_id, device_id, round(score, 6) AS score FROM r WHERE anomalous ORDER BY t DESC, event_id DESC LIMIT 500",
    "alert_log_join": """SELECT event_id, channel, user_id AS device_id, round(value, 6) AS score FROM (
  SELECT event_id, 'email' AS channel FROM events WHERE event_type = 'error' AND user_id % 3 <> 0 UNION ALL SELECT event_id, 'webhook' FROM events WHERE event_type = 'error' AND user_id % 2 = 0) JOIN events USING (event_id)""",
    "owned_device_semi": "SELECT user_id AS device_id, count(*) AS windows FROM events WHERE user_id % 5 = 2 GROUP BY 1",
    "route_messages": """SELECT user_id::VARCHAR AS device_id, CASE WHEN event_type = 'error' THEN 'anomaly' ELSE 'telemetry' END AS kind, count(*) AS messages
  FROM events WHERE event_type <> 'signup' AND user_id % 7 <> 0 AND json_valid(props) GROUP BY 1, 2""",
    "sparkline_hourly": BASE + """, i AS (SELECT *, CASE WHEN device_id % 4 <> 3 THEN CASE WHEN threshold <= 0 THEN 100.0 WHEN score <= 0 THEN 0.0
  WHEN log10(score / threshold) <= 0 THEN 70.0 * greatest(1 + log10(score / threshold), 0.0) ELSE 70.0 + 30.0 * least(log10(score / threshold) / 3.0, 1.0) END END AS d FROM r),
v AS (SELECT *, CASE WHEN max(CASE WHEN d IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY device_id) = 1 THEN d ELSE score END AS v FROM i)
SELECT device_id, floor(t / 3600)::BIGINT AS hour, round(avg(v), 6) AS mean FROM v WHERE t >= (SELECT max(t) FROM r) - 604800 AND v IS NOT NULL GROUP BY 1, 2""",
    "dashboard_summary": BASE + " SELECT device_id, count(*) AS windows, count(CASE WHEN anomalous THEN 1 END) AS anomalies, round(max(score), 6) AS worst, count(DISTINCT regime) AS regimes FROM r GROUP BY 1",
    "feedback_interval_join": BASE + _gate() + ", e AS (" + EPISODES.format(need=2) + ") SELECT DISTINCT r.device_id, r.event_id, round(r.score, 6) AS score FROM r JOIN e ON e.device_id = r.device_id AND r.idx BETWEEN e.start_idx AND e.alert_idx",
    "upsert_latest": BASE + """, b AS (SELECT device_id, t, event_id, floor(t / 3600)::BIGINT AS hour, score, 1 AS d FROM r UNION ALL SELECT device_id, t, event_id, floor(t / 3600)::BIGINT, -score, 2 FROM r WHERE event_id % 3 = 0)
SELECT device_id, hour, round(score, 6) AS score, n AS rows FROM (SELECT *, count(*) OVER (PARTITION BY device_id, hour) AS n, row_number() OVER (PARTITION BY device_id, hour ORDER BY d DESC, t DESC, event_id DESC) AS k FROM b) WHERE k = 1""",
    "retention_prune": BASE + " SELECT regime, count(*) AS kept FROM r WHERE t >= (SELECT least(max(t), min(t) + 29 * 86400 + 3600) FROM r) - 604800 GROUP BY 1",
    "queue_keep_newest": BASE + " SELECT device_id, count(*) AS queued, min(event_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t DESC, event_id DESC) AS k FROM r WHERE anomalous) WHERE k <= 500 GROUP BY 1",
    "missing_windows": BASE + """, h AS (SELECT DISTINCT device_id, floor(t / 3600)::BIGINT AS hour FROM r), e AS (SELECT device_id, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY 1)
SELECT device_id, count(*) AS missing FROM e ANTI JOIN h USING (device_id, hour) GROUP BY 1""",
    "retrain_union": BASE + _gate() + ", e AS (" + EPISODES.format(need=2) + """), f AS (SELECT DISTINCT r.device_id, r.event_id, round(r.score, 6) AS score FROM r JOIN e ON e.device_id = r.device_id AND r.idx BETWEEN e.start_idx AND e.alert_idx)
SELECT device_id, count(*) AS rows, round(sum(score), 5) AS total_score FROM (SELECT device_id, score FROM r WHERE idx <= 8 UNION ALL SELECT device_id, score FROM f) GROUP BY 1""",
    "severity_by_regime_pivot": BASE + " SELECT floor(t / 86400)::BIGINT AS day, " + ", ".join(f"round(max(CASE WHEN regime = '{x}' THEN score END), 6) AS {x}" for x in ("click", "error", "purchase", "signup", "view")) + " FROM r GROUP BY 1",
    "coerce_telemetry": "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE round(value, 3) END AS number FROM events",
    "props_json": "SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, count(json_extract(props, '$.k')) AS present FROM events GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (latest_status, readings_page, anomalies_page, alert_log_join, owned_device_semi, route_messages, sparkline_hourly, dashboard_summary, feedback_interval_join, upsert_latest,
                                   retention_prune, queue_keep_newest, missing_windows, retrain_union, severity_by_regime_pivot, coerce_telemetry, props_json)}
