"""Soak reports, device state and pages over the readings, beyond alerting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinemetry.operators.baseline import chi2_quantile
from kinemetry.plans.monitoring import BASE, ORDER, WEEK, _gate, _gated, _readings
from kinemetry.sources.readings import table

#: Seconds of a window, tiers that a device may report.
WINDOW_S, TIERS = 30, ("green", "amber", "red")


def _by(*columns: str) -> Window:
    return Window.partitionBy("device_id").orderBy(*(columns or ORDER))


def regime_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, share, hours, anomalous ones and the ratios of score to threshold: each regime, and all in one pass."""
    r = _readings(spark, sf_dir).where("threshold > 0").withColumn("r", F.col("score") / F.col("threshold"))
    whole = r.groupingSets([["regime"], []], "regime").agg(
        F.count("*").alias("windows"), F.percentile("r", F.array(*map(F.lit, (0.5, 0.95, 0.99, 0.999)))).alias("p"), F.max("r").alias("top"),
        F.sum(F.col("anomalous").cast("long")).alias("anomalous"), F.avg((F.col("r") > 1).cast("double")).alias("over"))
    all_windows = F.max(F.when(F.col("regime").isNull(), F.col("windows"))).over(Window.partitionBy())  # a row per regime
    return whole.select(
        F.coalesce("regime", F.lit("all")).alias("regime"), "windows", F.round(F.col("windows") / all_windows, 6).alias("occupancy"), F.round(F.col("windows") * WINDOW_S / 3600.0, 6).alias("hours"), "anomalous",
        *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99", "p999"))], F.round("top", 6).alias("top"), F.round("over", 6).alias("exceed"),
        F.round(100 * (1 - F.col("p")[2]), 4).alias("headroom_pct"), F.round(100 * (1 - F.col("top")), 4).alias("worst_headroom_pct"))


def occupancy_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each regime in every bin of six hours; null in bins without a reading."""
    r = _readings(spark, sf_dir).select(F.floor(F.col("t") / 21600).alias("bin"), "regime")
    n = r.groupBy("bin", "regime").agg(F.count("*").alias("n"))
    bins = n.agg(F.min("bin").alias("a"), F.max("bin").alias("z")).select(F.explode(F.expr("sequence(a, z)")).alias("bin"))
    grid = bins.join(F.broadcast(n.select("regime").distinct()))  # a row per regime
    whole = n.groupBy("bin").agg(F.sum("n").alias("all"))
    return (grid.join(n, ["bin", "regime"], "left").join(whole, "bin", "left")
            .select("bin", "regime", F.round(F.when(F.col("all").isNotNull(), F.coalesce("n", F.lit(0)) / F.col("all")), 6).alias("share")))


@F.pandas_udf(T.DoubleType())
def poisson_upper(k, weeks):
    """Exact 95 % upper limit of a rate, from k alerts in so many weeks."""
    return (k.map({x: chi2_quantile(0.95, 2 * (x + 1)) / 2 for x in k.unique()}) / weeks).where(weeks > 0)


def rate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts a week of every device with the exact upper limit, for any number of alerts."""
    g = _gated(spark, sf_dir).groupBy("device_id").agg(F.sum(F.col("alert").cast("long")).alias("alerts"), ((F.max("t") - F.min("t") + WINDOW_S) / WEEK).alias("weeks"))
    g = g.withColumn("upper", poisson_upper("alerts", "weeks"))
    return g.select("device_id", "alerts", F.round("weeks", 6).alias("weeks"), F.round(F.col("alerts") / F.col("weeks"), 6).alias("rate"), F.round("upper", 6).alias("upper"),
                    (F.col("weeks") < 1).alias("extrapolated"), (F.col("alerts") / F.col("weeks") <= 1).alias("passes_point"), (F.col("upper") <= 1).alias("passes_upper"))


def alert_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, peak and median score of each episode, from the gate's own windows: no join."""
    g = _gated(spark, sf_dir).withColumn("episode", F.sum(F.col("alert").cast("long")).over(_by().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return g.where("in_episode").groupBy("device_id", "episode").agg(F.count("*").alias("windows"), F.round(F.max("score"), 6).alias("peak"), F.round(F.percentile("score", F.lit(0.5)), 6).alias("median"))


def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and 95th percentile (the sorted value at floor(0.95 (n - 1))) of each regime, from counts per value."""
    per = _readings(spark, sf_dir).groupBy("regime", "score").agg(F.count("*").alias("c"))
    w = Window.partitionBy("regime").orderBy("score")
    at = per.withColumn("upto", F.sum("c").over(w)).join(per.groupBy("regime").agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("score")) / F.sum("c")).alias("mean")), "regime")
    return at.where("upto > floor(0.95 * (n - 1))").groupBy("regime").agg(F.round(F.max("mean"), 6).alias("mean"), F.round(F.min("score"), 6).alias("p95"))


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, middle and greatest score of healthy and faulted windows, the margin between them, and the share of
    faulted ones above the greatest healthy score of the first regime."""
    r = _readings(spark, sf_dir)
    line = r.where("not anomalous and regime = 'click'").agg(F.max("score").alias("line"))
    both = r.join(F.broadcast(line))  # one row
    bad = F.col("anomalous")
    return both.groupBy("regime").agg(
        *[F.round(f(F.when(c, F.col("score"))), 6).alias(f"{n}_{m}") for n, c in (("healthy", ~bad), ("faulted", bad)) for m, f in (("min", F.min), ("median", F.median), ("max", F.max))],
        F.round(F.min(F.when(bad, F.col("score"))) / F.max(F.when(~bad, F.col("score"))), 6).alias("margin"), F.round(F.avg(F.when(bad, (F.col("score") > F.col("line")).cast("double"))), 6).alias("caught"))


def recording_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recording's page shows: percentages, and whether it is too short to learn from (fewer than 48 windows)."""
    g = _gated(spark, sf_dir)
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 1)
    return g.groupBy("device_id").agg(F.count("*").alias("windows"), pct(F.col("anomalous")).alias("above_pct"), pct(F.col("in_episode")).alias("fired_pct"), (F.count("*") < 48).alias("too_short"))


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three fifths of a device's windows train (every second one, as they overlap), the rest is held out."""
    n = F.count("*").over(Window.partitionBy("device_id"))
    part = F.when(F.col("idx") <= F.floor(0.6 * F.col("n")), F.when(F.col("idx") % 2 == 1, "train").otherwise("overlap")).otherwise("held_out")
    return _readings(spark, sf_dir).withColumn("n", n).groupBy("device_id", part.alias("part")).agg(F.count("*").alias("windows"), F.round(F.avg("score"), 6).alias("mean"))


def rising_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a device rises above its threshold, and from which window it stays there to the end."""
    was = F.coalesce(F.lag("anomalous").over(_by()), F.lit(False))
    last_normal = F.max(F.when(~F.col("anomalous"), F.col("idx")))
    r = _readings(spark, sf_dir).withColumn("edge", F.col("anomalous") & ~was)
    stays = F.when(F.max("idx") > F.coalesce(last_normal, F.lit(0)), F.coalesce(last_normal, F.lit(0)) + 1)
    return r.groupBy("device_id").agg(F.sum(F.col("edge").cast("long")).alias("edges"), stays.cast("long").alias("stays_from"))


def alerts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 rows of the alert log."""
    a = _gated(spark, sf_dir).where("alert").select("device_id", "event_id", F.round("t", 6).alias("t"), F.round("score", 6).alias("score"))
    return a.orderBy(F.desc("t"), F.desc("event_id")).limit(200)


def recordings_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 recordings with a field of their verdict, which is JSON."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("above"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "above")


def feedback_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of the last seven days in time order, numbered."""
    r = _readings(spark, sf_dir)
    last = r.agg((F.max("t") - WEEK).alias("since"))
    rows = r.join(F.broadcast(last)).where("anomalous and t >= since")  # one row
    return rows.select("device_id", "event_id", F.row_number().over(_by()).cast("long").alias("place"))


def top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest gaps of each device."""
    gap = (F.lead("t").over(_by()) - F.col("t")).alias("gap")
    rows = _readings(spark, sf_dir).select("device_id", "event_id", gap).where("gap is not null")
    return rows.withColumn("place", F.row_number().over(_by(F.desc("gap"), "event_id")).cast("long")).where("place <= 10").select("device_id", "place", F.round("gap", 6).alias("gap"))


def meta_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-value table in which the last write wins."""
    kv = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "value", F.struct("ts", "event_id").alias("version"))
    return kv.groupBy("key").agg(F.max_by("value", "version").alias("value"), F.count("*").alias("writes"))


def device_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages folded into each device's state: sign-ups say online, purchases offline, all others are telemetry,
    which also says online and carries a tier; a tier off the list counts as none."""
    said = F.element_at(F.array(*map(F.lit, ("green", "amber", "red", "purple"))), (F.col("event_id") % 4 + 1).cast("int"))
    tier = F.when(said.isin(*TIERS), said)
    kind = F.when(F.col("event_type") == "signup", "online").when(F.col("event_type") == "purchase", "offline").otherwise("telemetry")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), F.struct("ts", "event_id").alias("at"), kind.alias("kind"), tier.alias("tier"), (F.col("value") > 50).alias("anomalous"))
    health = F.coalesce("tier", F.when(F.col("anomalous"), "red").otherwise("green"))
    return e.groupBy("device_id").agg(
        F.max("at.event_id").alias("newest"), F.max_by(F.col("kind") != "offline", "at").alias("online"),
        F.max_by(F.when(F.col("kind") == "telemetry", health), F.when(F.col("kind") == "telemetry", F.col("at"))).alias("health"))


def evolve(df: DataFrame, target: T.StructType) -> DataFrame:
    """`df` with the columns of `target` that it lacks, as nulls; a missing column that may not be null is refused."""
    lacking = [f for f in target if f.name not in df.columns]
    if strict := [f.name for f in lacking if not f.nullable]:
        raise ValueError(f"columns {strict} may not be null and can't be added")
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking})


def evolved_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of an older unit in today's schema, and what they lack."""
    today = T.StructType().add("event_id", "long", False).add("score", "double").add("display_index", "double").add("tier", "string")
    old = _readings(spark, sf_dir).select("event_id", "score")
    new = evolve(old, today)
    lacking = F.array_join(F.array_except(F.array(*map(F.lit, today.fieldNames())), F.array(*map(F.lit, old.columns))), ",")
    return new.groupBy("tier", lacking.alias("lacking")).agg(F.count("*").alias("rows"), F.count("display_index").alias("indexed"), F.round(F.sum("score"), 3).alias("total_score"))


def device_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices found by the SHA-256 of the key that they present; keys that nobody holds match nothing."""
    held = table(spark, sf_dir, "customer").select(F.sha2(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")), 256).alias("hash"), "c_custkey")
    sent = table(spark, sf_dir, "events").select(F.sha2(F.concat(F.lit("key-"), F.col("user_id").cast("string")), 256).alias("hash"))
    return sent.groupBy("hash").agg(F.count("*").alias("requests")).join(held, "hash").select("c_custkey", "requests", F.substring("hash", 1, 12).alias("key_start"))


def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each device was last seen, in words."""
    last = _readings(spark, sf_dir).groupBy("device_id").agg(F.max("t").alias("t"))
    now = _readings(spark, sf_dir).agg(F.max("t").alias("now"))
    s = F.col("now") - F.col("t")
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(name))
    return last.join(F.broadcast(now)).select("device_id", F.when(s < 60, "just now").when(s < 3600, unit(60, "m ago")).when(s < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago")).alias("seen"))


def score_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each score among the learn scores (a device's first twenty) of its regime, from counts per value."""
    r = _readings(spark, sf_dir).withColumn("learn", (F.col("idx") <= 20).cast("long"))
    per = r.groupBy("regime", "score").agg(F.sum("learn").alias("k"), F.count("*").alias("windows"))
    n = per.groupBy("regime").agg(F.sum("k").alias("n"))
    upto = F.sum("k").over(Window.partitionBy("regime").orderBy("score"))
    return per.withColumn("upto", upto).join(n, "regime").select("regime", "score", "windows", F.when(F.col("n") > 0, F.round(100 * F.col("upto") / F.col("n"), 6)).alias("percentile"))


def rate_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shaft rate that a file states, else that measured, and which it was."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.round("value", 2) * 60).alias("rpm"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("hps"))
    rate = F.coalesce(F.col("rpm") / 60, "hps", F.lit(0.0))
    source = F.when(F.col("rpm").isNotNull(), "file").when(F.col("hps").isNotNull(), "measured").otherwise("none")
    return e.groupBy(source.alias("source")).agg(F.count("*").alias("files"), F.round(F.avg(rate), 6).alias("rate"))


def schedule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings against the schedule's speed (30 and 50 Hz, four windows each): scores by speed and regime."""
    r = _readings(spark, sf_dir)
    plan = r.select("idx").distinct().select("idx", F.when(F.pmod(F.floor((F.col("idx") - 1) / 4), F.lit(2)) == 0, 50).otherwise(30).alias("speed"))
    return r.join(plan, "idx").groupBy("speed", "regime").agg(F.count("*").alias("windows"), F.round(F.avg("score"), 6).alias("mean"))


def before_during_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a device's thirds of equal length: whether the middle rose and the end came back."""
    n = F.floor(F.count("*").over(Window.partitionBy("device_id")) / 3)
    r = _readings(spark, sf_dir).withColumn("n", n).where("idx <= 3 * n").withColumn("part", F.floor((F.col("idx") - 1) / F.col("n")))
    m = r.groupBy("device_id").agg(*[F.avg(F.when(F.col("part") == i, F.col("score"))).alias(x) for i, x in enumerate(("before", "during", "after"))])
    rose = F.col("during") > 1.1 * F.col("before")
    return m.select("device_id", *[F.round(x, 6).alias(x) for x in ("before", "during", "after")], rose.alias("rose"), (rose & (F.abs(F.col("after") - F.col("before")) < F.abs(F.col("during") - F.col("before")))).alias("returned"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False and true alarm rates at multiples of the threshold; a purchase is the fault."""
    r = _readings(spark, sf_dir).withColumn("axis", F.explode(F.array(*map(F.lit, (0.5, 0.75, 0.9, 1.0, 1.1, 1.25)))))
    bad, over = F.col("regime") == "purchase", F.col("score") > F.col("axis") * F.col("threshold")
    share = lambda who: F.round(F.avg(F.when(who, over.cast("double"))), 6)
    return r.groupBy("axis").agg(share(~bad).alias("fpr"), share(bad).alias("tpr"))


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the ROC curve of a text's length for its quality, per source, from counts per value."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id").where("quality is not null")
    per = both.groupBy("source", "n_chars").agg(F.sum("quality").alias("p"), F.sum(1 - F.col("quality")).alias("q"))
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"))
    all_of = per.groupBy("source").agg(F.sum("p").alias("np"), F.sum("q").alias("nq")).where("np > 0 and nq > 0")
    run = per.select("source", "n_chars", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"))
    return run.join(all_of, "source").select("source", F.col("n_chars").alias("threshold"), F.round(F.col("fp") / F.col("nq"), 6).alias("fpr"), F.round(F.col("tp") / F.col("np"), 6).alias("tpr"))


def chunk_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the score over a device's windows, for each chunk of fifty."""
    r = _readings(spark, sf_dir).withColumn("chunk", F.floor((F.col("idx") - 1) / 50))
    return r.groupBy("device_id", "chunk").agg(F.count("*").alias("windows"), F.round(F.regr_slope("score", F.col("idx").cast("double")), 6).alias("slope")).where("windows > 2").drop("windows")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text about every device, with the persistence that its minutes make in windows."""
    g = _gated(spark, sf_dir).groupBy("device_id").agg(F.sum(F.col("alert").cast("long")).alias("alerts"), F.max("score").alias("top"))
    minutes = F.pmod("device_id", F.lit(5)) + 1
    said = F.when(F.col("alerts") == 0, "no alert").when(F.col("alerts") == 1, "one alert").otherwise(F.concat(F.col("alerts").cast("string"), F.lit(" alerts")))
    return g.select("device_id", F.greatest(F.lit(1), F.ceil(minutes * 60 / F.lit(WINDOW_S))).cast("long").alias("need"), F.concat(F.lit("device "), F.col("device_id").cast("string"), F.lit(": "), said).alias("verdict"))


_T = BASE + _gate()
_P = ", p AS (SELECT *, score / threshold AS r FROM r WHERE threshold > 0)"
SQL = {
    "regime_report": BASE + _P + """ SELECT coalesce(regime, 'all') AS regime, count(*) AS windows, round(count(*) / (SELECT count(*) FROM p), 6) AS occupancy, round(count(*) * 30 / 3600.0, 6) AS hours, sum(CASE WHEN anomalous THEN 1 ELSE 0 END)::BIGINT AS anomalous,
  round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.95), 6) AS p95, round(quantile_cont(r, 0.99), 6) AS p99, round(quantile_cont(r, 0.999), 6) AS p999, round(max(r), 6) AS top,
  round(avg(CASE WHEN r > 1 THEN 1 ELSE 0 END), 6) AS exceed, round(100 * (1 - quantile_cont(r, 0.99)), 4) AS headroom_pct, round(100 * (1 - max(r)), 4) AS worst_headroom_pct FROM p GROUP BY GROUPING SETS ((regime), ())""",
    "occupancy_series": BASE + """, n AS (SELECT floor(t / 21600)::BIGINT AS bin, regime, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM n), w AS (SELECT bin, sum(n) AS a FROM n GROUP BY 1)
SELECT b.bin, g.regime, round(CASE WHEN w.a IS NOT NULL THEN coalesce(n.n, 0) / w.a END, 6) AS share FROM b CROSS JOIN (SELECT DISTINCT regime FROM n) g LEFT JOIN n ON n.bin = b.bin AND n.regime = g.regime LEFT JOIN w ON w.bin = b.bin""",
    "alert_peaks": _T + """, e AS (SELECT *, sum(CASE WHEN alert THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM g)
SELECT device_id, episode, count(*) AS windows, round(max(score), 6) AS peak, round(quantile_cont(score, 0.5), 6) AS median FROM e WHERE in_episode GROUP BY 1, 2""",
    "stage_timing": BASE + """, s AS (SELECT regime, score, row_number() OVER (PARTITION BY regime ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY regime) AS n FROM r)
SELECT regime, round(avg(score), 6) AS mean, round(max(CASE WHEN i = floor(0.95 * (n - 1)) THEN score END), 6) AS p95 FROM s GROUP BY 1""",
    "margins": BASE + " SELECT regime, " + ", ".join(f"round({f}(CASE WHEN {c} THEN score END), 6) AS {n}_{f}" for n, c in (("healthy", "NOT anomalous"), ("faulted", "anomalous")) for f in ("min", "median", "max")) + """,
  round(min(CASE WHEN anomalous THEN score END) / max(CASE WHEN NOT anomalous THEN score END), 6) AS margin,
  round(avg(CASE WHEN anomalous THEN CASE WHEN score > (SELECT max(score) FROM r WHERE NOT anomalous AND regime = 'click') THEN 1 ELSE 0 END END), 6) AS caught FROM r GROUP BY 1""",
    "recording_summary": _T + " SELECT device_id, count(*) AS windows, round(100 * avg(CASE WHEN anomalous THEN 1 ELSE 0 END), 1) AS above_pct, round(100 * avg(CASE WHEN in_episode THEN 1 ELSE 0 END), 1) AS fired_pct, count(*) < 48 AS too_short FROM g GROUP BY 1",
    "time_split": BASE + """, n AS (SELECT *, count(*) OVER (PARTITION BY device_id) AS n FROM r)
SELECT device_id, CASE WHEN idx <= floor(0.6 * n) THEN CASE WHEN idx % 2 = 1 THEN 'train' ELSE 'overlap' END ELSE 'held_out' END AS part, count(*) AS windows, round(avg(score), 6) AS mean FROM n GROUP BY 1, 2""",
    "rising_edges": BASE + """, e AS (SELECT *, anomalous AND NOT coalesce(lag(anomalous) OVER (PARTITION BY device_id ORDER BY t, event_id), false) AS edge, bool_and(anomalous) OVER (PARTITION BY device_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stays FROM r)
SELECT device_id, sum(CASE WHEN edge THEN 1 ELSE 0 END)::BIGINT AS edges, min(CASE WHEN stays THEN idx END) AS stays_from FROM e GROUP BY 1""",
    "alerts_page": _T + " SELECT device_id, event_id, round(t, 6) AS t, round(score, 6) AS score FROM g WHERE alert ORDER BY t DESC, event_id DESC LIMIT 200",
    "recordings_page": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS above FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "feedback_page": BASE + " SELECT device_id, event_id, row_number() OVER (PARTITION BY device_id ORDER BY t, event_id) AS place FROM r WHERE anomalous AND t >= (SELECT max(t) - 7 * 86400.0 FROM r)",
    "top_gaps": BASE + """, p AS (SELECT device_id, event_id, lead(t) OVER (PARTITION BY device_id ORDER BY t, event_id) - t AS gap FROM r)
SELECT device_id, place, round(gap, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY gap DESC, event_id) AS place FROM p WHERE gap IS NOT NULL) WHERE place <= 10""",
    "meta_latest": "SELECT event_type AS key, arg_max(value, (ts, event_id)) AS value, count(*) AS writes FROM events GROUP BY 1",
    "device_state": """WITH e AS (SELECT user_id AS device_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'online' WHEN 'purchase' THEN 'offline' ELSE 'telemetry' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'amber' WHEN 2 THEN 'red' ELSE CASE WHEN value > 50 THEN 'red' ELSE 'green' END END AS health FROM events)
SELECT e.device_id, max(event_id) FILTER (WHERE last) AS newest, bool_or(kind <> 'offline') FILTER (WHERE last) AS online, max(health) FILTER (WHERE told) AS health
FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, event_id DESC) = 1 AS last, kind = 'telemetry' AND row_number() OVER (PARTITION BY device_id, kind ORDER BY ts DESC, event_id DESC) = 1 AS told FROM e) e GROUP BY 1""",
    "evolved_readings": "SELECT NULL::VARCHAR AS tier, 'display_index,tier' AS lacking, count(*) AS rows, 0::BIGINT AS indexed, round(sum(value), 3) AS total_score FROM events",
    "device_keys": "SELECT c_custkey, count(*) AS requests, substr(sha256('key-' || c_custkey), 1, 12) AS key_start FROM events JOIN customer ON sha256('key-' || user_id) = sha256('key-' || c_custkey) GROUP BY 1, 3",
    "relative_time": BASE + """, s AS (SELECT device_id, (SELECT max(t) FROM r) - max(t) AS s FROM r GROUP BY 1)
SELECT device_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm ago' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || 'h ago' ELSE floor(s / 86400)::BIGINT || 'd ago' END AS seen FROM s""",
    "score_percentile": BASE + """, l AS (SELECT regime, score FROM r WHERE idx <= 20), n AS (SELECT regime, count(*) AS n FROM l GROUP BY 1), d AS (SELECT regime, score, count(*) AS windows FROM r GROUP BY 1, 2)
SELECT d.regime, d.score, d.windows, round(100.0 * (SELECT count(*) FROM l WHERE l.regime = d.regime AND l.score <= d.score) / n.n, 6) AS percentile FROM d LEFT JOIN n ON n.regime = d.regime""",
    "rate_provenance": """WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN round(value, 2) * 60 END AS rpm, CASE WHEN event_id % 5 <> 0 THEN value END AS hps FROM events)
SELECT CASE WHEN rpm IS NOT NULL THEN 'file' WHEN hps IS NOT NULL THEN 'measured' ELSE 'none' END AS source, count(*) AS files, round(avg(coalesce(rpm / 60, hps, 0.0)), 6) AS rate FROM e GROUP BY 1""",
    "schedule_join": BASE + " SELECT CASE WHEN ((idx - 1) // 4) % 2 = 0 THEN 50 ELSE 30 END AS speed, regime, count(*) AS windows, round(avg(score), 6) AS mean FROM r GROUP BY 1, 2",
    "before_during_after": BASE + """, n AS (SELECT *, count(*) OVER (PARTITION BY device_id) // 3 AS n FROM r), m AS (SELECT device_id, avg(CASE WHEN idx <= n THEN score END) AS b, avg(CASE WHEN idx > n AND idx <= 2 * n THEN score END) AS d, avg(CASE WHEN idx > 2 * n THEN score END) AS a FROM n WHERE idx <= 3 * n GROUP BY 1)
SELECT device_id, round(b, 6) AS before, round(d, 6) AS during, round(a, 6) AS after, d > 1.1 * b AS rose, d > 1.1 * b AND abs(a - b) < abs(d - b) AS returned FROM m""",
    "threshold_sweep": BASE + """ SELECT axis::DOUBLE AS axis, round(avg(CASE WHEN regime <> 'purchase' THEN CASE WHEN score > axis * threshold THEN 1 ELSE 0 END END), 6) AS fpr,
  round(avg(CASE WHEN regime = 'purchase' THEN CASE WHEN score > axis * threshold THEN 1 ELSE 0 END END), 6) AS tpr FROM r, (VALUES (0.5::DOUBLE), (0.75), (0.9), (1.0), (1.1), (1.25)) a(axis) GROUP BY 1""",
    "roc_curve": """WITH b AS (SELECT source, n_chars, quality FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), n AS (SELECT source, sum(quality) AS np, sum(1 - quality) AS nq FROM b GROUP BY 1 HAVING sum(quality) > 0 AND sum(1 - quality) > 0),
d AS (SELECT DISTINCT source, n_chars FROM b) SELECT d.source, d.n_chars AS threshold, round(sum(1 - quality) / max(nq), 6) AS fpr, round(sum(quality) / max(np), 6) AS tpr FROM d JOIN n ON n.source = d.source JOIN b ON b.source = d.source AND b.n_chars >= d.n_chars GROUP BY 1, 2""",
    "chunk_trend": BASE + " SELECT device_id, (idx - 1) // 50 AS chunk, round(regr_slope(score, idx), 6) AS slope FROM r GROUP BY 1, 2 HAVING count(*) > 2",
    "verdicts": _T + """ SELECT device_id, (2 * (device_id % 5 + 1))::BIGINT AS need, 'device ' || device_id || ': ' || CASE sum(CASE WHEN alert THEN 1 ELSE 0 END) WHEN 0 THEN 'no alert' WHEN 1 THEN 'one alert' ELSE sum(CASE WHEN alert THEN 1 ELSE 0 END)::BIGINT || ' alerts' END AS verdict FROM g GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (regime_report, occupancy_series, rate_bounds, alert_peaks, stage_timing, margins, recording_summary, time_split, rising_edges, alerts_page, recordings_page, feedback_page, top_gaps, meta_latest, device_state,
                                   evolved_readings, device_keys, relative_time, score_percentile, rate_provenance, schedule_join, before_during_after, threshold_sweep, roc_curve, chunk_trend, verdicts)}
