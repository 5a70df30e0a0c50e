"""Alerting and soak-report queries over the readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinemetry.functions.arrays import display_index, tier
from kinemetry.operators.gate import episodes, excursions, marked
from kinemetry.operators.quantiles import quantiles
from kinemetry.sources.readings import readings, table

KEYS, ORDER, NEED, CLEAR = ["device_id"], ["t", "event_id"], 2, 2
WEEK = 7 * 86400.0
#: Windows that a device's ratios are learned from, and, a fixed value, those of a start by which another machine is told.
LEARNED, STARTUP = 16, 8
#: Persistence candidates of the sweep, in minutes.
CANDIDATES = [1, 2, 5, 10, 15, 20, 30, 45, 60, 90, 120]


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(table(spark, sf_dir, "events"))


def _gated(spark: SparkSession, sf_dir: str, need: int = NEED, clear: int = CLEAR) -> DataFrame:
    """The readings with their gate, week by week, so that a device of any length is spread over tasks."""
    return marked(_readings(spark, sf_dir), KEYS, ORDER, "anomalous", F.lit(need), F.lit(clear), F.floor(F.col("t") / WEEK))


def alert_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(_gated(spark, sf_dir), KEYS, ORDER, "idx", F.lit(NEED))


def gate_clear1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(_gated(spark, sf_dir, 2, 1), KEYS, ORDER, "idx", F.lit(2))


def gate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = excursions(_gated(spark, sf_dir), KEYS, "anomalous")
    return runs.groupBy("device_id").agg(F.count("*").alias("runs"), F.max("length").alias("longest"), F.sum("length").alias("windows"))


def gate_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_gated(spark, sf_dir).withColumn("tier", tier(F.col("in_episode"), F.col("anomalous")))
            .groupBy("device_id", "tier").agg(F.count("*").alias("windows")))


def window_median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.lead("t").over(Window.partitionBy("device_id").orderBy(*ORDER)) - F.col("t")
    return (_readings(spark, sf_dir).withColumn("gap", gap).where("gap > 0")
            .groupBy("device_id").agg(F.round(F.percentile("gap", F.lit(0.5)), 6).alias("window_s"), F.count("*").alias("gaps")))


def gaps_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of more than one and a half median windows, the windows missed in them, and coverage."""
    gap = F.lead("t").over(Window.partitionBy("device_id").orderBy(*ORDER)) - F.col("t")
    rows = _readings(spark, sf_dir).withColumn("gap", gap)
    w = rows.where("gap > 0").groupBy("device_id").agg(F.percentile("gap", F.lit(0.5)).alias("w"))
    both = rows.join(w, "device_id")
    long = F.col("gap") > 1.5 * F.col("w")
    return both.groupBy("device_id").agg(
        F.count(F.when(long, 1)).alias("gaps"),
        F.sum(F.when(long, F.bround(F.col("gap") / F.col("w"), 0) - 1).otherwise(0)).cast("long").alias("missed"),
        F.round(F.count("*") * F.max("w") / (F.max("t") - F.min("t") + F.max("w")), 6).alias("coverage"))


def regime_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("score", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.995)))
    own = _readings(spark, sf_dir).groupBy("regime").agg(p.alias("p"), F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.count("*").alias("n"))
    analytic = F.col("m") + 2.5 * F.col("s")
    return own.select("regime", "n", F.round(F.col("p")[2], 6).alias("empirical"), F.round(analytic, 6).alias("analytic"),
                      F.round(F.least(F.col("p")[2], analytic), 6).alias("threshold"), (F.col("p")[2] / analytic > 1.25).alias("contaminated"))


def crest_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    crest = F.col("score") / 100
    return _readings(spark, sf_dir).groupBy("device_id").agg(
        F.round(F.when(F.count("score") >= 8, F.least(F.lit(10.0), F.greatest(F.lit(6.5), F.max(crest) + 0.7))).otherwise(10.0), 6).alias("crest_floor"))


def headroom_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score over threshold: quantiles and exceedance, per regime and over all (regime null)."""
    r = _readings(spark, sf_dir).where("threshold > 0").withColumn("r", F.col("score") / F.col("threshold"))
    qs = [0.5, 0.95, 0.99]
    p = quantiles(r, ["regime"], "r", qs).unionByName(quantiles(r, [], "r", qs).withColumn("regime", F.lit(None).cast("string"))).withColumnRenamed("regime", "of").select("of", "q")
    whole = r.rollup("regime").agg(F.round(F.max("r"), 6).alias("top"), F.round(F.avg((F.col("r") > 1).cast("int")), 6).alias("exceed"), F.count("*").alias("windows"))
    return whole.join(p, F.col("regime").eqNullSafe(F.col("of"))).select("regime", *[F.round(F.col("q")[i], 6).alias(a) for i, a in enumerate(("p50", "p95", "p99"))], "top", "exceed", "windows")


def occupancy_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("t") / 86400)
    n = _readings(spark, sf_dir).withColumn("day", day).groupBy("day").pivot("regime").agg(F.count(F.lit(1)))
    share = {x: F.coalesce(F.col(f"`{x}`"), F.lit(0)) for x in n.columns if x != "day"}
    whole = sum(share.values(), F.lit(0))
    return n.select("day", *[F.round(c / whole, 6).alias(x) for x, c in share.items()])


def false_alarm_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts a device-week; where there were none, the exact upper bound -ln(0.05) / T."""
    span = _readings(spark, sf_dir).groupBy("device_id").agg((F.max("t") - F.min("t")).alias("s"))
    n = alert_episodes(spark, sf_dir).groupBy("device_id").agg(F.count("*").alias("n"))
    weeks = F.col("s") / WEEK
    k = F.coalesce("n", F.lit(0))
    return span.join(n, "device_id", "left").where("s > 0").select(
        "device_id", k.alias("alerts"), F.round(k / weeks, 6).alias("rate_per_week"),
        F.round(F.when(k == 0, -F.log(F.lit(0.05)) / weeks), 6).alias("upper_if_none"), (k / weeks <= 1).alias("passes_point"))


def geometric_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excursions a week, and the least persistence whose predicted alerts come down to one a week."""
    span = _readings(spark, sf_dir).groupBy("device_id").agg((F.max("t") - F.min("t")).alias("s")).where("s > 0")
    runs = excursions(_gated(spark, sf_dir), KEYS, "anomalous").groupBy("device_id").agg(F.count("*").alias("n"), F.avg("length").alias("m"), F.max("length").alias("longest"))
    per = F.col("n") / (F.col("s") / WEEK)
    q = F.least(F.greatest(1 - 1 / F.col("m"), F.lit(1e-6)), F.lit(1 - 1e-9))
    need = F.when(per <= 1, 1).otherwise(F.greatest(F.lit(1), F.ceil(1 + F.log(1 / per) / F.log(q))))
    return runs.join(span, "device_id").select("device_id", F.col("n").alias("n_runs"), F.round(per, 6).alias("runs_per_week"), F.round("m", 6).alias("mean_run"), "longest", need.cast("long").alias("need"))


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device_id, longest): the longest flagged run of each stretch between clearings. A gate alerts once in each stretch
    whose longest run is as long as it needs, so every persistence candidate can be told from these."""
    g = _gated(spark, sf_dir)
    cleared = F.count(F.when(F.col("marker") == "C", 1))
    weeks = Window.partitionBy(*KEYS).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = g.groupBy(*KEYS, "_chunk").agg(cleared.alias("n")).select(*KEYS, "_chunk", F.coalesce(F.sum("n").over(weeks), F.lit(0)).alias("before"))
    so_far = Window.partitionBy(*KEYS, "_chunk").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = g.withColumn("stretch", cleared.over(so_far)).join(before, [*KEYS, "_chunk"]).withColumn("stretch", F.col("stretch") + F.col("before"))
    return placed.where("anomalous").groupBy(*KEYS, "stretch").agg(F.max("streak").alias("longest"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device_id, w): the usual gap between a device's windows in seconds."""
    gap = F.lead("t").over(Window.partitionBy("device_id").orderBy(*ORDER)) - F.col("t")
    return quantiles(_readings(spark, sf_dir).withColumn("gap", gap).where("gap > 0"), ["device_id"], "gap", [0.5]).select("device_id", F.col("q")[0].alias("w"))


def persist_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the whole fleet for every persistence candidate, in minutes: at least one of a device's windows."""
    return _sweep(_stretches(spark, sf_dir), _windows(spark, sf_dir), CANDIDATES, 60.0)


def persist_sweep_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for as many hours, which here are several windows."""
    return _sweep(_stretches(spark, sf_dir), _windows(spark, sf_dir), CANDIDATES, 3600.0)


def _sweep(stretches: DataFrame, windows: DataFrame, candidates: list[int], unit_s: float) -> DataFrame:
    each = stretches.groupBy("device_id", "longest").agg(F.count("*").alias("n")).join(windows, "device_id", "left")
    each = each.withColumn("need", F.explode(F.array(*map(F.lit, candidates))))
    need = F.greatest(F.lit(1), F.coalesce(F.bround(F.col("need") * unit_s / F.col("w")), F.lit(1)))
    return each.groupBy("need").agg(F.coalesce(F.sum(F.when(F.col("longest") >= need, F.col("n"))), F.lit(0)).alias("alerts"))


def persist_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest candidate with at most one alert a node and week, else the largest."""
    span = _readings(spark, sf_dir).groupBy("device_id").agg(((F.max("t") - F.min("t")) / WEEK).alias("weeks")).agg(F.sum("weeks").alias("weeks"))
    best = persist_sweep_long(spark, sf_dir).join(F.broadcast(span)).where("alerts <= weeks").agg(F.min("need").alias("need"))
    return best.select(F.coalesce("need", F.lit(max(CANDIDATES))).alias("need"))


def display_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir)
    return r.select("event_id", F.round(F.when(F.col("device_id") % 4 != 3, display_index(F.col("score"), F.col("threshold"))), 6).alias("display_index"),
                    F.when(F.col("anomalous"), "red").otherwise("green").alias("health"))


def startup_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a start against the ratios of the learn windows before it: mostly above, and far above."""
    r = _readings(spark, sf_dir).where("threshold > 0").withColumn("r", F.col("score") / F.col("threshold"))
    r = r.withColumn("n", F.row_number().over(Window.partitionBy("device_id").orderBy(*ORDER))).where(F.col("n") <= LEARNED + STARTUP)
    share = F.avg(F.when(F.col("n") > LEARNED, (F.col("r") > 1).cast("int")))
    # LEARNED and STARTUP values of a device
    of = r.groupBy("device_id").agg(F.count("*").alias("n"), share.alias("share"), F.percentile(F.when(F.col("n") > LEARNED, F.col("r")), F.lit(0.5)).alias("median"), F.percentile(F.when(F.col("n") <= LEARNED, F.col("r")), F.lit(0.95)).alias("p95"))
    return of.where(F.col("n") == LEARNED + STARTUP).select("device_id", F.round("share", 6).alias("share"), F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), mismatch(F.col("share"), F.col("median"), F.col("p95")).alias("mismatch"))


def mismatch(share: Column, median: Column, p95: Column) -> Column:
    """Whether a start's ratios are none of the machine that was learned."""
    return (share >= 0.75) & (median >= 5 * F.greatest(p95, F.lit(1.0)))


def learn_score_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("idx") <= 8, "learn").otherwise("score")
    return _readings(spark, sf_dir).withColumn("part", part).groupBy("device_id", "part").agg(F.count("*").alias("windows"), F.round(F.avg("score"), 6).alias("mean_score"))


BASE = """WITH lim AS (SELECT event_type AS regime, round(quantile_cont(value, 0.75), 6) AS threshold FROM events GROUP BY 1),
r AS (SELECT user_id AS device_id, event_id, ts, epoch_us(ts) / 1e6 AS t, event_type AS regime, value AS score, threshold, value > threshold AS anomalous, props,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events JOIN lim ON lim.regime = events.event_type)"""


def _gate(need: str = "2", clear: str = "2", rows: str = "r", keys: str = "device_id") -> str:
    return f""", g0 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t, event_id) - row_number() OVER (PARTITION BY {keys}, anomalous ORDER BY t, event_id) AS run FROM {rows}),
g1 AS (SELECT *, row_number() OVER (PARTITION BY {keys}, anomalous, run ORDER BY t, event_id) AS streak FROM g0),
g2 AS (SELECT *, CASE WHEN anomalous AND streak = {need} THEN 'T' WHEN NOT anomalous AND streak = {clear} THEN 'C' END AS marker FROM g1),
g AS (SELECT *, coalesce(marker = 'T' AND coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'C') = 'C', false) AS alert,
  coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 'T', false) AS in_episode FROM g2)"""


EPISODES = """ SELECT device_id, idx - {need} + 1 AS start_idx, idx AS alert_idx, clear_idx FROM (SELECT *, min(CASE WHEN marker = 'C' THEN idx END)
  OVER (PARTITION BY device_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS clear_idx FROM g) WHERE alert"""
_GAP = ", p AS (SELECT *, lead(t) OVER (PARTITION BY device_id ORDER BY t, event_id) - t AS gap FROM r)"
_RUNS = ", runs AS (SELECT device_id, run, count(*) AS length FROM g WHERE anomalous GROUP BY 1, 2)"
STARTED = f""", q AS (SELECT device_id, score / threshold AS x, row_number() OVER (PARTITION BY device_id ORDER BY t, event_id) AS n FROM r WHERE threshold > 0),
f AS (SELECT device_id, avg(CASE WHEN x > 1 THEN 1 ELSE 0 END) FILTER (WHERE n > {LEARNED}) AS share, quantile_cont(x, 0.5) FILTER (WHERE n > {LEARNED}) AS median, quantile_cont(x, 0.95) FILTER (WHERE n <= {LEARNED}) AS p95
  FROM q WHERE n <= {LEARNED + STARTUP} GROUP BY 1 HAVING count(*) = {LEARNED + STARTUP})
SELECT device_id, round(share, 6) AS share, round(median, 6) AS median, round(p95, 6) AS p95, share >= 0.75 AND median >= 5 * greatest(p95, 1.0) AS mismatch FROM f"""
_SPAN = ", span AS (SELECT device_id, max(t) - min(t) AS s FROM r GROUP BY 1)"
def _sweep_sql(unit_s: float) -> str:
    """One gate for every candidate, each device's windows counted by its own gap."""
    return BASE + _GAP + ", w AS (SELECT device_id, quantile_cont(gap, 0.5) AS w FROM p WHERE gap > 0 GROUP BY 1), x AS (SELECT r.*, c.need, greatest(1, coalesce(round_even(c.need * " + str(unit_s) + """ / w.w, 0), 1)) AS k
  FROM r LEFT JOIN w USING (device_id), (SELECT unnest(""" + str(CANDIDATES) + ") AS need) c)" + _gate("k", "2", "x", "need, device_id") + ", sweep AS (SELECT need, sum(CASE WHEN alert THEN 1 ELSE 0 END)::BIGINT AS alerts FROM g GROUP BY 1)"


SQL = {
    "alert_episodes": BASE + _gate() + EPISODES.format(need=2),
    "gate_clear1": BASE + _gate("2", "1") + EPISODES.format(need=2),
    "gate_runs": BASE + _gate() + _RUNS + " SELECT device_id, count(*) AS runs, max(length) AS longest, sum(length)::BIGINT AS windows FROM runs GROUP BY 1",
    "gate_tiers": BASE + _gate() + " SELECT device_id, CASE WHEN in_episode THEN 'red' WHEN anomalous THEN 'amber' ELSE 'green' END AS tier, count(*) AS windows FROM g GROUP BY 1, 2",
    "window_median_gap": BASE + _GAP + " SELECT device_id, round(quantile_cont(gap, 0.5), 6) AS window_s, count(*) AS gaps FROM p WHERE gap > 0 GROUP BY 1",
    "gaps_coverage": BASE + _GAP + """, w AS (SELECT device_id, quantile_cont(gap, 0.5) AS w FROM p WHERE gap > 0 GROUP BY 1)
SELECT device_id, count(CASE WHEN gap > 1.5 * w THEN 1 END) AS gaps, sum(CASE WHEN gap > 1.5 * w THEN round_even(gap / w, 0) - 1 ELSE 0 END)::BIGINT AS missed,
  round(count(*) * max(w) / (max(t) - min(t) + max(w)), 6) AS coverage FROM p JOIN w USING (device_id) GROUP BY 1""",
    "regime_thresholds": BASE + """, o AS (SELECT regime, quantile_cont(score, 0.995) AS e, avg(score) + 2.5 * stddev_pop(score) AS a, count(*) AS n FROM r GROUP BY 1)
SELECT regime, n, round(e, 6) AS empirical, round(a, 6) AS analytic, round(least(e, a), 6) AS threshold, e / a > 1.25 AS contaminated FROM o""",
    "crest_floor": BASE + " SELECT device_id, round(CASE WHEN count(score) >= 8 THEN least(10.0, greatest(6.5, max(score / 100) + 0.7)) ELSE 10.0 END, 6) AS crest_floor FROM r GROUP BY 1",
    "headroom_by_regime": BASE + """ SELECT regime, round(quantile_cont(score / threshold, 0.5), 6) AS p50, round(quantile_cont(score / threshold, 0.95), 6) AS p95, round(quantile_cont(score / threshold, 0.99), 6) AS p99,
  round(max(score / threshold), 6) AS top, round(avg(CASE WHEN score / threshold > 1 THEN 1 ELSE 0 END), 6) AS exceed, count(*) AS windows FROM r WHERE threshold > 0 GROUP BY ROLLUP (regime)""",
    "occupancy_daily": BASE + " SELECT floor(t / 86400)::BIGINT AS day, " + ", ".join(f"round(count(CASE WHEN regime = '{x}' THEN 1 END) / count(*), 6) AS {x}" for x in ("click", "error", "purchase", "signup", "view")) + " FROM r GROUP BY 1",
    "false_alarm_rate": BASE + _gate() + _SPAN + """, n AS (SELECT device_id, count(*) AS n FROM g WHERE alert GROUP BY 1)
SELECT device_id, coalesce(n, 0) AS alerts, round(coalesce(n, 0) / (s / 604800.0), 6) AS rate_per_week, round(CASE WHEN coalesce(n, 0) = 0 THEN -ln(0.05) / (s / 604800.0) END, 6) AS upper_if_none,
  coalesce(n, 0) / (s / 604800.0) <= 1 AS passes_point FROM span LEFT JOIN n USING (device_id) WHERE s > 0""",
    "geometric_tail": BASE + _gate() + _SPAN + _RUNS + """, o AS (SELECT device_id, count(*) AS n, avg(length) AS m, max(length) AS longest FROM runs GROUP BY 1)
SELECT device_id, n AS n_runs, round(n / (s / 604800.0), 6) AS runs_per_week, round(m, 6) AS mean_run, longest,
  CASE WHEN n / (s / 604800.0) <= 1 THEN 1 ELSE greatest(1, ceil(1 + ln(1 / (n / (s / 604800.0))) / ln(least(greatest(1 - 1 / m, 1e-6), 1 - 1e-9))))::BIGINT END AS need FROM o JOIN span USING (device_id) WHERE s > 0""",
    "persist_sweep": _sweep_sql(60.0) + " SELECT need, alerts FROM sweep",
    "persist_sweep_long": _sweep_sql(3600.0) + " SELECT need, alerts FROM sweep",
    "persist_recommend": _sweep_sql(3600.0) + _SPAN + " SELECT coalesce(min(need), 120) AS need FROM sweep WHERE alerts <= (SELECT sum(s) / 604800.0 FROM span)",
    "display_tier": BASE + """ SELECT event_id, round(CASE WHEN device_id % 4 <> 3 THEN CASE WHEN threshold <= 0 THEN 100.0 WHEN score <= 0 THEN 0.0
  WHEN log10(score / threshold) <= 0 THEN 70.0 * greatest(1 + log10(score / threshold), 0.0) ELSE 70.0 + 30.0 * least(log10(score / threshold) / 3.0, 1.0) END END, 6) AS display_index,
  CASE WHEN anomalous THEN 'red' ELSE 'green' END AS health FROM r""",
    "startup_fingerprint": BASE + STARTED,
    "learn_score_split": BASE + " SELECT device_id, CASE WHEN idx <= 8 THEN 'learn' ELSE 'score' END AS part, count(*) AS windows, round(avg(score), 6) AS mean_score FROM r GROUP BY 1, 2",
}
QUERIES = {f.__name__: f for f in (alert_episodes, gate_clear1, gate_runs, gate_tiers, window_median_gap, gaps_coverage, regime_thresholds, crest_floor, headroom_by_regime, occupancy_daily,
                                   false_alarm_rate, geometric_tail, persist_sweep, persist_sweep_long, persist_recommend, display_tier, startup_fingerprint, learn_score_split)}
