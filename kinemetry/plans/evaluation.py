"""Detector evaluation: ranks, rates, trends, correlations, resampling."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinemetry.plans.monitoring import BASE, _readings
from kinemetry.sources.readings import table


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mann-Whitney on average ranks, per source: how well a text's length tells its quality.

    Ranks come from counts per value and a running sum over the values, not from a window over rows."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id").where("quality is not null")
    per = both.groupBy("source", "n_chars").agg(F.count("*").alias("n"), F.sum("quality").alias("pos"))
    below = F.sum("n").over(Window.partitionBy("source").orderBy("n_chars")) - F.col("n")
    r = per.withColumn("rank", below + (F.col("n") + 1) / 2)
    s = r.groupBy("source").agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    auc = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))
    return s.where("p > 0 and p < n").select("source", F.round(auc, 6).alias("auc"), "n")


def fpr_tpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the flag per device against a truth: errors are the fault."""
    bad, flag = F.col("regime") == "error", F.col("score") > 50
    return _readings(spark, sf_dir).groupBy("device_id").agg(
        F.round(F.sum((bad & flag).cast("int")) / F.sum(bad.cast("int")), 6).alias("tpr"), F.round(F.sum((~bad & flag).cast("int")) / F.sum((~bad).cast("int")), 6).alias("fpr"))


def slope_per_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear trend of the score over time, in units a week."""
    t = (F.col("t") - 1704067200) / 604800
    return _readings(spark, sf_dir).groupBy("device_id").agg(F.round(F.regr_slope(F.col("score"), t), 5).alias("slope"))


def quarter_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of a device's first and last quarter, and whether it rose."""
    n = F.count("*").over(Window.partitionBy("device_id"))
    r = _readings(spark, sf_dir).withColumn("n", n)
    early, late = (F.avg(F.when(c, F.col("score"))) for c in (F.col("idx") * 4 <= F.col("n"), F.col("idx") * 4 > 3 * F.col("n")))
    return r.groupBy("device_id").agg(F.round(early, 6).alias("early"), F.round(late, 6).alias("late"), (late > early).alias("rose"))


def curve_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each regime's quantile curve crosses 60, by linear interpolation between its deciles."""
    p = F.percentile("score", F.array(*[F.lit(i / 10) for i in range(11)]))
    q = _readings(spark, sf_dir).groupBy("regime").agg(p.alias("p")).select("regime", F.posexplode("p").alias("i", "y"))
    nxt = F.lead("y").over(Window.partitionBy("regime").orderBy("i"))
    return q.withColumn("z", nxt).where("y <= 60 and z > 60").select("regime", F.round((F.col("i") + (60 - F.col("y")) / (F.col("z") - F.col("y"))) / 10, 6).alias("level"))


REPLICATES = 200


def _weight(row: str, replicate: str) -> F.Column:
    """How often a replicate draws a row: Poisson(1) at 53 bits of a hash of both."""
    u = F.xxhash64(row, replicate).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    steps = list(accumulate(math.exp(-1) / math.factorial(k) for k in range(18)))
    w = F.when(u < steps[0], 0)
    for k, step in enumerate(steps[1:], 1):
        w = w.when(u < step, k)
    return w.otherwise(len(steps))


def _replicates(readings: DataFrame) -> DataFrame:
    """(regime, b, m): each regime's mean in each replicate; null where it draws none of its rows."""
    r = readings.select("regime", "score", "event_id", F.explode(F.sequence(F.lit(1), F.lit(REPLICATES))).alias("b")).withColumn("w", _weight("event_id", "b"))
    return r.groupBy("regime", "b").agg(F.try_divide(F.sum(F.col("score") * F.col("w")), F.sum("w")).alias("m"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence limits of each regime's mean over REPLICATES replicates. A row's weight in a replicate is
    drawn by a hash of both, so the resample is the same on every run."""
    m = _replicates(_readings(spark, sf_dir))
    return m.groupBy("regime").agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


def growth_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a day, their running total and the change from the day before."""
    d = _readings(spark, sf_dir).groupBy(F.floor(F.col("t") / 86400).alias("day")).agg(F.count("*").alias("rows"))
    by = Window.orderBy("day")  # one row a day
    return d.select("day", "rows", F.sum("rows").over(by).alias("total"), (F.col("rows") - F.lag("rows").over(by)).alias("change"))


SQL = {
    "roc_auc": """WITH b AS (SELECT source, n_chars, quality FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), c AS (SELECT source, n_chars, count(*) AS n, sum(quality) AS pos FROM b GROUP BY 1, 2),
k AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY n_chars) - n + (n + 1) / 2.0 AS rank FROM c), s AS (SELECT source, sum(rank * pos) AS s, sum(pos) AS p, sum(n) AS n FROM k GROUP BY 1)
SELECT source, round((s - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc, n::BIGINT AS n FROM s WHERE p > 0 AND p < n""",
    "fpr_tpr": BASE + """ SELECT device_id, round(sum(CASE WHEN regime = 'error' AND score > 50 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN regime = 'error' THEN 1 ELSE 0 END), 0), 6) AS tpr,
  round(sum(CASE WHEN regime <> 'error' AND score > 50 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN regime <> 'error' THEN 1 ELSE 0 END), 0), 6) AS fpr FROM r GROUP BY 1""",
    "slope_per_week": BASE + " SELECT device_id, round(regr_slope(score, (t - 1704067200) / 604800), 5) AS slope FROM r GROUP BY 1",
    "quarter_trend": BASE + """, q AS (SELECT *, count(*) OVER (PARTITION BY device_id) AS n FROM r) SELECT device_id, round(avg(CASE WHEN idx * 4 <= n THEN score END), 6) AS early, round(avg(CASE WHEN idx * 4 > 3 * n THEN score END), 6) AS late,
  avg(CASE WHEN idx * 4 > 3 * n THEN score END) > avg(CASE WHEN idx * 4 <= n THEN score END) AS rose FROM q GROUP BY 1""",
    "curve_invert": BASE + ", q AS (" + " UNION ALL ".join(f"SELECT regime, {i} AS i, quantile_cont(score, {i / 10}) AS y FROM r GROUP BY 1" for i in range(11)) + """), z AS (SELECT *, lead(y) OVER (PARTITION BY regime ORDER BY i) AS z FROM q)
SELECT regime, round((i + (60 - y) / (z - y)) / 10, 6) AS level FROM z WHERE y <= 60 AND z > 60""",
    "growth_per_day": BASE + ", d AS (SELECT floor(t / 86400)::BIGINT AS day, count(*) AS rows FROM r GROUP BY 1) SELECT day, rows, (sum(rows) OVER (ORDER BY day))::BIGINT AS total, rows - lag(rows) OVER (ORDER BY day) AS change FROM d",
}
QUERIES = {f.__name__: f for f in (roc_auc, fpr_tpr, slope_per_week, quarter_trend, curve_invert, bootstrap_ci, growth_per_day)}
