"""Learn queries: each label of `embeddings` is a regime, the whole vector the features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinemetry.operators import baseline, features, held_out, machine, regimes
from kinemetry.plans.spectral import _points
from kinemetry.sources.folders import folder
from kinemetry.sources.readings import table


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def ledoit_wolf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrunk covariance of each regime, all its rows."""
    m = baseline.learn(_windows(spark, sf_dir), "label")
    return m.select("label", "n", F.round("shrinkage", 6).alias("shrinkage"), F.transform("covariance", lambda row: F.transform(row, lambda v: F.round(v, 6))).alias("covariance"))


def mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each window to its regime."""
    w = _windows(spark, sf_dir)
    return baseline.scores(w, baseline.learn(w, "label"), "label").select("vec_id", "label", F.round("score", 5).alias("score"))


def held_out_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each window to what the other four folds of its regime make."""
    return held_out.held_out_scores(_windows(spark, sf_dir), F.col("vec_id"), "label").select("vec_id", "label", F.round("score", 5).alias("score"))


def learned_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of each regime from held-out distances."""
    t = held_out.learned_thresholds(_windows(spark, sf_dir), F.col("vec_id"), "label")
    return t.select("label", "n", *[F.round(c, 4).alias(c) for c in ("threshold", "empirical", "analytic", "ratio")], "contaminated")


def chosen_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime of every window, among those that the learn windows of its device (a label) show by their standardised
    operating points."""
    found = regimes.choose(_points(spark, sf_dir), "label", "vec_id", F.array("a", "b", "c"))
    return found.select(F.col("device").alias("label"), F.col("id").alias("vec_id"), "regime", "regimes", F.round("silhouette", 6).alias("silhouette"))


def effective_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many directions each regime's windows vary in, whole vectors."""
    m = baseline.learn(_windows(spark, sf_dir), "label", shrunk=False)
    return m.select("label", "n", F.round(regimes.effective_rank("covariance"), 4).alias("effective_rank"))


def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a model that was saved as a table and read again."""
    w, at = _windows(spark, sf_dir), f"{folder(spark)}/model"
    baseline.learn(w, "label").write.parquet(at)
    return baseline.scores(w, spark.read.parquet(at), "label").groupBy("label").agg(F.count("*").alias("windows"), F.round(F.max("score"), 5).alias("worst"))


#: Vectors in a row that make one window of 4096 samples.
VECTORS = 64


def features37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature vector of windows that VECTORS embeddings in a row make, as sound at 16 kHz and, on one axis, as
    acceleration at 6.4 kHz; an unfinished last window is left out."""
    e = table(spark, sf_dir, "embeddings").withColumn("window", F.floor(F.col("vec_id") / VECTORS))
    rows = e.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v")).where(F.size("v") == VECTORS)
    w = rows.select("window", F.flatten("v.embedding").alias("audio"), F.lit(16000.0).alias("fs_audio"), F.lit(6400.0).alias("fs_accel"))
    made = features.with_features(w.select("*", F.col("audio").alias("accel_x"), *[F.lit(None).cast("array<double>").alias(f"accel_{a}") for a in "yz"]))
    return made.select("window", "band_low", F.round("band_crest", 5).alias("band_crest"), "fr_hz", "fr_reliable", F.posexplode("vector").alias("i", "value")).withColumn("value", F.round("value", 5))


#: Vectors that make a window of 256 samples, machines that take turns, and windows that each learns from.
SHORT, MACHINES, LEARN = 4, 2, 20


def _machine_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, window, nth, SIGNAL): windows of SHORT vectors in a row, dealt to the machines in turns; nth counts each
    machine's. An unfinished last window is left out."""
    e = table(spark, sf_dir, "embeddings").withColumn("window", F.floor(F.col("vec_id") / SHORT))
    rows = e.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v")).where(F.size("v") == SHORT)
    none = F.lit(None).cast("array<double>")
    return rows.select((F.col("window") % MACHINES).alias("device"), "window", F.floor(F.col("window") / MACHINES).alias("nth"), F.flatten("v.embedding").cast("array<double>").alias("audio"),
                       F.lit(16000.0).alias("fs_audio"), F.lit(6400.0).alias("fs_accel"), F.flatten("v.embedding").cast("array<double>").alias("accel_x"), none.alias("accel_y"), none.alias("accel_z"))


def learn_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each machine learns from its first windows; the model is saved, checked and read again, and scores all the others."""
    windows, at = _machine_windows(spark, sf_dir), f"{folder(spark)}/models"
    machine.save(machine.fit(windows.where(F.col("nth") < LEARN)), at)
    found = machine.score(windows.where(F.col("nth") >= LEARN), machine.load(spark, at))
    return found.select("device", "window", "regime", F.round("score", 4).alias("score"), F.round("threshold", 4).alias("threshold"), "anomalous", F.round("fr_hz", 6).alias("fr_hz"))


#: Whole vectors have no short SQL; tests hold these queries against numpy.
SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (ledoit_wolf, mahalanobis, held_out_distance, learned_thresholds, features37, chosen_regimes, effective_ranks, saved_model, learn_and_score)}
