"""Distances of windows to models that have not seen them, and the thresholds from such distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinemetry.operators.baseline import learn, scores, thresholds

#: Folds, windows a regime needs for them, what raises a threshold from in-sample distances.
FOLDS, ENOUGH, RAISED = 5, 15, 1.5


def _named(regime: str, fold: str) -> Column:
    return F.when(F.col(f"`{regime}`").isNotNull(), F.to_json(F.struct(F.col(f"`{regime}`").alias("r"), F.col(fold).alias("f"))))


def held_out_scores(windows: DataFrame, key: Column, regime: str = "regime", x: str = "x", folds: int = FOLDS) -> DataFrame:
    """`windows` with `score`, the distance to the model that its regime's windows of the other folds make.

    A window's fold is `key` (a whole number, such as a hash of its id) modulo `folds`; a null key has no score, nor has
    a window whose regime has none in other folds, a null regime or a null vector. Of the training copies only sums
    leave a task. An input column `score` is replaced."""
    rows = windows.withColumn("_fold", F.pmod(key, F.lit(folds)))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("_fold"))
    train = rows.select(F.col(f"`{regime}`"), F.col(f"`{x}`"), F.explode(others).alias("_without")).withColumn("_model", _named(regime, "_without"))
    # one type on both sides, for the name holds the number's text only
    own = rows.withColumn("_fold", F.col("_fold").cast("int")).withColumn("_model", F.when(F.col("_fold").isNotNull(), _named(regime, "_fold")))
    return scores(own, learn(train, "_model", x), "_model", x).drop("_fold", "_model")


def fair_distances(windows: DataFrame, key: Column, models: DataFrame, regime: str = "regime", x: str = "x") -> DataFrame:
    """(regime, score, n) of every window: its held-out distance, and how many windows its regime has; where these are
    fewer than ENOUGH the distance to its regime's model in `models`, which has seen it."""
    sizes = models.select(F.col(f"`{regime}`"), "n")
    kept = [F.col(f"`{regime}`"), F.col("score"), F.col("n")]
    few = sizes.where(F.col("n") < ENOUGH)
    fair = held_out_scores(windows, key, regime, x).join(sizes.where(F.col("n") >= ENOUGH), regime).select(*kept)
    near = scores(windows.join(few.select(regime), regime, "left_semi"), models, regime, x).join(few, regime).select(*kept)
    return fair.unionByName(near)


def raised(of: Column, n: Column) -> Column:
    """A threshold from the distances of n windows: if these are in-sample ones, which are too low, by half more."""
    return of * F.when(n < ENOUGH, RAISED).otherwise(1.0)


def learned_thresholds(windows: DataFrame, key: Column, regime: str = "regime", x: str = "x") -> DataFrame:
    """`baseline.thresholds` of every regime from its `fair_distances`."""
    t = thresholds(fair_distances(windows, key, learn(windows, regime, x), regime, x), regime)
    return t.select(regime, "n", *[raised(F.col(c), F.col("n")).alias(c) for c in ("threshold", "empirical", "analytic")], "ratio", "contaminated")
