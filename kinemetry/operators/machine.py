"""A machine's model from its own windows: learned in two passes, kept in versions, checked before it scores.

The first pass hears only how periodic each window is, which sets the floor that the second extracts features at; the
model carries that floor, so what is scored later is extracted as what was learned. All machines are learned at once:
models are rows, and no task gathers more of a machine than the sums of its windows and its bounded learn set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinemetry.operators import baseline, features, held_out, regimes
from kinemetry.sources import folders

#: Fixed values of the floor: windows it needs, what is added to the greatest crest, its bounds (the upper one without enough windows).
CRESTS, MARGIN, FLOORS = 8, 0.7, (6.5, features.CREST_FLOOR)
#: Share of the mean rate, least mean rate, and decades of level by which operating points differ by one.
RATE_SHARE, LEAST_RATE, DECADES = 0.05, 1.0, 0.1
#: Places in the vector of the levels of sound and of the first axis.
LEVELS = (features.NAMES.index("channel_stats.audio.0"), features.NAMES.index("channel_stats.accel_x.0"))
SIGNAL = ["audio", "fs_audio", "accel_x", "accel_y", "accel_z", "fs_accel"]


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def floors(windows: DataFrame) -> DataFrame:
    """(device, crest_floor): the first pass over the windows."""
    crest = features.band_crest(F.col("audio"), F.col("fs_audio"))
    good = F.when(_finite(F.col("crest")), F.col("crest"))
    set_ = F.least(F.lit(FLOORS[1]), F.greatest(F.lit(FLOORS[0]), F.max(good) + MARGIN))
    return windows.select("device", crest.alias("crest")).groupBy("device").agg(F.when(F.count(good) >= CRESTS, set_).otherwise(FLOORS[1]).alias("crest_floor"))


def _point(fr: Column, vector: Column) -> Column:
    return F.array(fr, *[F.get(vector, F.lit(i)) for i in LEVELS])


def _scaled(x: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), scale, lambda a, b: a / b)


def _placed(points: DataFrame) -> DataFrame:
    """`points` (…, device, vector, fr_hz, and the scales of its model) with z, the standardised vector, and p, the point."""
    return points.withColumn("z", _scaled(F.col("vector"), F.col("mean"), F.col("std"))).withColumn("p", _scaled(_point(F.col("fr_hz"), F.col("vector")), F.col("op_mean"), F.col("op_scale")))


def _scales(learn: DataFrame) -> DataFrame:
    """Per device mean and deviation of each feature, and mean and scale of the operating point."""
    each = learn.select("device", F.posexplode(F.concat("vector", _point(F.col("fr_hz"), F.col("vector")))).alias("i", "v")).groupBy("device", "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    whole = each.groupBy("device").agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("all"))  # as many as features
    n = len(features.NAMES)
    op_mean = F.slice(F.col("all.m"), n + 1, 3)
    scale = F.array(RATE_SHARE * F.greatest(op_mean[0], F.lit(LEAST_RATE)), F.lit(DECADES), F.lit(DECADES))
    return whole.select("device", F.slice(F.col("all.m"), 1, n).alias("mean"), F.transform(F.slice(F.col("all.s"), 1, n), lambda s: s + 1e-9).alias("std"), op_mean.alias("op_mean"), scale.alias("op_scale"))


def fit(windows: DataFrame) -> DataFrame:
    """A row for each regime of each device: its model, from learn windows (device, window, SIGNAL) of healthy machines.

    Windows without features don't count; a device with none has no model. Folds go by the number of a window. The
    columns are those of the model table: names, crest_floor, mean, std, op_mean, op_scale, silhouette of the device;
    regime, centre, n, own_mean, precision, threshold, empirical, analytic, ratio, contaminated of the regime; and of all
    the device's windows the median and 95th percentile of distance over threshold."""
    floor = folders.kept(floors(windows))
    made = features.with_features(windows.join(floor, "device"), floor="crest_floor").where("vector is not null")
    learn = folders.kept(made.select("device", "window", "vector", "fr_hz"))
    scale = folders.kept(_scales(learn))
    placed = _placed(learn.join(scale, "device")).select("device", "window", "z", "p")
    shown = folders.kept(regimes.models(placed, "device", "window", F.col("p")))
    near = regimes.assigned(placed.select("device", F.col("window").alias("id"), "p", "z"), shown)
    rows = folders.kept(near.where("regime is not null").select("device", "regime", F.col("id").alias("window"), "z", F.to_json(F.struct("device", "regime")).alias("model")))
    models = folders.kept(baseline.learn(rows, "model", "z"))
    fair = folders.kept(held_out.fair_distances(rows, F.col("window"), models, "model", "z"))
    t = baseline.thresholds(fair, "model")
    t = folders.kept(t.select("model", *[held_out.raised(F.col(c), F.col("n")).alias(c) for c in ("threshold", "empirical", "analytic")], "ratio", "contaminated"))
    of_model = rows.select("model", "device", "regime").distinct()
    over = fair.join(t.select("model", "threshold"), "model").join(of_model, "model").groupBy("device").agg(
        F.percentile(F.col("score") / F.greatest("threshold", F.lit(1e-9)), F.array(F.lit(0.5), F.lit(0.95))).alias("r"))
    device = scale.join(floor, "device").join(shown, "device").join(over.select("device", F.col("r")[0].alias("startup_median"), F.col("r")[1].alias("startup_p95")), "device")
    own = of_model.join(models.select("model", "n", F.col("mean").alias("own_mean"), "precision"), "model").join(t, "model").drop("model")
    names = F.array(*map(F.lit, features.NAMES)).alias("names")
    return own.join(device, "device").withColumn("centre", F.get("centres", F.col("regime"))).drop("centres").select("*", names)


#: What a model must be to score by it: findings by name.
CONTRACT = {
    "names": lambda: F.col("names") != F.array(*map(F.lit, features.NAMES)),
    "sizes": lambda: (F.size("mean") != len(features.NAMES)) | (F.size("std") != len(features.NAMES)) | (F.size("own_mean") != len(features.NAMES)) | (F.size("precision") != len(features.NAMES))
    | F.exists("precision", lambda r: F.size(r) != len(features.NAMES)) | (F.size("op_mean") != 3) | (F.size("op_scale") != 3) | (F.size("centre") != 3),
    "not finite": lambda: F.exists(F.concat("mean", "std", "own_mean", "op_mean", "op_scale", "centre", F.flatten("precision"), F.array("threshold", "crest_floor")), lambda v: ~_finite(v)),
    "deviations": lambda: F.exists(F.concat("std", "op_scale"), lambda v: v <= 0),
    "threshold": lambda: F.col("threshold") <= 0,
}


def findings(model: DataFrame) -> DataFrame:
    """(device, regime, findings): which parts of the contract each row of a model breaks."""
    cases = [F.when(F.coalesce(broken(), F.lit(True)), name) for name, broken in CONTRACT.items()]
    return model.select("device", "regime", F.array_compact(F.array(*cases)).alias("findings"))


def checked(model: DataFrame) -> DataFrame:
    """The model; refused if a row breaks the contract, or there is none."""
    told = findings(model).select(F.explode_outer("findings").alias("f")).groupBy("f").count().collect()  # as many rows as findings
    broken = sorted(r.f for r in told if r.f is not None)
    if broken or not told:
        raise ValueError(f"model refused: {', '.join(broken) or 'no rows'}; learn anew")
    return model


def save(model: DataFrame, at: str) -> int:
    """The model as the next version below `at`, once it holds the contract. Returns its number."""
    spark = model.sparkSession
    number = 1 + max((int(n[8:]) for n in folders.names(spark, at) if n.startswith("version=")), default=0)
    checked(model).write.parquet(f"{at}/version={number}")
    return number


def load(spark: SparkSession, at: str, number: int | None = None) -> DataFrame:
    """A version of the model, the newest that was written whole unless one is named; refused if it breaks the contract,
    as one of other features does."""
    whole = [int(n[8:]) for n in folders.names(spark, at) if n.startswith("version=") and folders.exists(spark, f"{at}/{n}/_SUCCESS")]
    if not whole or number is not None and number not in whole:
        raise ValueError(f"no model below {at}")
    return checked(spark.read.parquet(f"{at}/version={number or max(whole)}"))


def score(windows: DataFrame, model: DataFrame) -> DataFrame:
    """(device, window, regime, score, threshold, anomalous, fr_hz) of windows (device, window, SIGNAL): the distance to
    the model of the regime whose centre is nearest. A device without a model has no rows; a window without features
    has nulls, and isn't anomalous. Models are joined: Spark sends them to all tasks if their size allows it."""
    device = model.groupBy("device").agg(F.sort_array(F.collect_list(F.struct("regime", "centre"))).alias("all"), *[F.first(c).alias(c) for c in ("crest_floor", "mean", "std", "op_mean", "op_scale")])
    device = device.withColumn("centres", F.col("all.centre")).withColumn("silhouette", F.lit(None).cast("double"))
    made = features.with_features(windows.join(device.select("device", "crest_floor"), "device"), floor="crest_floor").select("device", "window", "vector", "fr_hz")
    placed = _placed(made.join(device.drop("all", "crest_floor", "centres", "silhouette"), "device")).select("device", F.col("window").alias("id"), "z", "p", "fr_hz")
    near = regimes.assigned(placed, device.select("device", "centres", "silhouette")).withColumn("model", F.to_json(F.struct("device", "regime")))
    own = model.select(F.to_json(F.struct("device", "regime")).alias("model"), F.col("own_mean").alias("mean"), "precision", "threshold")
    scored = baseline.scores(near, own, "model", "z").join(own.select("model", "threshold"), "model", "left")
    return scored.select("device", F.col("id").alias("window"), "regime", "score", "threshold", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)).alias("anomalous"), "fr_hz")
