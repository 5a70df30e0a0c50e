"""Recordings as bundles of files of one stem: sound (WAV), acceleration (CSV with time) and a sidecar (JSON).

Each kind is a file scan of its own, joined on the stem from all sides, so a file without its others is a row that says
what it lacks. Windows of both rates are cut on one clock, which begins with each signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinemetry.sources.recordings import csv_signals, wav_signals

#: Rate of the zeros that stand for acceleration where there is none, and seconds of a window (fixed value).
REST_FS, WINDOW_S = 6400.0, 30.0
AXES = ("accel_x", "accel_y", "accel_z")


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def bundles(spark: SparkSession, path: str, channel: int = 0) -> DataFrame:
    """One row per stem below `path`: stem, fs_audio, audio (one channel), fs_accel, accel_x, accel_y, accel_z, sidecar (the
    JSON text), missing (which of audio, acceleration and sidecar have no file) and findings (what is wrong with those
    that have one). A second or third axis that a CSV lacks is null; so is everything of a file that can't be used.
    Files of other kinds are left alone; of two files that differ only in the case of their kind the first by path counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    sound = wav_signals(files.where(kind == "wav"), channel).select(_stem("path").alias("stem"), "path", F.col("fs").alias("fs_audio"), F.get("samples", F.lit(0)).alias("audio"), F.concat(F.lit("audio: "), "error").alias("e"))
    moved = csv_signals(files.where(kind == "csv").select("path", text.alias("text")), strict=True)
    moved = moved.select(_stem("path").alias("stem"), "path", F.col("fs").alias("fs_accel"), *[F.get("samples", F.lit(i)).alias(a) for i, a in enumerate(AXES)], F.concat(F.lit("acceleration: "), "error").alias("e"))
    told = files.where(kind == "json").select(_stem(F.col("path")).alias("stem"), "path", text.alias("json"))
    fine = F.try_parse_json("json").isNotNull()
    told = told.select("stem", "path", F.when(fine, F.col("json")).alias("sidecar"), F.when(~fine | F.col("json").isNull(), "sidecar: no JSON").alias("e"))

    def one(df: DataFrame, name: str) -> DataFrame:
        own = [c for c in df.columns if c not in ("stem", "path")]
        first = df.groupBy("stem").agg(F.min_by(F.struct(*own), "path").alias("f"))
        return first.select("stem", *[F.col(f"f.{c}").alias(c if c != "e" else f"_{name}") for c in own], F.lit(name).alias(f"_has_{name}"))

    both = one(sound, "audio").join(one(moved, "acceleration"), "stem", "full").join(one(told, "sidecar"), "stem", "full")
    names = ("audio", "acceleration", "sidecar")
    lacks = F.array_compact(F.array(*[F.when(F.col(f"_has_{n}").isNull(), n) for n in names]))
    return both.select("stem", "fs_audio", "audio", "fs_accel", *AXES, "sidecar", lacks.alias("missing"), F.array_compact(F.array(*[F.col(f"_{n}") for n in names])).alias("findings"))


def windows(recordings: DataFrame, seconds: float = WINDOW_S) -> DataFrame:
    """The whole windows of bundles that have sound, one after another: stem, window, fs_audio, audio, fs_accel, and the
    axes over the same seconds. Where a bundle has no acceleration, and where an axis is null, there are zeros; where it
    has, windows end with the shorter of both. A bundle without sound has none."""
    def size(fs: Column) -> Column:
        return F.round(fs * seconds).cast("int")

    def begins(fs: Column) -> Column:
        return F.round(F.col("window") * seconds * fs).cast("int")

    has = F.col("accel_x").isNotNull()
    fs_accel = F.when(has, F.col("fs_accel")).otherwise(REST_FS)
    rows = recordings.where("audio is not null and fs_audio > 0").withColumn("has", has).withColumn("fs_accel", fs_accel)
    # as many as lie whole in each: a window's last sample is before the signal's end
    count = lambda x, fs: F.floor((F.size(x) + 0.5) / (fs * seconds))
    n = F.least(count(F.col("audio"), F.col("fs_audio")), F.when(F.col("has"), count(F.col("accel_x"), F.col("fs_accel"))))
    each = rows.withColumn("window", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))))
    cut = lambda x, fs: F.slice(x, begins(fs) + 1, size(fs))
    zeros = F.array_repeat(F.lit(0.0), size(F.col("fs_accel")))
    return each.select("stem", "window", "fs_audio", cut(F.col("audio"), F.col("fs_audio")).alias("audio"), "fs_accel",
                       *[F.when(F.col("has") & F.col(a).isNotNull(), cut(F.col(a), F.col("fs_accel"))).otherwise(zeros).alias(a) for a in AXES])
