"""Signals in files of any known kind: CSV with or without a time column, WAV, and WAV bytes made from samples.

A file that can't be used has its reason in `error` and no samples; no file stops the others."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinemetry.functions import arrays as A
from kinemetry.functions.audit import gain
from kinemetry.sources.signals import parse_wav

SIGNALS = ("path string, fs double, channels int, time_column boolean, header boolean, jitter double, seconds double, "
           "samples array<array<double>>, error string")
#: A time axis starts by this second, and this share of its steps lies within half of their median;
#: a stated rate may differ from the file's own by this share; fewer rows are no signal.
START, REGULAR, APART, ROWS = 5.0, 0.95, 0.01, 4
KINDS = ("wav", "csv", "txt")
_ARROW = pa.schema([("path", pa.string()), ("fs", pa.float64()), ("channels", pa.int32()), ("samples", pa.list_(pa.list_(pa.float64()))), ("error", pa.string())])
#: What may part the fields of a CSV; the first of those that part its first line into most fields does.
SEPARATORS = (",", ";", "\t")


def _rows(text: Column) -> tuple[Column, Column, Column]:
    """The lines of a text that hold something, their separator, and their fields as trimmed strings."""
    lines = F.filter(F.split(F.ltrim(text, F.lit("\ufeff")), "\r?\n"), lambda line: F.regexp_like(line, F.lit(r"\S")))
    split_by = F.array_max(F.array(*[F.struct((F.length(F.get("lines", F.lit(0))) - F.length(F.replace(F.get("lines", F.lit(0)), F.lit(s), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)]))["s"]
    fields = F.transform("lines", lambda line: F.transform(F.split(line, F.col("by")), lambda f: F.btrim(f, F.lit(" \t\r"))))
    return lines, split_by, fields


def _median(ordered: Column) -> Column:
    n = F.size(ordered)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def csv_signals(texts: DataFrame, fs: float | None = None, channel: int | None = None, strict: bool = False) -> DataFrame:
    """SIGNALS of CSV texts (path, text), and `findings`, all that is wrong with each; the first is its `error`, and where
    there is one there are no samples.

    Fields are parted by comma, semicolon or tab. The first line is a header if it holds a field that is no number. The
    first column is the time if it rises at every row from near zero, mostly by even steps (a few lost rows show as
    jitter). Without a time column the rate must be given; with one, a given rate must agree. `strict` demands a rising
    first column as time beside a signal, as of an accelerometer."""
    number = lambda f: f.try_cast("double")
    lines, by, fields = _rows(F.col("text"))
    df = texts.select("path", "text", lines.alias("lines")).withColumn("by", F.when(F.size("lines") > 0, by)).withColumn("fields", fields)
    named = F.exists(F.get("fields", F.lit(0)), lambda f: (f != "") & number(f).isNull())
    df = df.withColumn("header", F.coalesce(F.when(F.size("lines") > 0, named), F.lit(False)))
    df = df.withColumn("rows", F.transform(F.slice("fields", F.when(F.col("header"), 2).otherwise(1), F.greatest(F.size("fields"), F.lit(1))), lambda r: F.transform(r, number)))
    df = df.withColumn("n", F.size("rows")).withColumn("width", F.when(F.col("n") > 0, F.size(F.get("rows", F.lit(0)))))
    odd = F.filter(F.transform("rows", lambda r, i: F.when((F.size(r) != F.col("width")) | F.exists(r, F.isnull), i)), F.isnotnull)
    df = df.withColumn("odd", F.when(F.col("n") > 0, F.get("lines", F.get(odd, F.lit(0)) + F.col("header").cast("int")))).drop("fields")
    df = df.withColumn("t", F.when(F.col("odd").isNull() & (F.col("n") >= ROWS), F.transform("rows", lambda r: F.get(r, F.lit(0)))))
    df = df.withColumn("steps", F.zip_with(F.slice("t", 2, F.size("t") - 1), F.slice("t", 1, F.size("t") - 1), lambda b, a: b - a))
    df = df.withColumn("step", A.bound(F.sort_array("steps"), _median)).withColumn("rising", F.coalesce(F.array_min("steps") > 0, F.lit(False)))
    even = F.size(F.filter("steps", lambda s: F.abs(s - F.col("step")) < F.col("step") / 2)) >= REGULAR * F.size("steps")
    timed = F.lit(True) if strict else F.coalesce((F.col("width") >= 2) & F.col("rising") & (F.get("t", F.lit(0)) <= START) & even, F.lit(False))
    df = df.withColumn("time_column", timed).withColumn("channels", F.col("width") - F.col("time_column").cast("int"))
    own, stated = 1 / F.when(F.col("rising"), F.col("step")), F.lit(fs).cast("double")
    cases = [
        (F.col("text").isNull(), F.lit("not UTF-8")), (F.size("lines") == 0, F.lit("empty")), (F.col("n") == 0, F.lit("no numeric rows")),
        (F.col("odd").isNotNull(), F.concat(F.lit("not a row of numbers: "), F.substring("odd", 1, 80))), ((F.col("n") > 0) & (F.col("n") < ROWS), F.format_string("only %d rows", "n")),
        (F.lit(strict) & F.col("t").isNotNull() & ((F.col("width") < 2) | ~F.col("rising")), F.lit("no rising time beside a signal")),
        (F.col("time_column") & (F.abs(stated / own - 1) > APART), F.format_string("stated rate %.3f Hz, but %.3f Hz by the time column", stated, own)),
        (~F.col("time_column") & stated.isNull(), F.lit("no time column and no stated rate"))]
    if channel is not None:
        cases.append(((F.col("channels") <= channel) | F.lit(channel < 0), F.format_string(f"no channel {channel} among %d", "channels")))
    df = df.withColumn("findings", F.array_compact(F.array(*[F.when(c, m) for c, m in cases]))).withColumn("error", F.try_element_at("findings", F.lit(1)))
    first = F.col("time_column").cast("int")
    every = F.sequence(first, F.col("width") - 1) if channel is None else F.array(first + channel)
    samples = F.transform(every, lambda c: F.transform("rows", lambda r: F.get(r, c)))
    good = lambda c: F.when(F.col("error").isNull(), c)
    timing = lambda c: good(F.when(F.col("time_column"), c))
    jitter = F.array_max(F.transform("steps", lambda s: F.abs(s - F.col("step")))) / F.col("step")
    out = F.struct("path", good(F.when(F.col("time_column"), own).otherwise(stated)).alias("fs"), good(F.size(every)).alias("channels"), good(F.col("time_column")).alias("time_column"), good(F.col("header")).alias("header"),
                   timing(jitter).alias("jitter"), timing(F.try_element_at("t", F.lit(-1)) - F.get("t", F.lit(0))).alias("seconds"), good(samples).alias("samples"), "error", "findings")
    # generated, not projected: a filter on a column of the result would be written out down to the text
    return df.select(F.inline(F.array(out)))


def wav_signals(files: DataFrame, channel: int | None = None) -> DataFrame:
    """SIGNALS of WAV files (path, content), and `findings`."""

    def one(name: str, data: bytes) -> dict:
        try:
            rate, x = parse_wav(data)
            x = x if channel is None else x[:, [channel]]
            return {"path": name, "fs": rate, "channels": x.shape[1], "samples": x.T.tolist(), "error": None}
        except (ValueError, IndexError, struct.error) as e:
            return {"path": name, "fs": None, "channels": None, "samples": None, "error": str(e)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield pa.RecordBatch.from_pylist([one(name, data)], schema=_ARROW)

    got = files.select("path", "content").mapInArrow(read, "path string, fs double, channels int, samples array<array<double>>, error string")
    good, none = F.col("error").isNull(), F.lit(None)
    return got.select("path", "fs", "channels", F.when(good, False).alias("time_column"), F.when(good, False).alias("header"), none.cast("double").alias("jitter"),
                      (F.size(F.get("samples", F.lit(0))) / F.col("fs")).alias("seconds"), "samples", "error", F.array_compact(F.array("error")).alias("findings"))


def signal_files(spark: SparkSession, path: str, fs: float | None = None, channel: int | None = None, strict: bool = False, need: float | None = None) -> DataFrame:
    """A row per file below `path` (SIGNALS and `findings`), read by its kind. `fs` is the rate of CSV files without time,
    `channel` selects one, `strict` reads CSV files as an accelerometer's, and `need` refuses files of another rate."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    csv = csv_signals(files.where(kind.isin("csv", "txt")).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")), fs, channel, strict)
    other = files.where(~kind.isin(*KINDS)).select("path", F.concat(F.lit("files of kind "), kind, F.lit(" are not read here")).alias("error")).withColumn("findings", F.array("error"))
    every = csv.unionByName(wav_signals(files.where(kind == "wav"), channel)).unionByName(other, allowMissingColumns=True)
    if not need:
        return every
    off = F.abs(F.col("fs") - need) > 1e-9
    every = every.withColumn("findings", F.when(off, F.concat("findings", F.array(F.format_string(f"%.3f Hz, not {need:g}", "fs")))).otherwise(F.col("findings")))
    every = every.withColumn("error", F.try_element_at("findings", F.lit(1)))
    return every.select("path", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in every.columns[1:-2]], "error", "findings")


def wav(x: Column, fs: Column) -> Column:
    """The bytes of a 16-bit WAV of one channel, samples beyond full scale held there; null if either is null."""

    def each(x: pd.Series, fs: pd.Series) -> pd.Series:
        out = []
        for v, rate in zip(x, fs, strict=True):
            if v is None or pd.isna(rate):
                out.append(None)
                continue
            body = np.clip(np.round(np.asarray(v, float) * 32768), -32768, 32767).astype("<i2").tobytes()
            out.append(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, int(rate), 2 * int(rate), 2, 16) + b"data" + struct.pack("<I", len(body)) + body)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(each, "binary")(x, fs)


def canonical(recordings: DataFrame, normalise: bool = False, signal: str = "audio", fs: str = "fs") -> DataFrame:
    """`recordings` with `wav`, its bytes at a gain that keeps them from clipping (or brings them to nine tenths of
    full scale), `applied_gain`, and `sha256` of the bytes, to be checked when they are read back."""
    peak = F.coalesce(F.array_max(F.transform(signal, lambda v: F.abs(v))), F.lit(0.0))
    scaled = recordings.withColumn("applied_gain", gain(peak, normalise))
    made = scaled.withColumn("wav", wav(F.transform(signal, lambda v: v * F.col("applied_gain")), F.col(fs)))
    return made.withColumn("sha256", F.sha2("wav", 256))
