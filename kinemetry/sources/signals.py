"""Recordings: WAV bytes to samples, samples to windows, names to labels."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNAL = "path string, fs double, channels int, audio array<double>"


def parse_wav(data: bytes) -> tuple[float, np.ndarray]:
    """Rate and samples (frames x channels) in -1..1: unsigned 8-bit about 128, integers by their least
    value, floats as they are. Raises ValueError on anything else."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
            kind = struct.unpack_from("<H", body, 24)[0] if form[0] == 0xFFFE and len(body) >= 26 else form[0]
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            channels, rate, bits = form[1], form[2], form[5]
            body = body[: len(body) // (channels * bits // 8) * (channels * bits // 8)]
            if kind == 3:
                x = np.frombuffer(body, f"<f{bits // 8}").astype(float)
            elif bits == 8:
                x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
            elif bits == 24:
                raw = np.frombuffer(body, np.uint8).reshape(-1, 3)
                x = (np.pad(raw, ((0, 0), (1, 0))).reshape(-1).view("<i4") >> 8) / float(1 << 23)
            elif bits in (16, 32):
                x = np.frombuffer(body, f"<i{bits // 8}") / float(1 << (bits - 1))
            else:
                raise ValueError(f"{bits}-bit samples")
            return float(rate), x.reshape(-1, channels)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def wav_files(spark: SparkSession, path: str, channel: int | None = None) -> DataFrame:
    """Every WAV below `path`: its samples, of one channel or the mean of all. A file that can't be read
    has a null rate and no samples."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    fs, x = parse_wav(data)
                    mono = x.mean(axis=1) if channel is None else x[:, channel]
                    row = (name, fs, x.shape[1], mono)
                except (ValueError, IndexError, struct.error):
                    row = (name, None, 0, np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.float64()), pa.array([row[2]], pa.int32()), pa.array([row[3]], pa.list_(pa.float64()))], names=["path", "fs", "channels", "audio"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(read, SIGNAL)


def windows(recordings: DataFrame, size: Column, hop: Column | None = None, signal: str = "audio") -> DataFrame:
    """Whole windows of `size` samples every `hop` (default: size), with their number `window`."""
    step = hop if hop is not None else size
    last = F.floor((F.size(signal) - size) / step).cast("int")
    at = F.when(F.size(signal) >= size, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return recordings.withColumn("window", F.explode(at)).withColumn(signal, F.slice(signal, (F.col("window") * step + 1).cast("int"), size.cast("int")))


def labelled(path: Column) -> Column:
    """What a data set's file name says: healthy or not (unknown names count as faulty), the race, the
    fault's size in inches and the load."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    race = F.regexp_extract(F.upper(stem), r"^(IR|OR|B)(\d{3})", 1)
    size = F.regexp_extract(F.upper(stem), r"^(?:IR|OR|B)(\d{3})", 1)
    load = F.regexp_extract(stem, r"_([0-3])", 1)
    return F.struct(F.lower(stem).contains("normal").alias("healthy"), F.nullif(race, F.lit("")).alias("race"),
                    (F.nullif(size, F.lit("")).cast("double") / 1000).alias("fault_size_in"), F.nullif(load, F.lit("")).cast("int").alias("load_hp"))
