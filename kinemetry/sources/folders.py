"""Folders that driver and executors share: made below spark.checkpoint.dir, listed, dropped, and cleared with the process."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which goes with the process; a temporary one only where a local session
    names none."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        at = tempfile.mkdtemp(prefix="kinemetry-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not at:
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all machines share")
    _made.append((spark, new := f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"))
    return new


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in a new folder, read again: what is read more than once is made once."""
    at = folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _found(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    p, fs = _found(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _found(spark, path)
    return fs.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    p, fs = _found(spark, path)
    fs.delete(p, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001, S112  the JVM may be gone; the other folders have their turn
            continue
