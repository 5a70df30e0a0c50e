"""What the text operators share: shared-folder tables, connected components, text blocks."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where the session names none and runs in one process (a local test) a temporary folder is
    made; a cluster without the setting is refused, as its machines share no temporary folder."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all machines share")
        at = tempfile.mkdtemp(prefix="kinemetry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that `written` made."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, read again, and its path.

    Lineage ends there, so a lost executor costs no earlier stage. The table goes with the
    process, or earlier by `drop_table`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kinemetry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


@atexit.register
def _clear() -> None:
    for spark, path in _scratch:
        try:
            drop_table(spark, path)
        except Exception:  # noqa: BLE001, S112  the JVM may be gone; the other folders have their turn
            continue


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (u, v): a row (id, component) for each id that has an
    edge, where component is the smallest id that can be reached.

    Alternates the large-star and small-star steps, which only ever join an id to the minimum
    of its neighbours: a step moves as many rows as there are edges, whatever the size of the
    largest component, and minima are combined before the shuffle. Each step is a table in the
    shared folder. Self loops, repeated edges, either direction and no edges at all are fine."""
    spark = edges.sparkSession
    now, path = written(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every pair is (larger, smaller) now; small-star joins what is below an id to its minimum
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after, new = written(small)
        drop_table(spark, path)
        now, path = after, new
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
                       F.count_distinct("u")).first()
        if told == before or told[0] == 0:
            break
        before = told
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about `most` units in all; a larger row stands alone."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        yield at, len(sizes)


def text_bytes(col: pa.Array) -> list[bytes | None]:
    """The UTF-8 of a string column, null where the text is null."""
    return col.cast(pa.binary()).to_pylist()


def chosen(df: DataFrame, name: str, make: Callable) -> DataFrame:
    """`df` with the fields of the struct column `make()`; a clashing input column gives way."""
    made = df.withColumn(tmp := f"_{uuid.uuid4().hex[:8]}", make)
    fields = made.schema[tmp].dataType.fieldNames()
    kept = [F.col(f"`{c}`") for c in df.columns if c not in fields]
    return made.select(*kept, *[F.col(f"`{tmp}`.`{f}`").alias(f) for f in fields])
