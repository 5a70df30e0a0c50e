"""The alert gate over ordered flags, in window functions.

A device's flags are cut into runs. A row is a marker T if it is the `need`-th flagged row of its run,
and C if it is the `clear`-th normal one. An alert fires at a T that no other marker since the last C
precedes; the device is in an episode while its last marker is T. need and clear may be columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marked(flags: DataFrame, keys: list[str], order: list[str], flag: str, need: Column, clear: Column, chunk: Column | None = None) -> DataFrame:
    """`flags` with streak (place in the run of equal flags), run, marker, alert and in_episode.

    With `chunk`, a column that never falls along the order, a device's rows are dealt by chunk too (see `_by_chunks`): no
    task orders more than one chunk, however many rows a device has. The results are the same; idx is added, the place
    of a row among its device's, and the column _chunk stays."""
    if chunk is not None:
        return _by_chunks(flags.withColumn("_chunk", chunk), keys, order, flag, F.greatest(F.lit(1), need), clear)
    by = Window.partitionBy(*keys).orderBy(*order)
    run = F.row_number().over(by) - F.row_number().over(Window.partitionBy(*keys, flag).orderBy(*order))
    out = flags.withColumn("run", run).withColumn("streak", F.row_number().over(Window.partitionBy(*keys, flag, "run").orderBy(*order)))
    out = out.withColumn("marker", _marker(flag, F.greatest(F.lit(1), need), clear))
    return out.withColumn("alert", _fires(_last(by, -1))).withColumn("in_episode", F.coalesce(_last(by, 0) == "T", F.lit(False)))


def _marker(flag: str, need: Column, clear: Column) -> Column:
    return F.when(F.col(flag) & (F.col("streak") == need), "T").when(~F.col(flag) & (F.col("streak") == clear), "C")


def _last(by: Window, upto: int, of: str = "marker") -> Column:
    return F.last(of, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, upto))


def _fires(before: Column) -> Column:
    return F.coalesce((F.col("marker") == "T") & (F.coalesce(before, F.lit("C")) == "C"), F.lit(False))


def _by_chunks(rows: DataFrame, keys: list[str], order: list[str], flag: str, need: Column, clear: Column) -> DataFrame:
    """The gate as a prefix scan: what each chunk does to the state that it is entered with is one row, these rows are put
    in order device by device, and each chunk is then given the state that the ones before it leave behind.

    That state is the run that reaches the chunk's beginning (its flag and length), the rows and flags before it, and
    the last marker; the marker depends on the run, so it is handed on in a second turn."""
    here = [*keys, "_chunk"]
    by, chain = Window.partitionBy(*here).orderBy(*order), Window.partitionBy(*keys).orderBy("_chunk")
    own = rows.withColumn("idx", F.row_number().over(by))
    own = own.withColumn("run", F.col("idx") - F.row_number().over(Window.partitionBy(*here, flag).orderBy(*order)))
    own = own.withColumn("streak", F.row_number().over(Window.partitionBy(*here, flag, "run").orderBy(*order)))
    f = F.col(flag)
    chunks = own.groupBy(*here).agg(F.count("*").alias("n"), F.count(F.when(f, 1)).alias("n_true"), F.count(F.when(~f, 1)).alias("n_false"), F.min_by(flag, "idx").alias("first"), F.max_by(flag, "idx").alias("last"), F.max_by("streak", "idx").alias("tail"))
    goes_on = F.coalesce((F.col("tail") == F.col("n")) & F.col("first").eqNullSafe(F.lag("last").over(chain)) & (F.row_number().over(chain) > 1), F.lit(False))
    chunks = chunks.withColumn("breaks", F.sum(F.when(goes_on, 0).otherwise(1)).over(chain))
    chunks = chunks.withColumn("reach", F.sum("tail").over(Window.partitionBy(*keys, "breaks").orderBy("_chunk")))  # tail is n where the run goes on
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    left = chunks.select(*here, F.lag("reach").over(chain).alias("_reach"), F.lag("last").over(chain).alias("_flag"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", "n_true", "n_false")])
    out = _given(own, left, here)
    joined = (F.col("idx") == F.col("streak")) & f.eqNullSafe(F.col("_flag")) & F.col("_reach").isNotNull()
    other = F.when(f, F.col("_n") - F.col("_n_true")).when(~f, F.col("_n") - F.col("_n_false")).otherwise(F.col("_n_true") + F.col("_n_false"))
    out = out.withColumn("streak", F.col("streak") + F.when(joined, F.col("_reach")).otherwise(0)).withColumn("run", F.col("run") + other).withColumn("idx", F.col("idx") + F.col("_n"))
    out = out.drop("_reach", "_flag", "_n", "_n_true", "_n_false").withColumn("marker", _marker(flag, need, clear))
    last = out.groupBy(*here).agg(F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("idx"))).alias("last"))
    out = _given(out, last.select(*here, _last(chain, -1, "last").alias("_before")), here)
    out = out.withColumn("alert", _fires(F.coalesce(_last(by, -1), F.col("_before"))))
    return out.withColumn("in_episode", F.coalesce(F.coalesce(_last(by, 0), F.col("_before")) == "T", F.lit(False))).drop("_before")


def _given(rows: DataFrame, chunks: DataFrame, here: list[str]) -> DataFrame:
    """`rows` with the columns of their chunk; null keys are keys."""
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in here]
    return rows.alias("a").join(chunks.alias("b"), reduce(lambda x, y: x & y, on)).select("a.*", *[f"b.{c}" for c in chunks.columns if c not in here])


def episodes(gated: DataFrame, keys: list[str], order: list[str], idx: str, need: Column) -> DataFrame:
    """One row per alert: keys, start_idx, alert_idx, and clear_idx, null while it lasts."""
    # read backwards, so that a row adds to what is behind it instead of the frame being read anew
    here = [*keys, "_chunk"] if "_chunk" in gated.columns else keys
    later = Window.partitionBy(*here).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    cleared = F.last(F.when(F.col("marker") == "C", F.col(idx)), ignorenulls=True).over(later)
    found = gated.withColumn("clear_idx", cleared).where("alert")
    if here != keys:
        first = gated.where("marker = 'C'").groupBy(*here).agg(F.min(idx).alias("first"))
        every = gated.select(*here).distinct().alias("a").join(first.alias("b"), reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in here]), "left").select("a.*", "b.first")
        after = F.last("first", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1))
        found = _given(found, every.select(*here, after.alias("_after")), here).withColumn("clear_idx", F.coalesce("clear_idx", "_after"))
    return found.select(*keys, (F.col(idx) - F.greatest(F.lit(1), need) + 1).alias("start_idx"), F.col(idx).alias("alert_idx"), "clear_idx")


def excursions(gated: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Lengths of the flagged runs."""
    return gated.where(flag).groupBy(*keys, "run").agg(F.count("*").alias("length"))
