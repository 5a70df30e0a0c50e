"""Exact quantiles of groups of any size, without a task that holds a group's values.

A small group goes through Spark's own exact percentile. A large one is narrowed in rounds: the values between two
bounds are counted in bins, and the bin in which the wanted rank lies gives the next bounds, until it holds few enough
values to be sorted, or one value only. Each round sends one row per bin and task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinemetry.sources import folders

#: Values of a group, or between the last bounds, that one task may hold, and bins of a round.
FEW, BINS = 50_000, 1024


def _same(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def _matched(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie within bounds of their group; bounds of a group are apart, so a value lies in one."""
    within = F.col("a.v").between(F.col("b.low"), F.col("b.high"))
    return rows.alias("a").join(bounds.alias("b"), _same(keys, "a", "b") & within).select("b.*", "a.v")


def _bin(by_log: bool) -> Column:
    """The bin of v between low and high. Infinite values have bins of their own, and finite ones wait for the next round
    where a bound is infinite. Bounds that are one on this scale can't be parted on it: the next round takes the other."""
    s = (lambda c: F.signum(c) * F.log1p(F.abs(c))) if by_log else lambda c: c / 2  # halves, so that no span overflows
    v, low, high = s(F.col("v")), s(F.col("low")), s(F.col("high"))
    apart = (high > low) & (F.abs(F.col("low")) < float("inf")) & (F.abs(F.col("high")) < float("inf"))
    among = F.when(apart, F.least(F.lit(BINS - 1), F.floor((v - low) / (high - low) * BINS))).otherwise(0)
    return F.when(F.col("v") == float("-inf"), -1).when(F.col("v") == float("inf"), BINS).otherwise(among)


def _ranked(rows: DataFrame, open_: DataFrame, keys: list[str], by_log: bool) -> DataFrame:
    """The open ranks (keys, rank, low, high, below) with the bounds of the bin that each lies in."""
    met = _matched(rows, open_.select(*keys, "low", "high", "below").distinct(), keys)
    bins = met.withColumn("bin", _bin(by_log)).groupBy(*keys, "low", "high", "below", "bin").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    bins = bins.withColumn("before", F.col("below") + F.sum("n").over(Window.partitionBy(*keys, "low").orderBy("bin")) - F.col("n"))
    in_bin = (F.col("o.low") == F.col("b.low")) & (F.col("o.rank") > F.col("b.before")) & (F.col("o.rank") <= F.col("b.before") + F.col("b.n"))
    return open_.alias("o").join(bins.alias("b"), _same(keys, "o", "b") & in_bin).select(
        *[f"o.{k}" for k in keys], "o.rank", F.col("b.least").alias("low"), F.col("b.most").alias("high"), F.col("b.before").alias("below"), F.col("b.n").alias("n"))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], few: int | None = None) -> DataFrame:
    """One row per group of `keys` (none: one row): n, and q, the exact `qs` quantiles (0 to 1) of its values, interpolated
    between neighbours as `percentile` does. Null and NaN values don't count; a group without others has no row. An
    infinite value counts, at either end. Null keys are a group."""
    few = few or FEW
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*[F.col(f"`{k}`").alias(k) for k in keys], (v + F.lit(0.0)).alias("v")).where(v.isNotNull() & ~F.isnan(v))
    # groups of more than `few`: fewer than all rows divided by that
    large = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where(F.col("n") > few)
    some = not large.isEmpty()
    large = folders.kept(large) if some else large
    small = rows if not some else rows.alias("a").join(large.alias("b"), _same(keys, "a", "b"), "left_anti")
    out = small.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).where("n > 0")
    if not some:
        return out
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * q) + 1, F.ceil((F.col("n") - 1) * q) + 1) for q in qs])))
    open_ = large.select(*keys, F.explode(wanted).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), "n")
    found, turn = [], 0
    while True:
        open_ = folders.kept(open_)
        one = open_.where("low = high")
        found.append(one.select(*keys, "rank", F.col("low").alias("x")))
        rest = open_.where("low < high and n <= " + str(few))
        sorted_ = _matched(rows, rest.select(*keys, "low", "high", "below").distinct(), keys).groupBy(*keys, "low", "below").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        found.append(rest.alias("r").join(sorted_.alias("s"), _same(keys, "r", "s") & (F.col("r.low") == F.col("s.low"))).select(*[f"r.{k}" for k in keys], "r.rank", F.get("s.vs", (F.col("r.rank") - F.col("r.below") - 1).cast("int")).alias("x")))
        open_ = open_.where("low < high and n > " + str(few))
        if open_.isEmpty():
            break
        open_ = _ranked(rows, open_, keys, turn % 2 == 1)
        turn += 1
    exact = reduce(DataFrame.unionByName, found)
    each = large.select(*keys, "n", F.posexplode(F.array(*map(F.lit, qs))).alias("i", "p")).withColumn("at", (F.col("n") - 1) * F.col("p"))
    x = exact.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("x"))  # a few ranks
    low, high = F.col("m.x")[F.floor("e.at") + 1], F.col("m.x")[F.ceil("e.at") + 1]
    part = F.col("e.at") - F.floor("e.at")
    value_ = F.when(low == high, low).otherwise(low * (1 - part) + high * part)
    whole = each.alias("e").join(x.alias("m"), _same(keys, "e", "m")).select(*[f"e.{k}" for k in keys], "e.n", "e.i", value_.alias("x"))
    whole = whole.groupBy(*keys, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))
    return out.unionByName(whole)
