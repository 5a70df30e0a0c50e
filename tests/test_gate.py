import random

import pytest
from pyspark.sql import functions as F

from kinemetry.operators import gate


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40, 1000])
def test_chunks_change_nothing(spark, size):
    r, rows = random.Random(size), []
    for d in (1, 2, 3, None):
        share, t = {1: 0.5, 2: 0.97, 3: 0.03, None: 0.6}[d], 0
        for i in range(150):
            t += r.choice([1, 1, 1, 1, 2, 30])
            rows.append((d, t, i, None if d is None and i % 29 == 0 else r.random() < share if i % 50 > 5 else i % 100 > 50))
    df = spark.createDataFrame(rows, "device long, t long, id long, flag boolean")
    for need, clear in ((1, 1), (2, 2), (5, 3), (20, 2)):
        args = (["device"], ["t", "id"], "flag", F.lit(need), F.lit(clear))
        whole = gate.marked(df, *args).withColumn("idx", F.row_number().over(gate.Window.partitionBy("device").orderBy("t", "id")))
        parts = gate.marked(df, *args, chunk=F.floor(F.col("t") / size))
        columns = ["device", "t", "id", "streak", "run", "marker", "alert", "in_episode", "idx"]
        assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, parts.select(columns).collect()))
        a, b = (gate.episodes(g, ["device"], ["t", "id"], "idx", F.lit(need)).collect() for g in (whole, parts))
        assert a and sorted(map(str, a)) == sorted(map(str, b))


def test_a_device_of_300_000_rows_is_spread_over_tasks(spark):
    n, chunk = 300_000, 20_000
    df = spark.range(n).select(F.pmod("id", F.lit(1)).alias("device"), F.col("id").alias("t"), (F.xxhash64("id") % 5 < 2).alias("flag"))
    gated = gate.marked(df, ["device"], ["t"], "flag", F.lit(3), F.lit(2), chunk=F.floor(F.col("t") / chunk))
    sizes = [r["count"] for r in gated.groupBy("_chunk").count().collect()]
    assert len(sizes) == n // chunk and max(sizes) == chunk
    # no window over the rows has the device alone for its key
    windows = [line for line in gated._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line and "device" in line]
    assert windows and all("_chunk" in line for line in windows)
    got = gate.episodes(gated, ["device"], ["t"], "idx", F.lit(3)).collect()
    flags = [r.flag for r in df.orderBy("t").collect()]
    want, streak, quiet, held = [], 0, 0, False
    for i, f in enumerate(flags):
        streak, quiet = (streak + 1, 0) if f else (0, quiet + 1)
        if streak >= 3 and not held:
            held = True
            want.append([i - 1, i + 1, None])
        if held and quiet >= 2:
            held, want[-1][2] = False, i + 1
    assert sorted((r.start_idx, r.alert_idx, r.clear_idx) for r in got) == [tuple(w) for w in want]
