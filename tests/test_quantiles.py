import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinemetry.operators.quantiles import quantiles

QS = [0.0, 0.25, 0.5, 0.995, 1.0]


@pytest.mark.parametrize("few", [1, 7, 50_000])
def test_quantiles_are_numpys(spark, few):
    r = np.random.default_rng(2)
    groups = {"normal": r.normal(size=400), "one value": np.full(300, 2.5), "two": np.array([1.0, 2.0] * 60), "tail": np.exp(r.normal(size=200) * 90), "near": 1e9 + r.integers(0, 3, 90) * 1e-7,
              "wide": np.array([-1.7e308, 1.7e308, 0.0, -0.0, 5e-324] * 9), "single": np.array([3.0]), None: r.integers(0, 5, 120).astype(float)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("empty", None), ("empty", math.nan), ("normal", None), ("normal", math.nan)]
    got = {x.k: x for x in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", QS, few).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k].n == len(x)
        s = np.sort(x)
        for q, v in zip(QS, got[k].q, strict=True):
            at = (len(x) - 1) * q
            low, high = s[math.floor(at)], s[math.ceil(at)]
            assert low <= v <= high and math.isclose(v, low if low == high else low * (1 - at % 1) + high * (at % 1), rel_tol=1e-12), (k, q)


def test_infinities_and_no_keys_and_no_rows(spark):
    x = [-math.inf] * 20 + [math.inf] * 30 + [float(i) for i in range(50)]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    got = quantiles(df, [], "v", [0.0, 1 / 11, 30 / 99, 1.0], 5).collect()
    s = sorted(x)
    assert len(got) == 1 and got[0].q == [s[0], s[9], s[30], s[-1]] and got[0].n == 100
    assert quantiles(df.limit(0), [], "v", QS).count() == quantiles(df.limit(0).withColumn("k", F.lit(1)), ["k"], "v", QS, 1).count() == 0
