import numpy as np
from pyspark.sql import functions as F
from test_baseline import brute

from kinemetry.operators import baseline, held_out


def windows(spark, n=50):
    r = np.random.default_rng(1)
    x = {k: r.normal(size=(m, 3)) * (k + 1) for k, m in ((0, n), (1, 10))}
    rows = [(k * 1000 + i, k, v.tolist(), 0.0) for k in x for i, v in enumerate(x[k])] + [(5, None, [0.0] * 3, 0.0), (6, 0, None, 0.0), (None, 0, [9.0] * 3, 0.0), (7000, 7, [1.0] * 3, 0.0)]
    return x, spark.createDataFrame(rows, "id long, regime int, x array<double>, score double")


def test_scores_are_of_models_without_the_fold(spark):
    x, df = windows(spark)
    out = held_out.held_out_scores(df, F.col("id"))
    assert out.columns == df.columns and out.count() == df.count()
    got = {r.id: r.score for r in out.where("regime is not null and x is not null").collect()}
    for i, v in enumerate(x[0]):
        mean, _, c = brute(x[0][np.arange(len(x[0])) % 5 != i % 5])
        assert np.isclose(got[i], np.sqrt((v - mean) @ np.linalg.inv(c) @ (v - mean)))
    assert got[7000] is None and got[None] is None
    assert out.where("(regime is null or x is null) and score is not null").count() == 0
    assert held_out.held_out_scores(df.limit(0), F.col("id")).count() == 0


def test_thresholds(spark):
    x, df = windows(spark)
    df = df.where("id is not null and x is not null and regime < 7")
    got = {t.regime: t for t in held_out.learned_thresholds(df, F.col("id")).collect()}
    fair = {t.regime: t for t in baseline.thresholds(held_out.held_out_scores(df, F.col("id"))).collect()}
    near = {t.regime: t for t in baseline.thresholds(baseline.scores(df, baseline.learn(df))).collect()}
    assert got[0].threshold == fair[0].threshold and fair[0].empirical > near[0].empirical
    assert got[1].n == 10 and np.isclose(got[1].threshold, 1.5 * near[1].threshold)
