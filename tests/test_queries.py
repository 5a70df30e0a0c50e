import numpy as np
import pytest
from pyspark.sql import functions as F
from compare import same
from test_baseline import brute

from kinemetry.operators import baseline, features
from kinemetry.plans import catalog, evaluation, learning, soak
from kinemetry.sources.readings import table

#: Queries with filters, matrices of 64 components, a chi-square quantile or Spark's hash, which SQL lacks; tested below by computing their rows another way.
WITHOUT_SQL = {"features37", "learned_thresholds", "ledoit_wolf", "mahalanobis", "held_out_distance", "bootstrap_ci", "rate_bounds", "chosen_regimes", "effective_ranks", "saved_model", "learn_and_score", "screen_peaks", "physical_severity"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, data, name):
    same(catalog.queries()[name](spark, data), catalog.oracle_sql()[name], data)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) | WITHOUT_SQL


def test_features37(spark, data):
    e = {r.vec_id: np.array(r.embedding, float) for r in table(spark, data, "embeddings").collect()}
    got = {(r.window, r.i): r.value for r in catalog.queries()["features37"](spark, data).collect()}
    whole = [w for w in range(max(e) // learning.VECTORS + 1) if all(w * learning.VECTORS + i in e for i in range(learning.VECTORS))]
    assert whole and set(got) == {(w, i) for w in whole for i in range(37)}
    for w in whole:
        x = np.concatenate([e[w * learning.VECTORS + i] for i in range(learning.VECTORS)])
        want = features.features(x, 16000.0, np.stack([x, 0 * x, 0 * x]), 6400.0)["vector"]
        assert np.allclose([got[w, i] for i in range(37)], want, atol=2e-5)


def test_learn_queries_read_the_whole_vector(spark, data):
    e = [(r.vec_id, r.label, np.array(r.embedding, float)) for r in table(spark, data, "embeddings").collect()]
    got = {name: catalog.queries()[name](spark, data).collect() for name in ("ledoit_wolf", "mahalanobis", "held_out_distance", "learned_thresholds")}
    models = {r.label: r for r in got["ledoit_wolf"]}
    near, fair = ({r.vec_id: r.score for r in got[name]} for name in ("mahalanobis", "held_out_distance"))
    limits = {r.label: r for r in got["learned_thresholds"]}
    assert set(models) == set(limits) == {k for _, k, _ in e} and set(near) == set(fair) == {i for i, _, _ in e}

    def distance(x, model):
        return np.sqrt((x - model[0]) @ np.linalg.pinv(model[2], hermitian=True) @ (x - model[0]))

    for label in models:
        own = [(i, x) for i, k, x in e if k == label]
        whole = brute(np.array([x for _, x in own]))
        assert models[label].n == len(own) and abs(models[label].shrinkage - whole[1]) < 2e-6
        assert np.allclose(models[label].covariance, whole[2], atol=2e-6) and np.shape(models[label].covariance) == (64, 64)
        folds = {f: brute(np.array([x for i, x in own if i % 5 != f])) for f in range(5)}
        assert np.allclose([near[i] for i, _ in own], [distance(x, whole) for _, x in own], atol=1e-4)
        assert np.allclose([fair[i] for i, _ in own], held := [distance(x, folds[i % 5]) for i, x in own], atol=1e-4)
        if len(own) >= 15:
            assert abs(limits[label].empirical - np.quantile(held, 0.995)) < 1e-3


def test_bootstrap_replicates_differ(spark, data):
    rows = [(r.event_type, r.event_id, r.value) for r in table(spark, data, "events").collect()]
    df = spark.createDataFrame(rows, "regime string, event_id long, score double")
    means = {}
    for r in evaluation._replicates(df).collect():
        means.setdefault(r.regime, {})[r.b] = r.m
    got = {r.regime: r for r in catalog.queries()["bootstrap_ci"](spark, data).collect()}
    assert set(got) == set(means) == {k for k, _, _ in rows}
    for regime, m in means.items():
        own = np.array([v for k, _, v in rows if k == regime])
        assert len(set(m.values())) == len(m) == 200
        assert 0.75 < np.std(list(m.values())) / (own.std() / len(own) ** 0.5) < 1.25
        assert np.allclose((got[regime].low, got[regime].high), np.quantile(list(m.values()), (0.025, 0.975)), atol=2e-6)
    w = np.array([r.w for r in spark.range(40_000).selectExpr("id", "id % 200 as b").select(evaluation._weight("id", "b").alias("w")).collect()])
    assert abs((w == 0).mean() - np.exp(-1)) < 0.02 and abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06


def test_pivots_have_every_regime(spark, data, tmp_path):
    events = table(spark, data, "events").withColumn("event_type", F.expr("if(event_id % 10 = 3, 'new.type', event_type)"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    rows = [(int(r.s // 86400), r.event_type, r.value) for r in events.selectExpr("unix_micros(cast(ts as timestamp)) / 1e6 as s", "event_type", "value").collect()]
    worst, shares = ({r.day: r.asDict() for r in catalog.queries()[n](spark, str(tmp_path)).collect()} for n in ("severity_by_regime_pivot", "occupancy_daily"))
    regimes = {k for _, k, _ in rows}
    assert len(regimes) == 6 and set(worst) == set(shares) == {d for d, _, _ in rows}
    for day in worst:
        assert set(worst[day]) == set(shares[day]) == regimes | {"day"}
        for k in regimes:
            own = [v for d, x, v in rows if (d, x) == (day, k)]
            assert worst[day][k] == (round(max(own), 6) if own else None)
            assert abs(shares[day][k] - len(own) / sum(d == day for d, _, _ in rows)) < 1e-6


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rate_bounds(spark, data):
    chi2 = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution
    got = catalog.queries()["rate_bounds"](spark, data).collect()
    alerts = {r.device_id: r.n for r in catalog.queries()["alert_episodes"](spark, data).groupBy("device_id").agg(F.count("*").alias("n")).collect()}
    assert got and any(r.alerts for r in got)
    for r in got:
        want = chi2(2.0 * (r.alerts + 1)).inverseCumulativeProbability(0.95) / 2 / r.weeks
        assert r.alerts == alerts.get(r.device_id, 0) and abs(r.upper - want) < 1e-4 * want and r.passes_upper == (r.upper <= 1)


def test_evolve_refuses_what_may_not_be_null(spark):
    from pyspark.sql import types as T

    df = spark.range(2)
    assert soak.evolve(df, T.StructType().add("id", "long").add("x", T.ArrayType(T.DoubleType()))).schema["x"].dataType == T.ArrayType(T.DoubleType())
    with pytest.raises(ValueError, match="may not be null"):
        soak.evolve(df, T.StructType().add("y", "long", False))


def test_gate_of_one_long_device(spark):
    """A frame that is read anew for each row takes minutes here."""
    import random
    import time

    from kinemetry.operators import gate

    r = random.Random(1)
    flags = [r.random() < 0.4 for _ in range(40_000)]
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate(flags)], "device_id long, idx long, flag boolean")
    begun = time.time()
    got = sorted((x.start_idx, x.alert_idx, x.clear_idx) for x in gate.episodes(gate.marked(df, ["device_id"], ["idx"], "flag", F.lit(2), F.lit(3)), ["device_id"], ["idx"], "idx", F.lit(2)).collect())
    assert time.time() - begun < 60
    want, streak, normal, inside = [], 0, 0, False
    for i, f in enumerate(flags):
        streak, normal = (streak + 1, 0) if f else (0, normal + 1)
        if streak == 2 and not inside:
            inside = True
            want.append([i - 1, i, None])
        if normal == 3 and inside:
            inside = False
            want[-1][2] = i
    assert [list(x) for x in got] == want


def test_regimes_of_planted_clusters():
    from kinemetry.operators import regimes

    r = np.random.default_rng(3)
    noise = r.normal(size=(150, 3))
    assert regimes.split(noise)[0].max() == 0
    for k in (2, 3, 4):
        truth = np.arange(160) % k
        x = r.normal(size=(160, 3)) * 0.3 + np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0], [0, 0, 6]])[truth]
        label, s = regimes.split(x)
        assert label.max() + 1 == k and (label == truth).all() and s > 0.8
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        want = []
        for i in range(160):
            own = d[i][(truth == truth[i]) & (np.arange(160) != i)].mean()
            other = min(d[i][truth == c].mean() for c in range(k) if c != truth[i])
            want.append((other - own) / max(own, other))
        assert abs(s - np.mean(want)) < 1e-9
    outlier = np.vstack((r.normal(size=(60, 3)) * 0.1, [[50, 0, 0]]))
    assert regimes.split(outlier)[0].max() == 0  # one window is no regime
    assert regimes.directions(np.outer(np.arange(9), [1, 2, 0])) == 1 and regimes.directions(np.ones((4, 3))) == 0


def test_learned_regimes_ranks_and_models(spark, data):
    e = [(r.label, np.array(r.embedding, float)) for r in table(spark, data, "embeddings").collect()]
    q = catalog.queries()
    for r in q["effective_ranks"](spark, data).collect():
        x = np.array([v for k, v in e if k == r.label])
        s = np.linalg.svd(x - x.mean(0), compute_uv=False)
        p = s[s > 1e-9] / s[s > 1e-9].sum()
        assert abs(r.effective_rank - np.exp(-(p * np.log(p)).sum())) < 0.02 * r.effective_rank
    worst = {r.label: (r.n, r.worst) for r in q["mahalanobis"](spark, data).groupBy("label").agg(F.count("*").alias("n"), F.max("score").alias("worst")).collect()}
    assert {r.label: (r.windows, r.worst) for r in q["saved_model"](spark, data).collect()} == worst
    got = q["chosen_regimes"](spark, data).collect()
    assert len(got) == len(e) and {r.label for r in got} == {k for k, _ in e} and all(0 <= r.regime < r.regimes <= 4 for r in got)


def test_windows_past_the_learn_set_have_a_regime(spark):
    from kinemetry.operators import regimes

    r = np.random.default_rng(8)
    rows = [(d, i, (r.normal(size=2) * 0.2 + [(i + d) % 3 * 5, 0]).tolist()) for d in (1, 2) for i in range(700)]
    rows += [(None, 3, [0.0, 0.0]), (4, 1, None), (4, 2, [1.0, float("nan")]), (1, 900, [float("inf"), 0.0])]
    got = regimes.choose(spark.createDataFrame(rows, "device long, i long, p array<double>").repartition(5), "device", "i", F.col("p")).collect()
    assert len(got) == len(rows)
    for d in (1, 2):
        names = {}
        for g in got:
            if g.device == d and g.id < 900:
                assert names.setdefault((g.id + d) % 3, g.regime) == g.regime and g.regimes == 3 and g.silhouette > 0.75
        assert sorted(names.values()) == [0, 1, 2]
    odd = {(g.device, g.id): g.regime for g in got if g.device is None or g.device == 4 or g.id == 900}
    assert odd == {(None, 3): 0, (4, 1): None, (4, 2): None, (1, 900): None}
    table = regimes.candidates(np.array([p for d, _, p in rows[:200]]))
    assert table["k"].tolist() == [2, 3, 4] and table["silhouette"].idxmax() == 1 and regimes.candidates(np.zeros((1, 2))).empty
