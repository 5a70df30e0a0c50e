import numpy as np
from kinemetry.operators import baseline


def brute(x):
    n, p = x.shape
    z = x - x.mean(0)
    s = z.T @ z / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / (p * n * n), delta)
    w = beta / delta
    return x.mean(0), w, (1 - w) * s + w * mu * np.eye(p)


def test_model_and_scores(spark):
    r = np.random.default_rng(0)
    x = {k: r.normal(size=(60, 5)) @ r.normal(size=(5, 5)) + k for k in (0, 1)}
    rows = [(k, v.tolist(), 9.0) for k in x for v in x[k]] + [(None, [0.0] * 5, 9.0), (0, None, 9.0), (0, [float("nan")] * 5, 9.0), (7, [1.0] * 5, 9.0)]
    df = spark.createDataFrame(rows, "regime int, x array<double>, score double")
    models = baseline.learn(df)
    got = {m.regime: m for m in models.collect()}
    assert set(got) == {0, 1, 7} and got[7].n == 1 and got[0].n == 60
    for k in x:
        mean, w, c = brute(x[k])
        assert np.allclose(got[k].mean, mean) and np.isclose(got[k].shrinkage, w) and np.allclose(got[k].covariance, c)
    scored = baseline.scores(df, models)
    assert scored.columns == df.columns
    mean, _, c = brute(x[1])
    want = sorted(np.sqrt(np.einsum("ij,jk,ik->i", x[1] - mean, np.linalg.inv(c), x[1] - mean)))
    assert np.allclose(sorted(s.score for s in scored.where("regime = 1").collect()), want)
    assert scored.where("regime is null or x is null").where("score is not null").count() == 0
    assert baseline.learn(df.limit(0)).count() == 0


def test_chi_square(spark):
    own = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution
    for nu in (1.0, 2.0, 7.5, 64.0, 5000.0):
        for q in (0.05, 0.5, 0.75, 0.995):
            assert np.isclose(baseline.chi2_quantile(q, nu), own(nu).inverseCumulativeProbability(q), rtol=1e-6)


def test_thresholds(spark):
    d2 = np.array([baseline.chi2_quantile((i + 0.5) / 800, 6.0) for i in range(800)]) * 2.0
    rows = [(0, float(np.sqrt(v))) for v in d2] + [(1, 3.0)] * 4 + [(2, float(np.sqrt(v))) for v in d2[:400]] + [(2, 40.0)] * 10 + [(0, None)]
    got = {t.regime: t for t in baseline.thresholds(spark.createDataFrame(rows, "regime int, score double")).collect()}
    assert got[0].n == 800 and abs(got[0].ratio - 1) < 0.02 and not got[0].contaminated
    assert got[1].threshold == got[1].empirical == got[1].analytic == 3.0
    assert got[2].contaminated and got[2].threshold == got[2].analytic < 40
