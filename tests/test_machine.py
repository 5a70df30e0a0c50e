import numpy as np
import pytest
from pyspark.sql import functions as F
from test_baseline import brute

from kinemetry.operators import baseline, features, held_out, machine, regimes
from kinemetry.plans import learning
from kinemetry.sources.readings import table


def vectors(x, floor):
    out = features.features(x, 16000.0, np.stack([x, 0 * x, 0 * x]), 6400.0, floor)
    return np.array(out["vector"]), np.array([out["fr_hz"], out["vector"][0], out["vector"][4]]), out["band_crest"]


def learned(windows):
    """One machine's model, all at once, from (number, samples)."""
    crests = [vectors(x, 10.0)[2] for _, x in windows]
    floor = float(np.clip(max(crests) + 0.7, 6.5, 10.0)) if len(crests) >= 8 else 10.0
    v, op, _ = map(np.array, zip(*[vectors(x, floor) for _, x in windows], strict=True))
    mean, std, op_mean = v.mean(0), v.std(0) + 1e-9, op.mean(0)
    op_scale = np.array([0.05 * max(op_mean[0], 1), 0.1, 0.1])
    z, p = (v - mean) / std, (op - op_mean) / op_scale
    label, _ = regimes.split(p)
    centres = regimes.centres_of(p, label)
    label = ((p[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    own, ratios = [], []
    far = lambda x, m: float(np.sqrt((x - m[0]) @ np.linalg.pinv(m[2], hermitian=True) @ (x - m[0])))
    for r in range(len(centres)):
        mine = [(n, x) for (n, _), x, k in zip(windows, z, label, strict=True) if k == r]
        whole = brute(np.array([x for _, x in mine]))
        if len(mine) >= 15:
            d = [far(x, brute(np.array([y for m, y in mine if m % 5 != n % 5]))) for n, x in mine]
        else:
            d = [far(x, whole) for _, x in mine]
        body = np.quantile(np.square(d), (0.5, 0.75))
        top = np.quantile(d, 0.995)
        limit = min(top, baseline.analytic(len(d), *body) or top) * (1 if len(mine) >= 15 else 1.5)
        own.append((whole, limit))
        ratios += [x / limit for x in d]

    def score(x):
        v, op, _ = vectors(x, floor)
        r = int((((op - op_mean) / op_scale - centres) ** 2).sum(1).argmin())
        return r, far((v - mean) / std, own[r][0]), own[r][1], op[0]

    return floor, ratios, score


def test_learning_end_to_end_is_numpys(spark, data):
    e = {r.vec_id: np.array(r.embedding, float) for r in table(spark, data, "embeddings").collect()}
    n = learning.SHORT
    windows = [(w, np.concatenate([e[w * n + i] for i in range(n)])) for w in range(len(e) // n) if all(w * n + i in e for i in range(n))]
    got = {(r.device, r.window): r for r in learning.learn_and_score(spark, data).collect()}
    want = {}
    for device in range(learning.MACHINES):
        mine = [(w, x) for w, x in windows if w % learning.MACHINES == device]
        _, _, score = learned([(w, x) for w, x in mine if w // learning.MACHINES < learning.LEARN])
        want |= {(device, w): score(x) for w, x in mine if w // learning.MACHINES >= learning.LEARN}
    assert want and set(got) == set(want)
    for key, (regime, far, limit, fr) in want.items():
        r = got[key]
        assert r.regime == regime and abs(r.score - far) < 1e-3 * max(1, far) and abs(r.threshold - limit) < 1e-3 * limit and r.anomalous == (far > limit) and abs(r.fr_hz - fr) < 1e-5


@pytest.fixture(scope="module")
def sounds(spark):
    """Two machines: one that runs at two levels, one with few windows; some windows that can't be used."""
    r = np.random.default_rng(4)
    rows = []
    for w in range(40):
        x = r.normal(size=600) * (0.1 if w % 2 else 1.0)
        rows.append(("fan", w, x.tolist(), (x * 0.5).tolist()))
    rows += [("pump", w, (x := r.normal(size=600)).tolist(), x.tolist()) for w in range(10)]
    rows += [("fan", 90, None, [0.0] * 600), ("fan", 91, [float("nan")] * 600, [0.0] * 600), ("none", 92, [], [])]
    df = spark.createDataFrame(rows, "device string, window long, audio array<double>, accel_x array<double>")
    none = F.lit(None).cast("array<double>")
    return rows, df.select("*", F.lit(16000.0).alias("fs_audio"), none.alias("accel_y"), none.alias("accel_z"), F.lit(6400.0).alias("fs_accel"))


def test_models_keep_regimes_floors_and_startup_ratios(spark, sounds):
    rows, df = sounds
    model = {(r.device, r.regime): r for r in machine.fit(df).collect()}
    fan = [m for (d, _), m in model.items() if d == "fan"]
    assert len(fan) >= 2 and sum(m.n for m in fan) == 40 and model["pump", 0].n == 10 and len(model) == len(fan) + 1
    for i, (device, least) in enumerate((("fan", 40), ("pump", 10))):
        own = [(w, np.array(x)) for d, w, x, _ in rows if d == device and w < 90]
        # the first axis is half of the sound: both are scaled, so only its level differs
        crests = [features.searched(x, 16000.0)[3] for _, x in own]
        assert len(own) == least and abs(model[device, 0].crest_floor - np.clip(max(map(max, crests)) + 0.7, 6.5, 10)) < 1e-9
    assert model["fan", 0].startup_median <= model["fan", 0].startup_p95 and model["fan", 0].startup_p95 == model["fan", 1].startup_p95
    floor, ratios, _ = learned([(w, np.array(x)) for d, w, x, _ in rows if d == "pump"])
    assert np.allclose((model["pump", 0].startup_median, model["pump", 0].startup_p95), np.quantile(ratios, (0.5, 0.95)), rtol=1e-3)


def test_versions_and_refusals(spark, sounds, tmp_path):
    _, df = sounds
    at = str(tmp_path / "models")
    with pytest.raises(ValueError, match="no model"):
        machine.load(spark, at)
    model = machine.fit(df)
    assert machine.save(model, at) == 1 and machine.save(model.where("device = 'fan'"), at) == 2
    assert machine.load(spark, at).where("device = 'pump'").isEmpty() and not machine.load(spark, at, 1).where("device = 'pump'").isEmpty()
    (tmp_path / "models" / "version=3").mkdir()  # begun and never finished
    assert machine.load(spark, at).select("device").distinct().count() == 1
    bad = {"names": F.transform("names", lambda n: F.concat(n, F.lit("!"))), "std": F.transform("std", lambda s: s * 0), "threshold": F.lit(float("nan")), "mean": F.slice("mean", 1, 36), "centre": F.lit(None).cast("array<double>")}
    for column, (says, value) in zip(bad, (("names", bad["names"]), ("deviations", bad["std"]), ("not finite", bad["threshold"]), ("sizes", bad["mean"]), ("sizes", bad["centre"])), strict=True):
        broken = model.withColumn(column, value)
        with pytest.raises(ValueError, match=says):
            machine.save(broken, at)
    broken.write.parquet(f"{at}/version=7")  # by another program
    with pytest.raises(ValueError, match="refused"):
        machine.load(spark, at)
    with pytest.raises(ValueError, match="no rows"):
        machine.checked(model.limit(0))


def test_scores_of_unusable_windows_and_unknown_machines(spark, sounds):
    _, df = sounds
    found = {(r.device, r.window): r for r in machine.score(df, machine.fit(df.where("device <> 'pump'"))).collect()}
    assert {d for d, _ in found} == {"fan"} and len(found) == 42
    assert found["fan", 90].score is None and found["fan", 91].anomalous is False and found["fan", 3].score > 0
    assert len({found["fan", w].regime for w in range(40)}) >= 2
    assert held_out.ENOUGH == 15
