"""How loud a machine is in physical terms, and over what it was when it was learned."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinemetry.functions import vibration as V
from kinemetry.operators.quantiles import quantiles

PARTS = ("band_rms", "band_db", "peak_hz", "peak_ratio", "peak_db", "energy_log10")
RESULT = f"struct<{','.join(f'{p}:double' for p in PARTS)}>"


def _db(v: float) -> float:
    return 20 * float(np.log10(max(v, V.TINY)))


def severity(x: np.ndarray, fs: float, low: float, high: float) -> tuple[float, ...]:
    """PARTS of one window: its level in the band, and the strongest line, its height over the median line, and the
    energy of the band's envelope spectrum. A window too short for a line of it has NaN there."""
    env = V.Envelopes(x, fs, high - low)
    level = float(np.sqrt(np.mean(env.passed(low, high) ** 2)))
    f, mag = env.rhythm(low, high)
    if not len(f):
        return level, _db(level), *[float("nan")] * 4
    top = int(mag.argmax())
    return level, _db(level), float(f[top]), float(mag[top] / (np.median(mag) + V.TINY)), _db(float(mag[top])), float(np.log10((mag * mag).sum() + V.TINY))


def physical(audio: Column, fs: Column, low: Column, high: Column) -> Column:
    """`severity` as a struct; null where a signal, rate or bound is null or not finite, the signal empty, or the band not
    within 1 Hz and the half of the rate."""

    @F.arrow_udf(RESULT)
    def of(xs: pa.Array, *rates: pa.Array) -> pa.Array:
        rows = []
        for x, r, a, b in zip(xs, *rates, strict=True):
            r, a, b = (v.as_py() for v in (r, a, b))
            x = np.zeros(0) if x.values is None else x.values.to_numpy(zero_copy_only=False).astype(float)
            good = len(x) and np.isfinite(x).all() and None not in (r, a, b) and np.isfinite((r, a, b)).all() and 1 <= a < b <= r / 2
            rows.append(dict(zip(PARTS, severity(x, r, a, b), strict=True)) if good else None)
        return pa.array(rows, pa.struct([(p, pa.float64()) for p in PARTS]))

    return of(audio.cast("array<double>"), *[c.cast("double") for c in (fs, low, high)])


def relative(windows: DataFrame, device: str, learn: Column, energy: str = "energy_log10") -> DataFrame:
    """`windows` with `db_re_learn`: the energy in decibels over the median of its device's `learn` windows; null where
    either is. NaN energies don't count."""
    middle = quantiles(windows.where(learn), [device], energy, [0.5]).select(F.col(device).alias("_own"), F.col("q")[0].alias("_mid"))
    both = windows.join(middle, F.col(device).eqNullSafe(F.col("_own")), "left")
    return both.withColumn("db_re_learn", 10 * (F.col(energy) - F.col("_mid"))).drop("_own", "_mid")
