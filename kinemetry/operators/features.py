"""Windows of sound and acceleration to feature vectors: one Arrow function over the rows of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinemetry.functions import vibration as V

#: Band edges of the envelope's rhythm in Hz, the band where none is periodic, bands searched and
#: their lowest edge, the crest from which a band counts as periodic, bands of a channel and their lowest edge.
RHYTHM = np.array([5.0, 15.0, 35.0, 75.0, 150.0, 300.0, 500.0])
QUIET_BAND = (3000.0, 6000.0)
SEARCHED, SEARCH_FROM, CREST_FLOOR = 6, 1000.0, 10.0
BANDS, BANDS_FROM = 8, 10.0

#: Blocks of the vector in order: the function that makes each, what it reads, and how many numbers it gives.
LAYOUT = (("channel_stats", "audio", 4), ("channel_stats", "accel_x", 4), ("channel_stats", "accel_y", 4), ("channel_stats", "accel_z", 4),
          ("band_ilr", "audio", BANDS - 1), ("band_ilr", "accel", BANDS - 1), ("envelope", "audio", len(RHYTHM)))
NAMES = [f"{made}.{read}.{i}" for made, read, n in LAYOUT for i in range(n)]
RESULT = "struct<vector:array<double>,band_low:double,band_high:double,band_crest:double,fr_hz:double,fr_reliable:boolean,dc:array<double>>"


def _edges(low: float, fs: float, n: int) -> np.ndarray:
    return np.geomspace(low, 0.475 * fs, n + 1)


def _channel_ilr(x: np.ndarray, fs: float) -> np.ndarray:
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    return V.ilr(V.shares(np.fft.rfftfreq(len(x), 1 / fs), power, _edges(BANDS_FROM, fs, BANDS))[0])


def searched(audio: np.ndarray, fs: float) -> tuple[V.Envelopes, list, list, list]:
    """The envelopes of a window, the bands searched, and the spectrum and crest of each."""
    edges = _edges(SEARCH_FROM, fs, SEARCHED)
    env = V.Envelopes(audio, fs, edges[1] - edges[0])
    bands = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    spectra = [env.rhythm(*b) for b in bands]
    return env, bands, spectra, [V.crest(mag) for _, mag in spectra]


def features(audio: np.ndarray, fs: float, accel: np.ndarray, fs_accel: float, floor: float = CREST_FLOOR) -> dict:
    """Features of one window; accel has three rows."""
    env, bands, spectra, crests = searched(audio, fs)
    top = int(np.argmax(crests))
    band, (f, mag) = (bands[top], spectra[top]) if crests[top] >= floor else (QUIET_BAND, env.rhythm(*QUIET_BAND))
    parts, whole = V.shares(f, mag * mag, RHYTHM)
    rate, reliable = V.agreed_rate(V.shaft_rate(audio, fs), V.shaft_rate(accel[0], fs_accel))
    vector = np.concatenate([V.moments(audio), *[V.moments(a) for a in accel], _channel_ilr(audio, fs), _channel_ilr(accel[0], fs_accel),
                             [np.log10(whole)], V.ilr(parts), [np.log10(V.crest(mag) + 1)]])
    return {"vector": vector.tolist(), "band_low": band[0], "band_high": band[1], "band_crest": crests[top], "fr_hz": rate, "fr_reliable": reliable,
            "dc": [float(audio.mean()), *accel.mean(axis=1).tolist()]}


def _samples(column: pa.Array, i: int) -> np.ndarray:
    values = column[i].values
    return np.zeros(0) if values is None else values.to_numpy(zero_copy_only=False).astype(float)


def _heard(x: np.ndarray, rate: float | None) -> bool:
    return len(x) >= 64 and rate is not None and np.isfinite(rate) and rate >= 2.2 * SEARCH_FROM and bool(np.isfinite(x).all())


def _rows(audio: pa.Array, fs: pa.Array, axes: list[pa.Array], fs_accel: pa.Array, floor: pa.Array) -> Iterator[dict | None]:
    for i in range(len(audio)):
        x, a = _samples(audio, i), [_samples(c, i) for c in axes]
        rate, least = fs_accel[i].as_py(), floor[i].as_py()
        size = len(a[0])
        a = [v if len(v) else np.zeros(size) for v in a]
        moved = size >= 64 and all(len(v) == size and np.isfinite(v).all() for v in a) and rate is not None and np.isfinite(rate) and rate > 0
        yield features(x, fs[i].as_py(), np.stack(a), rate, least) if least is not None and moved and _heard(x, fs[i].as_py()) else None


def band_crest(audio: Column, fs: Column) -> Column:
    """The greatest crest of the bands searched: what `with_features` calls band_crest, without the rest of its work;
    null where that is."""

    @F.arrow_udf("double")
    def of(x: pa.Array, r: pa.Array) -> pa.Array:
        heard = ((_samples(x, i), r[i].as_py()) for i in range(len(x)))
        return pa.array([max(searched(v, rate)[3]) if _heard(v, rate) else None for v, rate in heard], pa.float64())

    return of(audio.cast("array<double>"), fs.cast("double"))


def with_features(windows: DataFrame, audio: str = "audio", fs: str = "fs_audio", axes: tuple[str, str, str] = ("accel_x", "accel_y", "accel_z"), fs_accel: str = "fs_accel", floor: str | None = None) -> DataFrame:
    """`windows` with `vector` (37 numbers named NAMES), the band demodulated, its crest, the shaft rate with its
    reliability, and the mean of each channel. An input column of these names is replaced. `floor` names a column with the
    crest from which a band counts as periodic, CREST_FLOOR without one.

    A second or third axis that is null or empty counts as zeros. All are null where sound or first axis have fewer
    than 64 samples, axes differ in length, a sample, rate or floor is null or not finite, or sound is too slow for the bands.
    Each row is one window of bounded size; nothing is shuffled."""

    @F.arrow_udf(RESULT)
    def of(x: pa.Array, r: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, s: pa.Array, least: pa.Array) -> pa.Array:
        fields = [("vector", pa.list_(pa.float64())), *[(n, pa.float64()) for n in ("band_low", "band_high", "band_crest", "fr_hz")], ("fr_reliable", pa.bool_()), ("dc", pa.list_(pa.float64()))]
        return pa.array(list(_rows(x, r, [a, b, c], s, least)), pa.struct(fields))

    doubles = [F.col(f"`{c}`").cast("array<double>") for c in (audio, *axes)]
    rates = [F.col(f"`{c}`").cast("double") for c in (fs, fs_accel)]
    least = F.lit(CREST_FLOOR) if floor is None else F.col(f"`{floor}`").cast("double")
    made = windows.withColumn("_f", of(doubles[0], rates[0], *doubles[1:], rates[1], least))
    names = ["vector", "band_low", "band_high", "band_crest", "fr_hz", "fr_reliable", "dc"]
    return made.select(*[F.col(f"`{c}`") for c in windows.columns if c not in names], *[F.col(f"_f.{n}").alias(n) for n in names])
