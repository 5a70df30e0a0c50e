"""Array and scalar functions of the feature vector, as columns: Catalyst sees all of them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_FLOOR = 1e-9


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x evaluated once: inside a function over elements it would be anew for each."""
    return F.transform(F.array(x), use)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def closed(parts: Column, floor: float = ZERO_FLOOR) -> Column:
    """A composition: parts of at least `floor` that sum to one."""
    raised = F.transform(parts, lambda v: F.greatest(v, F.lit(floor)))
    return bound(raised, lambda r: bound(total(r), lambda s: F.transform(r, lambda v: v / s)))


def _logs(parts: Column) -> Column:
    return F.transform(closed(parts), lambda v: F.log(v))


def clr(parts: Column) -> Column:
    """Centred log-ratios."""
    return bound(_logs(parts), lambda x: bound(mean(x), lambda m: F.transform(x, lambda v: v - m)))


def ilr(parts: Column, n: int) -> Column:
    """Isometric log-ratios of n parts in the Helmert basis: n - 1 coordinates."""
    return bound(_logs(parts), lambda x: F.array(*[math.sqrt(i / (i + 1)) * (total(F.slice(x, 1, i)) / i - x[i]) for i in range(1, n)]))


def ilr_inverse(y: Column, n: int) -> Column:
    """The composition that has these coordinates."""
    def log_part(k: int) -> Column:
        own = F.lit(0.0) if k == 0 else -y[k - 1] * math.sqrt(k / (k + 1))
        for i in range(k + 1, n):
            own = own + y[i - 1] / math.sqrt(i * (i + 1))
        return own

    e = F.array(*[F.exp(log_part(k)) for k in range(n)])
    return bound(e, lambda x: bound(total(x), lambda s: F.transform(x, lambda v: v / s)))


def centred(x: Column) -> Column:
    return bound(F.transform(x, lambda v: v.cast("double")), lambda d: bound(mean(d), lambda m: F.transform(d, lambda v: v - m)))


def transformed(x: Column, n: int, taper: list[float]) -> Column:
    """|DFT| of n samples times a taper, bins 0 to n/2."""
    def part(t: Column, k: Column, wave) -> Column:
        return F.aggregate(F.transform(t, lambda v, i: v * wave(2 * math.pi / n * k * i)), F.lit(0.0), lambda a, v: a + v)

    return bound(F.zip_with(x, F.array(*map(F.lit, taper)), lambda v, w: v * w), lambda t: F.transform(
        F.sequence(F.lit(0), F.lit(n // 2)), lambda k: F.sqrt(F.pow(part(t, k, F.cos), 2) + F.pow(part(t, k, F.sin), 2))))


def magnitudes(x: Column, n: int, window: bool = False) -> Column:
    """|DFT| of n samples without their mean, bins 0 to n/2, optionally under a Hann window."""
    return transformed(centred(x), n, [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) if window else 1.0 for i in range(n)])


def short_spectra(x: Column, length: int, frame: int, hop: int) -> Column:
    """|STFT|: an array per frame of bins 0 to frame/2, under a periodic Hann window, over its sum."""
    taper = [0.5 - 0.5 * math.cos(2 * math.pi * i / frame) for i in range(frame)]
    return F.transform(F.array(*map(F.lit, range(1, length - frame + 2, hop))), lambda s: transformed(
        F.transform(F.slice(x, s, frame), lambda v: v.cast("double")), frame, [w / sum(taper) for w in taper]))


def hertz(m: Column) -> Column:
    """Frequency of a Mel value."""
    return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1)


def clipped(x: Column, full_scale_known: bool) -> Column:
    """Share of samples at full scale (0.999 of +-1), or, of an unknown scale, at the very peak."""
    def share(a: Column, top: Column) -> Column:
        return F.size(F.filter(a, lambda v: v >= top)) / F.size(a)

    level = F.transform(x, lambda v: F.abs(v))
    if full_scale_known:
        return share(level, F.lit(0.999))
    return bound(level, lambda a: bound(F.array_max(a), lambda p: F.when(p > 0, share(a, p * (1 - 1e-9))).otherwise(0.0)))


def ratio_alias(f0: Column, p: Column, tol: float = 0.02) -> Column:
    """Whether f0 lies beside p or is a multiple or a part of it."""
    def whole(r: Column) -> Column:
        return F.abs(r - F.bround(r, 0)) <= tol

    return (f0 > 0) & (p > 0) & ((F.abs(f0 - p) <= 2.0) | whole(f0 / p) | whole(p / f0))


def mel(f: Column) -> Column:
    return 2595.0 * F.log10(1 + f / 700.0)


def display_index(score: Column, threshold: Column) -> Column:
    """70 at the threshold, 0 a decade below, 100 three decades above; 100 without a threshold."""
    decades = F.log10(score / threshold)
    return (F.when(threshold.isNull() | F.isnan(threshold) | (threshold <= 0) | (threshold == float("inf")), 100.0).when(score <= 0, 0.0)
            .when(decades <= 0, 70.0 * F.greatest(1 + decades, F.lit(0.0))).otherwise(70.0 + 30.0 * F.least(decades / 3.0, F.lit(1.0))))


def tier(in_episode: Column, anomalous: Column) -> Column:
    return F.when(in_episode, "red").when(anomalous, "amber").otherwise("green")


def mains_related(f0: Column, mains: float = 50.0, tol: float = 1.5) -> Column:
    """Whether f0 is a multiple of the mains frequency or a part of it, up to eight times."""
    return F.coalesce((f0 > 0) & F.exists(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.abs(f0 - k * mains) <= tol) | ((k >= 2) & (F.abs(k * f0 - mains) <= tol))), F.lit(False))


#: Bearing designation, rolling elements, ball and pitch diameter in millimetres.
BEARINGS = [
    ("6205-2RS-JEM", 9, 7.94004, 39.0398),
    ("6203-2RS-JEM", 8, 6.74624, 28.4988),
    ("6202", 8, 5.953, 25.0),
    ("6203", 8, 6.746, 28.5),
    ("6204", 8, 7.94, 33.5),
    ("6205", 9, 7.94, 38.5),
    ("6206", 9, 9.525, 46.0),
    ("6208", 9, 11.906, 60.0),
]


def fault_frequencies(n: Column, ball: Column, pitch: Column, fr: Column, angle: float = 0.0) -> dict[str, Column]:
    """Cage, outer-race, inner-race and ball frequencies of a bearing at shaft rate fr."""
    g = ball / pitch * math.cos(math.radians(angle))
    spin = pitch / (2 * ball) * fr * (1 - g * g)
    return {"ftf": fr / 2 * (1 - g), "bpfo": n * fr / 2 * (1 - g), "bpfi": n * fr / 2 * (1 + g), "bsf": spin, "bsf_2x": 2 * spin}
