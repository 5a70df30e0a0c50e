"""Findings about signals: severity and kind of everything that is wrong with one, as an array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from harmless to worst, and the demodulation band in hertz.
SEVERITIES = ("none", "info", "warn", "blind")
BAND = (3000.0, 6000.0)


def findings(*cases: tuple[Column, str, str]) -> Column:
    """Those of the cases (condition, severity, kind) that hold."""
    each = [F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"))) for c, s, k in cases]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def worst(found: Column) -> Column:
    """The worst severity, `none` without findings."""
    rank = F.coalesce(F.array_max(F.transform(found, lambda x: F.array_position(F.array(*map(F.lit, SEVERITIES)), x["severity"]))), F.lit(1))
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank.cast("int"))


def audio(peak: Column, rms: Column, dc: Column, clipped: Column, finite: Column, fs_in: Column, fs_out: float, full_scale_known: bool) -> Column:
    """What an audio channel lacks: bandwidth, headroom, level, samples."""
    nyquist = fs_in / 2
    return findings(
        (F.lit(not full_scale_known) & (peak > 1), "info", "units"), (nyquist <= BAND[0], "blind", "no_band"), ((nyquist > BAND[0]) & (nyquist < BAND[1]), "warn", "part_band"),
        (fs_in < fs_out, "info", "upsampled"), (clipped > 0.001, "warn", "clipped"), ((clipped > 0) & (clipped <= 0.001), "info", "few_clipped"),
        ((peak > 0) & (peak < 0.02), "warn", "quiet"), (rms == 0, "blind", "silent"), (F.abs(dc) > 0.01 * F.greatest(peak, F.lit(1e-9)), "info", "dc"), (~finite, "blind", "not_finite"))


def acceleration(means: Column, deviations: Column, jitter: Column) -> Column:
    """What an accelerometer's axes lack: gravity, an even clock, life."""
    gravity = F.sqrt(F.aggregate(means, F.lit(0.0), lambda a, v: a + v * v))
    three = F.size(means) == 3
    dead = F.size(F.filter(deviations, lambda v: v == 0)) > 0
    return findings((three & ~gravity.between(0.7, 1.4), "warn", "gravity"), (three & gravity.between(0.7, 1.4), "info", "gravity_ok"), (F.coalesce(jitter > 0.25, F.lit(False)), "warn", "jitter"), (dead, "warn", "dead_axis"))


def gain(peak: Column, normalise: bool) -> Column:
    """1 unless the peak would clip, or is to be brought to nine tenths of full scale."""
    return F.when(F.lit(normalise) | (peak > 0.999), 0.9 / (peak + 1e-12)).otherwise(1.0)
