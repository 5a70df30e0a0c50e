"""Numpy helpers of one window's spectra: filters as frequency responses, envelopes, power spectra."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Filter order, low-pass edge and decimation of an envelope, its spectrum's range in Hz.
ORDER, LOW_PASS, DECIMATE, RHYTHM = 4, 600.0, 8, (5.0, 500.0)
TINY = 1e-12


def response(n: int, fs: float, low: float | None, high: float) -> np.ndarray:
    """Frequency response of a digital Butterworth filter at the n // 2 + 1 bins: band-pass, or low-pass without `low`.

    The analog prototype is evaluated on the bilinear transform's image of each bin, so no coefficients are needed."""
    f = np.arange(n // 2 + 1) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.tan(np.pi * np.minimum(f, 0.5 - 1e-15))
        top = math.tan(math.pi * high / fs)
        if low is None:
            v = w / top
        else:
            bottom = math.tan(math.pi * low / fs)
            v = (w * w - top * bottom) / ((top - bottom) * w)
    poles = np.exp(1j * np.pi * (2 * np.arange(ORDER) + ORDER + 1) / (2 * ORDER))
    out = np.zeros(len(f), complex)
    some = np.isfinite(v)
    out[some] = 1 / np.prod(1j * v[some, None] - poles, axis=1)
    return out


def _padded(n: int, fs: float, width: float) -> int:
    """A length at which the filters' tails, to 1e-14, end before they wrap around."""
    return -(-(n + math.ceil(40 * fs / width)) // 4096) * 4096


@lru_cache(maxsize=8)
def _low(n: int, fs: float) -> np.ndarray:
    return response(n, fs, None, LOW_PASS)


@lru_cache(maxsize=16)
def _band(n: int, fs: float, low: float, high: float) -> np.ndarray:
    return response(n, fs, max(low, 1.0), min(high, 0.49 * fs))


def _every(spectrum: np.ndarray, n: int) -> np.ndarray:
    """Every DECIMATE-th sample of the real signal of n samples that has this half spectrum: its parts that alias
    are added up, so the inverse transform is an eighth as long."""
    whole = np.concatenate((spectrum, spectrum[-2:0:-1].conj()))
    return np.fft.ifft(whole.reshape(DECIMATE, n // DECIMATE).sum(0) / DECIMATE).real


class Envelopes:
    """Envelope spectra of one signal in several bands; its own spectrum is taken once.

    The signal passes the band, is rectified, passes the low-pass and is thinned out; filters start at rest."""

    def __init__(self, x: np.ndarray, fs: float, narrowest: float):
        self.size, self.fs = len(x), fs
        self.n = _padded(len(x), fs, min(narrowest, LOW_PASS))
        self.spectrum = np.fft.rfft(x, self.n)

    def passed(self, low: float, high: float) -> np.ndarray:
        """The signal that passes the band."""
        return np.fft.irfft(self.spectrum * _band(self.n, self.fs, low, high), self.n)[: self.size]

    def envelope(self, low: float, high: float) -> np.ndarray:
        smooth = _every(np.fft.rfft(np.abs(self.passed(low, high)), self.n) * _low(self.n, self.fs), self.n)
        return smooth[: -(-self.size // DECIMATE)]

    def rhythm(self, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies in RHYTHM and the magnitudes there of the envelope without its mean, under a Hann window."""
        e = self.envelope(low, high)
        mag = np.abs(np.fft.rfft((e - e.mean()) * np.hanning(len(e))))
        f = np.fft.rfftfreq(len(e), DECIMATE / self.fs)
        some = (f >= RHYTHM[0]) & (f <= RHYTHM[1])
        return f[some], mag[some]


def crest(mag: np.ndarray) -> float:
    return float(mag.max() / (np.median(mag) + TINY)) if len(mag) else 0.0


def shares(f: np.ndarray, power: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the power in the bands that begin at `edges` (the last edge itself counts only in the whole), and the whole."""
    whole = float(power[(f >= edges[0]) & (f <= edges[-1])].sum()) + TINY
    at = np.searchsorted(edges, f, "right") - 1
    inside = (at >= 0) & (at < len(edges) - 1)
    return np.bincount(at[inside], power[inside], len(edges) - 1) / whole, whole


def ilr(parts: np.ndarray, floor: float = 1e-9) -> np.ndarray:
    """Isometric log-ratios in the Helmert basis: one coordinate fewer than parts."""
    p = np.maximum(parts, floor)
    logs = np.log(p / p.sum())
    i = np.arange(1, len(logs))
    return np.sqrt(i / (i + 1)) * (np.cumsum(logs)[:-1] / i - logs[1:])


def moments(x: np.ndarray) -> list[float]:
    """log10 rms, excess kurtosis, crest factor and skewness without the mean; -9, 0, 0, 0 of a dead channel."""
    z = x - x.mean()
    square = z * z
    var = square.mean()
    if math.sqrt(var) < 1e-9:
        return [-9.0, 0.0, 0.0, 0.0]
    return [0.5 * math.log10(var), (square * square).mean() / var**2 - 3, np.abs(z).max() / math.sqrt(var), (square * z).mean() / var**1.5]


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Power density averaged over half-overlapping segments, each without its mean and under a periodic Hann window."""
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    step = size - size // 2
    total = np.zeros(size // 2 + 1)
    starts = range(0, len(x) - size + 1, step)
    for a in starts:
        part = x[a : a + size]
        total += np.abs(np.fft.rfft((part - part.mean()) * taper)) ** 2
    total[1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / fs), total / (len(starts) * fs * (taper @ taper))


def shaft_rate(x: np.ndarray, fs: float, low: float = 10.0, high: float = 120.0, harmonics: int = 3) -> float:
    """The frequency whose first harmonics have the most log power (of equal ones the lowest); 0 where there is no
    signal, no bin in range, or nothing stands out."""
    if len(x) < 16 or x.std() < TINY:
        return 0.0
    f, p = welch(x - x.mean(), fs, int(min(len(x), 8 * fs)))
    bins = np.flatnonzero((f >= low) & (f <= high))
    if not len(bins):
        return 0.0
    logs = np.log(p + 1e-20)
    at = bins[:, None] * np.arange(1, harmonics + 1)
    score = np.where(at < len(f), logs[np.minimum(at, len(f) - 1)], 0.0).sum(1)
    return float(f[bins[score.argmax()]]) if np.ptp(score) >= 1e-9 else 0.0


def agreed_rate(audio: float, accel: float) -> tuple[float, bool]:
    """The accelerometer's rate if it has one, else the microphone's; reliable if both agree to a twentieth."""
    return (accel or audio), bool(audio > 0 and accel > 0 and abs(audio - accel) / accel < 0.05)
