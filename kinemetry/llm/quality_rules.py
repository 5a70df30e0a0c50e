"""Quality rules by compression bands.

zstandard ratios (compressed over plain bytes) of the whole text and of fixed chunks tell
repetitive text (low) and noise (high). What is usual depends on how much text is compressed, so
the limits are fitted per length, on the ratios of all texts that pass the plain word rules: their
median less and plus so many deviations, where quartiles give the deviation of either side. The
fit is a table of counts per length and ratio, of a size that does not grow with the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinemetry.llm.common import chosen, text_bytes

LEVEL, CHUNK = 3, 4096
#: Lengths in bytes and the least and greatest ratio allowed from there on, whatever the corpus. Below
#: 256 bytes a frame's own cost rules the ratio, so only noise that grows in compression is rejected there.
BANDS = ((0, 0.0, 2.0), (256, 0.22, 0.92), (1024, 0.20, 0.80), (4096, 0.18, 0.72), (16384, 0.16, 0.66), (65536, 0.14, 0.62))
#: Of the chunks of CHUNK bytes, so large a share may lie outside the band of that length.
BAD_CHUNKS = 0.5
#: Fitted limits: deviations from the median, parts of an octave of length that share limits, texts (or
#: chunks) of a length with which its limits lie half way from BANDS, and steps of the ratio that are told apart.
DEVIATIONS, PER_OCTAVE, HALF_WAY, STEPS = 4.0, 2, 30, 1000
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

RESULT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
          "base_failed:boolean,ratio:double,bad_chunks:double,kept:boolean>")
_FOLLOW = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    code = np.fromiter(map(seen.setdefault, words, map(len, repeat(seen))), np.int64, len(words))
    m = len(seen) + 1
    if m < 1 << 20:
        key = (code[:-2] * m + code[1:-1]) * m + code[2:]
    else:  # three codes don't fit: number the pairs first
        _, pair = np.unique(code[:-1] * m + code[1:], return_inverse=True)
        key = pair[:-1] * m + code[2:]
    order = np.argsort(key, kind="stable")
    own = key[order]
    same = own[1:] == own[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    word = np.zeros(len(words), bool)
    for k in range(3):
        word[k : k + n] |= twice
    return int(word.sum())


#: Fitted bounds of the ratio, and how far they count beside those of BANDS (0 to 1).
Bounds = tuple[float, float, float]


@dataclass
class Limits:
    """What was fitted: by length class of whole texts, and of a chunk; none where none was seen."""

    whole: dict[int, Bounds] = field(default_factory=dict)
    chunk: Bounds | None = None


def length_class(size: int) -> int:
    return int(math.log2(size) * PER_OCTAVE) if size else 0


def in_band(ratio: float, size: int, fitted: Bounds | None = None) -> bool:
    """Whether a ratio lies in the band of its size, and between its bounds on the way from that band to the fitted ones."""
    _, low, high = next(b for b in reversed(BANDS) if size >= b[0])
    if fitted is None or size < BANDS[1][0]:
        return low <= ratio <= high
    own_low, own_high, far = fitted
    return max(low, low + far * (own_low - low)) <= ratio <= min(high, high + far * (own_high - high))


def bounds(counts: dict[int, int]) -> Bounds:
    """Limits from how often each step of the ratio was seen. They count the more, the more was seen, without a step:
    a few texts say little of what is usual, so theirs lie near BANDS."""
    total, seen, at = sum(counts.values()), 0, []
    for step in sorted(counts):
        seen += counts[step]
        while len(at) < 3 and seen >= total * (0.25, 0.5, 0.75)[len(at)]:
            at.append((step + 0.5) / STEPS)
    low, mid, high = at
    normal = 0.6745  # a quartile of the normal distribution, in deviations
    far = total**2 / (total**2 + HALF_WAY**2)
    return mid - DEVIATIONS * max(mid - low, 1 / STEPS) / normal, mid + DEVIATIONS * max(high - mid, 1 / STEPS) / normal, far


def measure(text: bytes, squeeze: zstandard.ZstdCompressor) -> tuple:
    """n_words to base_failed of RESULT, the whole text's ratio, and those of its chunks (none if it is one)."""
    words = text.split()  # bytes split at the six ASCII spaces
    n_repeat = repeated_words(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    chars = len(text.translate(None, SPACES + _FOLLOW))
    base = len(words) < MIN_WORDS or 100 * n_repeat > MOST_REPEATED * len(words)
    ratio = len(squeeze.compress(text)) / len(text) if text else 0.0
    chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    if len(chunks) > 1 and len(chunks[-1]) < CHUNK:
        chunks.pop()  # a short rest counts in the whole text alone
    each = [len(squeeze.compress(c)) / CHUNK for c in chunks] if len(text) > CHUNK else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), n_repeat, base, ratio, each


def judge(size: int, base: bool, ratio: float, each: list[float], limits: Limits) -> tuple[float, bool]:
    """bad_chunks and kept of RESULT."""
    bad = sum(not in_band(r, CHUNK, limits.chunk) for r in each) / len(each) if each else 0.0
    return bad, not base and in_band(ratio, size, limits.whole.get(length_class(size))) and bad <= BAD_CHUNKS


def fit(df: DataFrame, text: str = "text") -> Limits:
    """Limits from every text that passes the word rules; each length's count as far as its texts are many (`bounds`)."""

    @F.arrow_udf("array<int>")
    def steps(texts: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        out = []
        for x in text_bytes(texts):
            *_, base, ratio, each = measure(x or b"", squeeze)
            out.append([] if base else [length_class(len(x)) << 16 | int(ratio * STEPS), *(-1 << 16 | int(r * STEPS) for r in each)])
        return pa.array(out, pa.list_(pa.int32()))

    seen = df.select(F.explode(steps(F.col(f"`{text}`"))).alias("s")).groupBy("s").count().collect()  # bounded: lengths times steps
    by: dict[int, dict[int, int]] = {}
    for s, n in seen:
        by.setdefault(s >> 16, {})[s & 0xFFFF] = n
    found = {k: bounds(counts) for k, counts in by.items()}
    return Limits({k: b for k, b in found.items() if k >= 0}, found.get(-1))


def assess(df: DataFrame, text: str = "text", limits: Limits | None = None) -> DataFrame:
    """`df` with the counts, base_failed, ratio, bad_chunks (share of chunks out of band) and kept, by
    the given limits or those fitted on `df` itself.

    Words are runs of anything but the six ASCII spaces. A null or empty text has zero counts,
    ratio 0 and fails the base rules. Every text is read whole; equal rows get equal results, an
    empty table an empty one. Input columns of the result's names are replaced."""
    limits = limits or fit(df, text)

    @F.arrow_udf(RESULT)
    def of(texts: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        rows = []
        for x in text_bytes(texts):
            *counts, base, ratio, each = measure(x or b"", squeeze)
            rows.append((*counts, base, ratio, *judge(len(x or b""), base, ratio, each, limits)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 9
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        names = [f.split(":")[0] for f in RESULT[7:-1].split(",")]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return chosen(df, "quality", of(F.col(f"`{text}`")))
