"""Pre-tokens of many texts at once: their byte bounds, and the different ones.

`split` cuts like the pattern of byte-level BPE vocabularies: contractions ('s 't 're 've 'm 'll
'd), runs of letters, of numbers or of other characters with one space before them, and white
space (whose last character stands alone before anything else)."""

from __future__ import annotations

import sys
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


class Words(NamedTuple):
    """Of a block of texts: the different pre-tokens, the number of each pre-token's word in
    order, and how many pre-tokens each text has."""

    words: pa.Array
    code: np.ndarray
    counts: np.ndarray


def _starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; `first` marks the texts' first ones."""
    kind = _classes()[code]
    n = len(kind)
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge |= first
    blank = kind == SPACE
    after = np.zeros(n, bool)  # the last white space before something else of the same text
    after[:-1] = blank[:-1] & edge[1:] & ~first[1:]
    start = edge | after
    joined = np.zeros(n, bool)  # a run that takes the space before it
    joined[1:] = edge[1:] & ~blank[1:] & (code[:-1] == 32) & ~first[1:]
    start &= ~joined
    # contractions: a lone apostrophe that no space joins, with letters of the list behind it
    quote = np.flatnonzero((code == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        one = code[quote + 1]
        last = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~first[last] & (kind[last] == LETTER), code[last], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short | long] + 1] = False
        cut = quote[short | long] + np.where(short, 2, 3)[short | long]
        cut = cut[cut < n]
        start[cut] = True
    return start


def _words(data: np.ndarray, begin: np.ndarray, end: int, counts: np.ndarray) -> Words:
    offsets = np.append(begin, end).astype(np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = flat.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' code points, where each text begins, and the code points' lengths in UTF-8."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    size = np.ones(len(code), np.int8)
    for least in (0x80, 0x800, 0x10000):
        size += code >= least
    return code, at, size


def cut(texts: list[str], starts) -> Words:
    """The words of the texts, where `starts(code points, first of a text)` says they begin."""
    code, at, size = code_points(texts)
    if not len(code):
        return Words(pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(len(texts), np.int64))
    first = np.zeros(len(code) + 1, bool)
    first[at[:-1]] = True
    begin = np.flatnonzero(starts(code, first[:-1]))
    counts = np.diff(np.searchsorted(begin, at))
    byte = np.cumsum(size, dtype=np.int64)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return _words(data, byte[begin] - size[begin], int(byte[-1]), counts)


def split(texts: list[str]) -> Words:
    return cut(texts, _starts)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every piece, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


if sys.byteorder != "little":
    raise ImportError("little-endian machines only")
