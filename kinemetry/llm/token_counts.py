"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a stretch of text; dynamic
programming carries the best score and its piece count to every place. Of equal scores the path
found first stands, the one whose last piece starts earlier, as the unigram tokenizers have it. A
character that no piece of one character covers costs the least score less ten and counts as its
UTF-8 bytes. No piece has a space mark behind another character, so a text falls into stretches at
its spaces, and each different stretch of a block is scored once.

This is right for unigram scores only. The scores of a BPE file are the order of its merges, whose sum
means nothing; `with_merge_counts` counts such a file's pieces by its merges."""

from __future__ import annotations

from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinemetry.llm.common import blocks
from kinemetry.llm.pretokens import cut

MARK, UNKNOWN_PENALTY, BLOCK = "▁", 10.0, 8_000_000
#: Stretches whose counts a worker remembers.
REMEMBERED = 400_000


class Counter:
    """Piece counts under the pieces and scores of a vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        # stretches can be parted where no piece goes on: before a mark that follows something else
        self.parts = not any(MARK in p.lstrip(MARK) for p, _ in vocabulary)
        self.known: dict[bytes, int] = {}

    def count(self, text: str) -> int:
        """Pieces of the best path over the whole stretch."""
        n = len(text)
        best, pieces = [0.0] + [None] * n, [0] * (n + 1)
        # matches come by end; of one end the longest first, which starts earliest
        matches = self.automaton.iter(text)
        found = next(matches, None)
        unknown, single = self.unknown, self.single
        for end in range(n):
            top = None
            while found is not None and found[0] == end:
                size, score = found[1]
                start = end + 1 - size
                score += best[start]
                if top is None or score > top:
                    top, own = score, pieces[start] + 1
                found = next(matches, None)
            if text[end] not in single:  # the place before is always reached, by such a step at least
                score = best[end] + unknown
                if top is None or score > top:
                    top, own = score, pieces[end] + len(text[end].encode())
            best[end + 1], pieces[end + 1] = top, own
        return pieces[n]

    def remembered(self, stretch: bytes) -> int:
        n = self.known.get(stretch)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[stretch] = self.count(stretch.decode())
        return n

    def counts(self, texts: list[str]) -> np.ndarray:
        """Pieces of every text. Spaces become marks, and a text that isn't empty begins with one."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        if not self.parts:
            return np.array([self.count(t) for t in marked], np.int64)
        words = cut(marked, _stretches)
        own = np.array([self.remembered(w) for w in words.words.to_pylist()], np.int64)
        ends = np.concatenate(([0], np.cumsum(own[words.code])))
        return np.diff(ends[np.concatenate(([0], np.cumsum(words.counts)))])


def _stretches(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    mark = code == ord(MARK)
    start = first.copy()
    start[1:] |= mark[1:] & ~mark[:-1]
    return start


@cache
def from_sentencepiece(path: str) -> Counter:
    """The normal pieces and scores of a sentencepiece file; bytes stand for what they don't cover."""
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(p.vocab_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    return Counter([(p.id_to_piece(i), p.get_score(i)) for i in ids])


def with_counts(df: DataFrame, vocabulary_path: str, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """`df` with the number of pieces of the whole text (long), without special tokens.

    A null or empty text has 0. Repeated rows get equal results, an empty table an empty result; an
    input column of the result's name is replaced."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        counter, full = from_sentencepiece(vocabulary_path), [t or "" for t in texts.to_pylist()]
        out = [counter.counts(full[a:b]) for a, b in blocks(np.array([len(t) for t in full]), BLOCK)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())

    return df.withColumn(to, of(F.col(f"`{text}`")))


@cache
def _processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def with_merge_counts(df: DataFrame, model_path: str, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """`df` with the number of pieces that a sentencepiece file's own tokenizer makes of the whole text
    (long), without special tokens: a BPE file's by the order of its merges.

    A null or empty text has 0. Repeated rows get equal results, an empty table an empty result; an
    input column of the result's name is replaced."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        full, out = [t or "" for t in texts.to_pylist()], []
        for a, b in blocks(np.array([len(t) for t in full]), BLOCK):
            out += map(len, _processor(model_path).encode(full[a:b], num_threads=1))
        return pa.array(out, pa.int64())

    return df.withColumn(to, of(F.col(f"`{text}`")))
