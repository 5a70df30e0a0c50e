"""Byte-level BPE, encoding and decoding, by padded numpy matrices.

The different pre-tokens of a block of texts are laid out as rows of byte ids in matrices by
length class. In each round every row merges its leftmost pair of least rank: ranks come from a
hash table of pairs, only the two pairs beside a merge are looked up anew, and rows that have no
pair left leave the matrix. A row then gives its ids to all places where its pre-token stands."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinemetry.llm.common import blocks, chosen
from kinemetry.llm.pretokens import Words, split, spread

NONE = np.int32(2**31 - 1)
BLOCK = 4_000_000
#: Rows up to these lengths share a matrix; longer pre-tokens are merged with a heap, each by itself.
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256)
CELLS = 2_000_000


@dataclass
class Vocabulary:
    """Bytes of every id, and the pairs that merge: hash slots with pair key, rank and id."""

    pieces: list[bytes]
    whole: pa.Array  # pieces that stand for a whole pre-token at once, and their ids
    whole_id: np.ndarray
    slots: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    probes: int

    def __post_init__(self) -> None:
        self.byte = np.zeros(256, np.int32)
        for i, p in enumerate(self.pieces):
            if len(p) == 1:
                self.byte[p[0]] = i
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(self.pieces), np.uint8)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of each merged pair; NONE where a pair does not merge."""
        key = a.astype(np.int64) << 20 | b
        slot = _slot(key, len(self.slots))
        rank, to = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        left = np.arange(len(key))
        for _ in range(self.probes):
            own = self.slots[slot]
            hit = own == key
            rank[left[hit]], to[left[hit]] = self.rank[slot[hit]], self.merged[slot[hit]]
            on = ~hit & (own >= 0)
            if not on.any():
                break
            left, key, slot = left[on], key[on], (slot[on] + 1) & (len(self.slots) - 1)
        return rank, to


def _slot(key: np.ndarray, n: int) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def vocabulary(pieces: list[bytes], pairs: list[tuple[int, int, int, int]], whole: bool) -> Vocabulary:
    """pairs: left id, right id, rank, merged id."""
    n = 1 << max(4, (4 * len(pairs)).bit_length())
    slots, rank, to = np.full(n, -1, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)
    keys = np.array([a << 20 | b for a, b, _, _ in pairs], np.int64)
    probes = 1
    for (_, _, r, i), key, s in zip(pairs, keys.tolist(), _slot(keys, n).tolist(), strict=True):
        far = 1
        while slots[s] >= 0:
            s, far = (s + 1) & (n - 1), far + 1
        slots[s], rank[s], to[s], probes = key, r, i, max(probes, far + 1)
    own = [(p, i) for i, p in enumerate(pieces) if p] if whole else []
    return Vocabulary(pieces, pa.array([p for p, _ in own], pa.binary()), np.array([i for _, i in own], np.int32), slots, rank, to, probes)


@cache
def from_ranks(path: str) -> Vocabulary:
    """A file of base64 pieces and ranks: any two neighbours whose bytes together are a piece merge
    by its rank, and a pre-token that is a piece takes its id at once."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    pieces = [b""] * (max(ranks.values()) + 1)
    for p, i in ranks.items():
        pieces[i] = p
    pairs = [(ranks[p[:k]], ranks[p[k:]], i, i) for p, i in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks]
    return vocabulary(pieces, pairs, whole=True)


@cache
def from_json(path: str) -> Vocabulary:
    """A tokenizer file with a byte-level BPE model: its listed merges, in order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    ids = model["vocab"]
    pieces = [b""] * (max(ids.values()) + 1)
    for p, i in ids.items():
        if all(c in char for c in p):
            pieces[i] = bytes(char[c] for c in p)
    pairs = []
    for r, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs.append((ids[a], ids[b], r, ids[a + b]))
    return vocabulary(pieces, pairs, whole=False)


def _merge_matrix(v: Vocabulary, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounds over one matrix (rows padded with -1 after `length` ids): merged ids and lengths."""
    n, w = ids.shape
    done, out_len = np.full((n, w), -1, np.int32), np.zeros(n, np.int64)
    row = np.arange(n)
    rank, to = np.full((n, w), NONE, np.int32), np.zeros((n, w), np.int32)
    at = np.flatnonzero((np.arange(w - 1) < (length - 1)[:, None]).ravel()) if w > 1 else np.zeros(0, int)
    if len(at):
        y, x = np.divmod(at, w - 1)
        rank[y, x], to[y, x] = v.pair(ids[y, x], ids[y, x + 1])
    length = length.copy()
    while len(row):
        best = rank.argmin(axis=1)
        every = np.arange(len(row))
        live = rank[every, best] != NONE
        if not live.all():
            gone = ~live
            done[row[gone], : ids.shape[1]], out_len[row[gone]] = ids[gone], length[gone]
            row, ids, rank, to, best, length = row[live], ids[live], rank[live], to[live], best[live], length[live]
            every = every[: len(row)]
            if not len(row):
                break
        ids[every, best] = to[every, best]
        keep = np.ones(ids.shape, bool)
        keep[every, best + 1] = False
        w = ids.shape[1] - 1
        ids = ids[keep].reshape(-1, w)
        # the rank at a place is that of the pair it begins: the merged pair's two are looked up
        rank, to = rank[keep].reshape(-1, w), to[keep].reshape(-1, w)
        length -= 1
        rank[every, best] = NONE
        y = every[best + 1 < length]
        x = best[y]
        rank[y, x], to[y, x] = v.pair(ids[y, x], ids[y, x + 1])
        y = every[best > 0]
        x = best[y] - 1
        rank[y, x], to[y, x] = v.pair(ids[y, x], ids[y, x + 1])
    return done, out_len


def _merge_long(v: Vocabulary, word: bytes) -> np.ndarray:
    """One long pre-token: the same merges in the same order, from a heap."""
    ids = v.byte[np.frombuffer(word, np.uint8)]
    rank, to = v.pair(ids[:-1], ids[1:])
    ids = ids.tolist()
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(int(r), int(i), ids[i], ids[i + 1], int(to[i])) for i, r in enumerate(rank.tolist()) if r != NONE]
    heapq.heapify(heap)
    alive = [True] * len(ids)

    def look(i: int) -> None:
        j = after[i]
        if j < len(ids):
            r, t = v.pair(np.array([ids[i]], np.int32), np.array([ids[j]], np.int32))
            if r[0] != NONE:
                heapq.heappush(heap, (int(r[0]), i, ids[i], ids[j], int(t[0])))

    while heap:
        _, i, a, b, t = heapq.heappop(heap)
        j = after[i] if alive[i] else len(ids)
        if j >= len(ids) or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = t, False, after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    return np.array([x for x, on in zip(ids, alive, strict=True) if on], np.int32)


def encode_words(v: Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each has."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    count = np.zeros(n, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    todo = np.arange(n)
    if len(v.whole):
        i = pc.fill_null(pc.index_in(words, value_set=v.whole), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(i >= 0)
        count[known] = 1
        parts.append((known, v.whole_id[i[known]]))
        todo = np.flatnonzero(i < 0)
    low = 0
    for wide in WIDTHS:
        group = todo[(size[todo] > low) & (size[todo] <= wide)]
        low = wide
        for k in range(0, len(group), max(1, CELLS // wide)):
            rows = group[k : k + max(1, CELLS // wide)]
            ids = np.full((len(rows), wide), -1, np.int32)
            inside = np.arange(wide) < size[rows][:, None]
            ids[inside] = v.byte[data[spread(offsets[rows], size[rows])]]
            merged, length = _merge_matrix(v, ids, size[rows])
            count[rows] = length
            parts.append((rows, merged[np.arange(wide) < length[:, None]]))
    for r in todo[size[todo] > low]:
        ids = _merge_long(v, data[offsets[r] : offsets[r + 1]].tobytes())
        count[r] = len(ids)
        parts.append((np.array([r]), ids))
    out = np.zeros(int(count.sum()), np.int32)
    first = np.cumsum(count) - count
    for rows, ids in parts:
        out[spread(first[rows], count[rows])] = ids
    return out, count


def encode(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another (as unsigned 32-bit), and how many each has."""
    words: Words = split(texts)
    ids, count = encode_words(v, words.words)
    first = np.cumsum(count) - count
    per = count[words.code]
    ends = np.concatenate(([0], np.cumsum(per)))
    text_end = ends[np.concatenate(([0], np.cumsum(words.counts)))]
    return ids[spread(first[words.code], per)].astype("<u4"), np.diff(text_end)


def decode(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and how many each has."""
    size = v.size[ids]
    data = v.data[spread(v.start[ids], size)]
    ends = np.concatenate(([0], np.cumsum(size)))
    return data, np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])


def with_ids(df: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """`df` with `ids` (array of int), the tokens of the whole text; null text: none."""

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        v, full = from_ranks(vocabulary_path), [t or "" for t in texts.to_pylist()]
        ids, counts = [], []
        for a, b in blocks(np.array([len(t) for t in full]), BLOCK):
            i, c = encode(v, full[a:b])
            ids.append(i), counts.append(c)
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))

    return df.withColumn("ids", of(F.col(f"`{text}`")))


def with_text(df: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """`df` with `decoded` (binary), the bytes that the ids stand for; null ids: none."""

    @F.arrow_udf("binary")
    def of(lists: pa.Array) -> pa.Array:
        v = from_ranks(vocabulary_path)
        rows = [np.asarray(x or [], np.int64) for x in lists.to_pylist()]
        return pa.array([decode(v, x, np.array([len(x)]))[0].tobytes() for x in rows], pa.binary())

    return df.withColumn("decoded", of(F.col(f"`{ids}`")))


DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def digests(df: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """`df` with n_tokens, ids_sha256 (of the little-endian 32-bit ids) and decoded_sha256 (of the
    bytes that decoding those ids gives).

    Whole texts, in blocks of texts; a null text counts as empty and has no tokens. Repeated rows
    get equal results, an empty table an empty result; input columns of these names are replaced."""

    @F.arrow_udf(DIGEST)
    def of(texts: pa.Array) -> pa.Array:
        v, full = from_ranks(vocabulary_path), [t or "" for t in texts.to_pylist()]
        n, sha, back = [], [], []
        for a, b in blocks(np.array([len(t) for t in full]), BLOCK):
            ids, counts = encode(v, full[a:b])
            data, sizes = decode(v, ids, counts)
            raw, plain, i, d = memoryview(ids.view(np.uint8)), memoryview(data), 0, 0
            for c, s in zip(counts.tolist(), sizes.tolist(), strict=True):
                n.append(c)
                sha.append(hashlib.sha256(raw[4 * i : 4 * (i + c)]).hexdigest())
                back.append(hashlib.sha256(plain[d : d + s]).hexdigest())
                i, d = i + c, d + s
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return chosen(df, "digest", of(F.col(f"`{text}`")))
