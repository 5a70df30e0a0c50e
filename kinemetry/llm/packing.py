"""Packing token sequences by minimum bin slack.

Each document's ids (with a closing id) are cut at multiples of the capacity; whole chunks are
sequences of their own, and the rests of a partition are packed. Per sequence the longest rest is
set, and a subset-sum over the multiset of remaining lengths, run on the bits of one integer,
finds the lengths that fill it closest to capacity; backtracking gives how many of each. What is
still missing is cut from another rest. A partition's last tokens, fewer than the capacity, go to
sequences whose lengths are powers of two, so that nothing is padded."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinemetry.llm.byte_bpe import BLOCK, encode, from_json
from kinemetry.llm.common import blocks

CAPACITY, END = 1024, 0
#: Rests that are packed together: a sequence is only closed while so many can still be chosen from.
WINDOW = 4096


def fill(room: int, counts: list[int], lengths: int) -> list[tuple[int, int]]:
    """Lengths, and how many of each, whose sum comes closest to `room` without exceeding it.

    counts: of every length; lengths: the bits of the lengths that are there."""
    reach, full, steps = 1, (1 << room + 1) - 1, []
    left = lengths & full & ~1
    while left and not reach >> room & 1:
        size = left.bit_length() - 1
        left ^= 1 << size
        most, part = min(counts[size], room // size), 1
        while most and not reach >> room & 1:
            part = min(part, most)
            more = (reach | reach << size * part) & full
            if more != reach:
                steps.append((size, part, reach))
                reach = more
            most, part = most - part, part * 2
    at, out = reach.bit_length() - 1, {}
    for size, part, before in reversed(steps):
        if not before >> at & 1:
            at -= size * part
            out[size] = out.get(size, 0) + part
    return list(out.items())


class Packer:
    """The rests of one partition by length, and the pieces that were placed."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.n, self.total, self.next, self.lengths = capacity, 0, 0, 0, 0
        self.rests: list[list] = [[] for _ in range(capacity + 1)]
        self.counts = [0] * (capacity + 1)
        self.placed: list[tuple] = []

    def add(self, rest: tuple) -> None:
        """rest: document, start, its ids, the document's tokens."""
        size = len(rest[2])
        self.rests[size].append(rest)
        self.counts[size] += 1
        self.lengths |= 1 << size
        self.n, self.total = self.n + 1, self.total + size

    def take(self, size: int) -> tuple:
        rest = self.rests[size].pop()
        self.counts[size] -= 1
        if not self.counts[size]:
            self.lengths ^= 1 << size
        self.n, self.total = self.n - 1, self.total - size
        return rest

    def place(self, rest: tuple, sequence: int, offset: int) -> int:
        self.placed.append((*rest, sequence, offset))
        return offset + len(rest[2])

    def sequence(self, room: int) -> None:
        """Fill one sequence of `room` tokens, at most what is there."""
        own, self.next = self.next, self.next + 1
        offset = 0
        longest = (self.lengths & ((1 << room + 1) - 1)).bit_length() - 1
        if longest > 0:
            offset = self.place(self.take(longest), own, 0)
        for size, n in fill(room - offset, self.counts, self.lengths):
            for _ in range(n):
                offset = self.place(self.take(size), own, offset)
        while offset < room:  # no rest fits any more: cut one
            document, start, ids, tokens = self.take(self.lengths.bit_length() - 1)
            cut = room - offset
            offset = self.place((document, start, ids[:cut], tokens), own, offset)
            if cut < len(ids):
                self.add((document, start + cut, ids[cut:], tokens))

    def pack(self, last: bool) -> None:
        while self.total >= self.capacity and (last or self.n > WINDOW):
            self.sequence(self.capacity)
        while last and self.total:
            self.sequence(1 << self.total.bit_length() - 1)


def pieces(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: the document's id (under its own name), start, length, ids_crc32 (of the
    little-endian 32-bit ids), doc_tokens, sequence_id, offset, and with `with_ids` the ids.

    Every id of every document lies in one piece; offsets of a sequence have no gap. Each partition
    of the input is packed by itself, in windows, so nothing is shuffled and no task holds more than
    a window of rests. A null or empty text has the closing id alone; repeated rows are packed each;
    an empty table gives an empty one; other columns are left out."""
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def rows(placed: list[tuple], first: int) -> pa.RecordBatch:
        cols = list(zip(*placed, strict=True))
        ids = [np.ascontiguousarray(x, "<u4") for x in cols[2]]
        arrays = [pa.array(cols[0], rows.kind), pa.array(cols[1], pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                  pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(cols[3], pa.int64()),
                  pa.array([first + x for x in cols[4]], pa.int64()), pa.array(cols[5], pa.int64())]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=[doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, packer = from_json(tokenizer_path), Packer(capacity)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows.kind = batch.column(0).type
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(np.array([len(t) for t in texts]), BLOCK):
                ids, counts = encode(v, texts[a:b])
                ends = np.cumsum(counts).tolist()
                for name, lo, hi in zip(names[a:b], [0, *ends], ends, strict=False):
                    own = np.append(ids[lo:hi], np.uint32(END))
                    whole = len(own) - len(own) % capacity
                    for k in range(0, whole, capacity):
                        packer.place((name, k, own[k : k + capacity], len(own)), packer.next, 0)
                        packer.next += 1
                    if whole < len(own):
                        packer.add((name, whole, own[whole:], len(own)))
                packer.pack(last=False)
                if packer.placed:
                    yield rows(packer.placed, first)
                    packer.placed = []
        packer.pack(last=True)
        if packer.placed:
            yield rows(packer.placed, first)

    return df.select(f"`{doc_id}`", f"`{text}`").mapInArrow(packed, schema)
