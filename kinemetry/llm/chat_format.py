r"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>role\ntext<|im_end|>\n`. The turns of a batch are laid out at once:
segment lengths give offsets by a running sum, and headers, roles, texts and tails are scattered
to their places in one preallocated buffer, which becomes the Arrow column.

Inside roles and texts `<`, any backslashes and `|` get one more backslash before the `|`, so no
control string can arise and none is lost; in roles a line feed is `\n` and a backslash `\\`."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinemetry.llm.common import blocks, chosen
from kinemetry.llm.pretokens import spread

START, END = b"<|im_start|>", b"<|im_end|>"
LEARNED = b"assistant"
_CONTROL, _ESCAPED = re.compile(rb"<\\*\|"), re.compile(rb"<\\(\\*)\|")


def escape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a buffer with control strings escaped, and their new offsets."""
    found = [m.span() for m in _CONTROL.finditer(memoryview(np.ascontiguousarray(data)))]
    if not found:
        return data, offsets
    begin, end = np.array(found).T
    inside = np.searchsorted(offsets, begin, "right") == np.searchsorted(offsets, end - 1, "right")
    bar = end[inside] - 1
    return np.insert(data, bar, ord("\\")), offsets + np.searchsorted(bar, offsets, "left")


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", text)


def escape_role(role: bytes) -> bytes:
    plain = role.replace(b"\\", b"\\\\").replace(b"\n", b"\\n")
    return _CONTROL.sub(lambda m: m[0][:-1] + b"\\|", plain)


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role))


def assemble(roles: list[bytes], text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns one after another; where each begins (one more at the end); where its text does."""
    text, offsets = escape(text, offsets)
    kinds = {r: escape_role(r) for r in set(roles)}
    own = [kinds[r] for r in roles]
    role = np.frombuffer(b"".join(own), np.uint8)
    role_len, text_len = np.array([len(r) for r in own], np.int64), np.diff(offsets)
    tail = END + b"\n"
    ends = np.cumsum(len(START) + role_len + 1 + text_len + len(tail))
    begin = np.concatenate(([0], ends)).astype(np.int64)
    out = np.empty(begin[-1], np.uint8)
    at = begin[:-1]
    for k, c in enumerate(START):
        out[at + k] = c
    at = at + len(START)
    out[spread(at, role_len)] = role
    at = at + role_len
    out[at] = ord("\n")
    text_at = at + 1
    out[spread(text_at, text_len)] = text[offsets[0] : offsets[-1]]
    at = text_at + text_len
    for k, c in enumerate(tail):
        out[at + k] = c
    return out, begin, text_at


FIELDS = ["formatted", "loss_starts", "loss_ends"]
#: Bytes of one Arrow column of formatted texts, unless one conversation alone is longer.
COLUMN_BYTES = 1 << 28


def _rows(parts: list[pa.RecordBatch], conv_id: str) -> Iterator[pa.RecordBatch]:
    """The conversations of whole batches (id, role, text): slices of the assembled buffer are the columns."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    if not rows.num_rows:
        return
    ids = rows.column(0).combine_chunks() if isinstance(rows.column(0), pa.ChunkedArray) else rows.column(0)
    given = ids.to_pylist()
    roles = [r or b"" for r in rows.column(1).cast(pa.binary()).to_pylist()]
    texts = pa.array([t or b"" for t in rows.column(2).cast(pa.large_binary()).to_pylist()], pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    out, begin, text_at = assemble(roles, np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets)
    first = np.array([0, *(i for i in range(1, len(given)) if given[i] != given[i - 1])])
    start = np.append(begin[first], begin[-1])  # of each conversation, and the end
    learned = np.flatnonzero([r == LEARNED for r in roles])
    of = np.searchsorted(first, learned, "right") - 1
    spans = [text_at[learned] - start[of], begin[learned + 1] - len(END) - 1 - start[of]]
    places = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(first)))))
    for a, b in blocks(np.diff(start), COLUMN_BYTES):
        own = (start[a : b + 1] - start[a]).astype(np.int32)
        text = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(own), pa.py_buffer(out[start[a] : start[b]])])
        lists = [pa.ListArray.from_arrays(pa.array((places[a : b + 1] - places[a]).astype(np.int32)), pa.array(s[places[a] : places[b]], pa.int64())) for s in spans]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[a:b])), text, *lists], names=[conv_id, *FIELDS])


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, `formatted` (string), and the byte spans of it that carry
    the loss, `loss_starts` and `loss_ends`: the texts of role `assistant`.

    Rows stand by turn (ties: by role, then text). A null role or text is empty, a null turn comes
    first, null ids are one conversation; repeated rows are turns each; an empty table gives an empty
    one; other columns are left out. Rows are dealt by conversation and sorted on disk if need be; a
    conversation is one value, so one task writes it."""
    kind = turns.schema[conv_id].dataType.simpleString()
    dealt = turns.select(*[F.col(f"`{c}`").alias(n) for c, n in ((conv_id, "c"), (turn, "t"), (role, "r"), (text, "x"))])
    dealt = dealt.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a conversation that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            cut = len(ids) - 1
            while cut and ids[cut - 1] == ids[-1]:
                cut -= 1
            if cut or held and held[0].column(0)[0].as_py() != ids[0]:
                yield from _rows([*held, batch.slice(0, cut)], conv_id)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from _rows(held, conv_id)

    return dealt.mapInArrow(formatted, f"`{conv_id}` {kind}, formatted string, loss_starts array<long>, loss_ends array<long>")


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of every turn, read back."""
    out = []
    for part in formatted.split(END + b"\n")[:-1]:
        role, _, text = part.removeprefix(START).partition(b"\n")
        out.append((unescape_role(role), unescape(text)))
    return out


DIGEST = "struct<n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string,formatted_chars:bigint>"


def read_back(formatted: DataFrame) -> DataFrame:
    """What `conversations` wrote, read back: turns and their digest, characters and digest of the
    text under the loss spans (unescaped), characters of the formatted text."""

    @F.arrow_udf(DIGEST)
    def of(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = []
        for text, a, b in zip(texts.cast(pa.binary()).to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            turns, all_turns, loss, chars = parse(text), hashlib.sha256(), hashlib.sha256(), 0
            for r, t in turns:
                all_turns.update(r + b"\n" + t + b"\n")
            for i, j in zip(a, b, strict=True):
                own = unescape(text[i:j])
                loss.update(own)
                chars += len(own.decode())
            rows.append((len(turns), all_turns.hexdigest(), chars, loss.hexdigest(), len(text.decode())))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split(":")[0] for f in DIGEST[7:-1].split(",")])

    return chosen(formatted, "digest", of(*[F.col(f) for f in FIELDS])).drop(*FIELDS)
