"""SimHash near-duplicates by Golay-code fuzzy hashing.

Two 64-bit fingerprints link if at most two bits differ. A fingerprint is cut into three segments;
two errors leave one segment untouched (pigeonhole), and each other segment has at most two. In the
binary Golay code (23, 12) every word lies within three bits of one codeword, so the codewords
nearest to a segment and to its one-bit neighbours are one or six, and segments at most two bits
apart share one of them. The keys (segment i exact, codeword index of segment i + 1), at most 18 per
fingerprint, therefore meet for every link; pairs that meet are verified."""

from __future__ import annotations

import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinemetry.llm.common import components, text_bytes, written

SHINGLE, SEED, BITS_APART = 3, 42, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Different fingerprints with one key up to which they are compared pair by pair. Those of a larger
#: key link through the words one bit away from them: two fingerprints are at most two bits apart
#: just if they share such a word (or one is the other's), and a word has 65 at most.
PAIRWISE = 32
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0b110001110101


def fingerprint(text: bytes | None) -> int:
    """SimHash of the lower-cased (A-Z) text's 3-word shingles, as an unsigned 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(SHINGLE, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """`df` with the text's fingerprint, as a signed long with the same bits. Null, empty and blank
    texts have 0."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in text_bytes(texts)], np.uint64).view(np.int64))

    return df.withColumn(to, of(F.col(f"`{text}`")))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """The syndromes of single bits, and the least-weight error of each syndrome."""
    def rest(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GENERATOR << (k - 11)
        return word

    single = np.array([rest(1 << k) for k in range(23)])
    error = np.zeros(2048, np.int64)
    for i in range(23):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return single, error


def codewords(words: np.ndarray) -> np.ndarray:
    """Per 23-bit word, the 12-bit indices of the codewords nearest to it and to its neighbours: 24
    columns, -1 where one is repeated."""
    single, error = _golay()
    syndrome = np.zeros(len(words), np.int64)
    for k in range(23):
        syndrome ^= np.where(words >> k & 1, single[k], 0)
    columns = [(words ^ error[syndrome]) >> 11]
    for k in range(23):
        near = words ^ (1 << k)
        columns.append((near ^ error[syndrome ^ single[k]]) >> 11)
    out = np.sort(np.stack(columns, axis=1), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints, one after another, and how many each has."""
    f = fingerprints.view(np.uint64)
    cut = [((f >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    code = [codewords(c) for c in cut]
    wide = np.concatenate([np.where(code[(i + 1) % 3] < 0, -1, (i << 34 | cut[i] << 12)[:, None] | code[(i + 1) % 3]) for i in range(3)], axis=1)
    return wide[wide >= 0], (wide >= 0).sum(axis=1)


def _keys_of(fp: pa.Array) -> pa.Array:
    flat, counts = keys(fp.to_numpy(zero_copy_only=False).astype(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat))


def links(fingerprints: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (u, v) between different values of a fingerprint column: enough of them that the
    components are those of all pairs at most two bits apart; every row is such a pair, or joins a
    fingerprint to a smaller one that shares a word one bit from both."""
    keys_of = F.arrow_udf(_keys_of, "array<long>")
    keyed, _ = written(fingerprints.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
                       .select("fp", F.explode(keys_of("fp")).alias("key")))
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    apart = f"bit_count(u ^ v) <= {BITS_APART}"
    two = met.where("n = 2").where(apart).select("u", "v")
    some = keyed.join(met.where("n > 2").select("key", "n"), "key")
    few = some.where(f"n <= {PAIRWISE}").groupBy("key").agg(F.collect_list("fp").alias("all"))
    few = (few.select(F.explode("all").alias("u"), "all").select("u", F.explode(F.expr(f"filter(all, v -> v > u and bit_count(u ^ v) <= {BITS_APART})")).alias("v")))
    many = some.where(f"n > {PAIRWISE}").select("fp").distinct()
    ball = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k)))")).alias("word"))
    least = ball.groupBy("word").agg(F.collect_list("fp").alias("all")).where("size(all) > 1")
    many = least.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).select("u", "v").where("u <> v")
    return two.unionByName(few).unionByName(many)


def _of_groups(rows: DataFrame) -> DataFrame:
    """(fp, group) of every fingerprint of `rows`: the group is one of its fingerprints."""
    whole = components(links(rows))
    return rows.select("fp").distinct().join(whole.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"))


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: its id, `fp` (long), `fingerprint` (16 hex digits) and `component_id`,
    the smallest id reachable over links, its own included.

    A null or blank text has fingerprint zero and links like any other. Copies, however many, are one
    fingerprint. Repeated rows are rows each; an empty table gives an empty one; other columns are
    left out, so their names can't clash. Null ids are linked but never a component's name, unless
    the component has no other."""
    rows, _ = written(with_fingerprint(df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")), "t").select("id", "fp"))
    of, _ = written(_of_groups(rows))
    lowest = rows.groupBy("fp").agg(F.min("id").alias("low")).join(of, "fp").groupBy("group").agg(F.min("low").alias("component_id"))
    of_fp = of.join(lowest, "group").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        F.col("id").alias(doc_id), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def firsts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of `df`, with all its columns: that of the smallest id (null is the
    largest), among its rows that of the least fingerprint, and of equal ones any."""
    own = f"_{uuid.uuid4().hex[:8]}"
    rows, _ = written(with_fingerprint(df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")), "t").groupBy("id", "fp").agg(F.count("*").alias("n")))
    first = rows.join(_of_groups(rows), "fp").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "fp", "n")).alias("first")).select("first.*")
    first, _ = written(first.select("id", "fp", "n"))
    marked = with_fingerprint(df, text, own)
    kept = marked.join(first, (marked[own] == first["fp"]) & marked[f"`{doc_id}`"].eqNullSafe(first["id"]), "left_semi")
    if not first.where("n > 1").isEmpty():  # rows that share id and fingerprint
        kept = kept.dropDuplicates([doc_id, own])
    return kept.drop(own)
