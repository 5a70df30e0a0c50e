"""Target-distribution importance resampling over hashed word n-grams, long texts in overlapping chunks.

Two bags of features, of all documents and of a target, are counted in hash buckets of a fixed
number. A bucket's gain says how much likelier the target holds it; a document's weight is the mean
gain of its features, and a Gumbel term of a hash of its id makes of the highest weights a draw
without replacement.

A text above CHUNK bytes is cut at word boundaries into chunks that are dealt over all tasks. A
chunk owns the words that begin in it and carries the n-1 words after them, so that each feature is
counted by the chunk that owns its first word, and by no other; counts and gains are summed by
document."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinemetry.llm.common import blocks, written

#: Bytes of text that a chunk owns, and bytes of text that numpy handles at a time.
CHUNK, BLOCK = 1 << 18, 1 << 21
#: Words of more bytes are hashed one by one.
LONG_WORD = 48
#: Width of the steps of the score's histogram.
STEP = 64
COUNTS = ("n_words", "n_features", "total")
BYTES = np.arange(256)
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
#: Bytes of words: digits, letters, and whatever isn't ASCII.
IN_WORD = (BYTES >= 128) | ((BYTES >= 48) & (BYTES <= 57)) | ((LOWER >= 97) & (LOWER <= 122))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


CRC = _crc_table()


def words_of(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes `data`; a text begins at each place of `first`."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = IN_WORD[data]
    starts = inside[:-1].copy()
    starts[1:] &= ~inside[:-2]
    at = first[first < len(data)]
    starts[at] = inside[at]
    ends = inside[:-1] & ~inside[1:]
    at = at[at > 0]
    ends[at - 1] = inside[at - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _extended(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The inner state of a CRC-32 after the bytes of each word, from the state before them."""
    crc, size = crc.copy(), (ends - starts).astype(np.int16)
    order = np.argsort(size, kind="stable")
    size = size[order]
    for i in range(int(size[-1]) if len(size) else 0):
        now = order[np.searchsorted(size, i, "right") :]  # the words with a byte at place i
        crc[now] = CRC[(crc[now] ^ data[starts[now] + i]) & 0xFF] ^ (crc[now] >> np.uint32(8))
    return crc


def _states(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`_extended`, with the few long words one by one, as each place of the longest is a round."""
    long = np.flatnonzero(ends - starts > LONG_WORD)
    cut = ends.copy()
    cut[long] = starts[long]
    out = _extended(crc, data, starts, cut)
    for i in long:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(data: np.ndarray, first: np.ndarray, own: np.ndarray, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features and the text that each is of, and the words that each text owns.

    A text owns the words that begin in its first `own` bytes; `first` has one more entry than texts."""
    data = LOWER[data]
    starts, ends = words_of(data, first[:-1])
    text = np.searchsorted(first, starts, "right") - 1
    owned = starts - first[text] < own[text]
    crc, found, whose = np.full(len(starts), 0xFFFFFFFF, np.uint32), [], []
    at = np.arange(len(starts))  # the words from which the runs go on, and where each run is now
    for n in range(max_n):
        if n:
            more = at + n < len(starts)
            more[more] = text[at[more] + n] == text[at[more]]
            at, crc = at[more], crc[more]
            crc = CRC[(crc ^ np.uint32(32)) & 0xFF] ^ (crc >> np.uint32(8))
        crc = _states(crc, data, starts[at + n], ends[at + n])
        counted = owned[at]
        found.append((crc[counted] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        whose.append(text[at[counted]])
    return np.concatenate(found), np.concatenate(whose), np.bincount(text[owned], minlength=len(own))


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (a, b, bytes, starts) of the texts a to b, straight from the column's buffers."""
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    for a, b in blocks(np.diff(ends), BLOCK):
        yield a, b, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]


def cuts(text: bytes, size: int, carry: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, end of what it owns) of the chunks of a text: each owns about `size` bytes, up to
    where no word goes on, and carries the next `carry` words."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = words_of(data, np.zeros(1, np.int64))
    at = 0
    while at < len(data):
        until = min(at + size, len(data))
        k = np.searchsorted(starts, until)  # words that begin before here
        if k and ends[k - 1] > until:
            until = int(ends[k - 1])
        last = min(k + carry, len(ends)) - 1
        yield at, max(until, int(ends[last])) if last >= k else until, until
        at = until


def chunks(df: DataFrame, max_n: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Of `df` (doc, text) the texts of at most `size` bytes, and the chunks of the others, dealt over all
    tasks, as (doc, row, text, own): in the first `own` bytes begin the words that a row counts."""
    body = F.coalesce("text", F.lit("")).cast("binary")
    df = df.select("doc", F.monotonically_increasing_id().alias("row"), body.alias("text"))
    few = F.octet_length("text") <= size
    long = df.where(~few)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                text = text.as_py()
                for no, (start, end, until) in enumerate(cuts(text, size, max_n - 1)):
                    more = [pa.array([text[start:end]], pa.binary()), pa.array([until - start], pa.int32()), pa.array([no], pa.int32())]
                    yield pa.RecordBatch.from_arrays([batch["doc"][i : i + 1], batch["row"][i : i + 1], *more], names=["doc", "row", "text", "own", "no"])

    kind = long.select("*", F.lit(0).alias("own"), F.lit(0).alias("no")).schema
    parts, _ = written(long.mapInArrow(cut, kind).repartition("row", "no").drop("no"))
    return df.where(few).withColumn("own", F.octet_length("text")), parts


def _over(of: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes of a function of rows, bytes, starts and owned bytes one of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["own"].to_numpy(zero_copy_only=False)
            for a, b, data, first in _parts(batch["text"]):
                yield from of(batch.slice(a, b - a), data, first, own[a:b])

    return run


def bucket_counts(parts: list[DataFrame], max_n: int, buckets: int) -> DataFrame:
    """(bucket, n) of the features of all rows; a task sends one row for each bucket that it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)

        def add(rows: pa.RecordBatch, data: np.ndarray, first: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            total[:] += np.bincount(features(data, first, own, max_n, buckets)[0], minlength=buckets)
            return iter(())

        for _ in _over(add)(batches):
            pass
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    every = reduce(DataFrame.unionByName, [p.select("text", "own").mapInArrow(count, "bucket int, n long") for p in parts])
    return every.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Per bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), from counts (bucket, n):
    s of S features of the documents, t of T of the target. As many numbers as buckets, at every size."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    found = np.zeros((2, buckets))
    for bucket, s, t in both.collect():  # one row per bucket
        found[:, bucket] = s or 0, t or 0
    (s, t), (all_s, all_t) = found, found.sum(1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weights(parts: DataFrame, gain: np.ndarray, max_n: int) -> DataFrame:
    """(doc, row, n_words, n_features, total) of each row: what it owns, and the sum of the gains."""

    def weigh(rows: pa.RecordBatch, data: np.ndarray, first: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket, whose, words = features(data, first, own, max_n, len(gain))
        order = np.argsort(whose, kind="stable")
        sums = np.concatenate(([0], np.cumsum(gain[bucket[order]])))
        at = np.concatenate(([0], np.cumsum(n := np.bincount(whose, minlength=len(own)))))
        found = [pa.array(x.astype(np.int64)) for x in (words, n, sums[at[1:]] - sums[at[:-1]])]
        yield pa.RecordBatch.from_arrays([rows["doc"], rows["row"], *found], names=["doc", "row", *COUNTS])

    kind = parts.select("doc", "row", *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema
    return parts.mapInArrow(_over(weigh), kind)


def gumbel(doc: str, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))) of the first 32 bits h of sha256 of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """`rows` (doc, score, large, ...) with `rank`: the places 1, 2, 3 ... by score, then id, of the share
    that is drawn from the large rows, else null. No task orders more than its range: a histogram of
    steps of the score, of which there are few at every size, says from which step on rows can be
    drawn; these are sorted by ranges, and the ranges' sizes are added up."""
    step = F.floor(F.col("score") / STEP)
    by_step = {r.s: r.n for r in rows.where("large").groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}  # bounded by the range of scores
    draw, met, least = sum(by_step.values()) * share[0] // share[1], 0, None
    for s in sorted(by_step, reverse=True):
        if met >= draw:
            break
        met, least = met + by_step[s], s
    if least is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    among = F.col("large") & (step >= least)
    keys = [F.desc("score"), F.asc_nulls_last("doc"), F.asc("n_features")]
    best, _ = written(rows.where(among).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()))
    best = best.withColumn("part", F.shiftright("place", 33))
    sizes = best.groupBy("part").agg(F.count("*").alias("n"))  # as many rows as partitions
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + 1
    drawn = best.join(F.broadcast(before), "part").withColumn("rank", F.when(place <= draw, place)).drop("part", "place", "before")
    return drawn.unionByName(rows.where(~among).withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", max_n: int = 1, buckets: int = 10_000,
             seed: int = 2024, least_words: int = 20, share: tuple[int, int] = (10, 100), chunk: int = CHUNK) -> DataFrame:
    """One row per row of `df`: its id, n_words, n_features, weight, score and rank (all long).

    Words are runs of ASCII letters (lower-cased), digits and whatever isn't ASCII; features are all
    runs of 1 to `max_n` words. weight is the floored mean gain of a text's features, 0 without any;
    score adds the Gumbel term of its id. Of the N texts of `least_words` words or more the part
    `share` of N, rounded down, is drawn by score, ties to the smaller id: rank is its place, null for
    the others. A null or empty text has no features. Rows that share an id share its Gumbel term and
    are rows of their own; a null id counts as an empty one and comes last among ties. An empty target
    weighs by rarity alone; an empty table gives an empty result. Other columns are left out."""
    docs = df.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    goal = target.select(F.lit(0).alias("doc"), F.col(f"`{target_text}`").alias("text"))
    short, long = chunks(docs, max_n, chunk)
    gain = gains(bucket_counts([short, long], max_n, buckets), bucket_counts([*chunks(goal, max_n, chunk)], max_n, buckets), buckets)
    whole = weights(long, gain, max_n).groupBy("doc", "row").agg(*[F.sum(c).alias(c) for c in COUNTS])
    every = weights(short, gain, max_n).unionByName(whole)
    weight = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")).cast("long")
    every = every.withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel("doc", seed)).withColumn("large", F.col("n_words") >= least_words)
    rows, _ = written(every.select("doc", "n_words", "n_features", "weight", "score", "large"))
    return ranked(rows, share).select(F.col("doc").alias(doc_id), "n_words", "n_features", "weight", "score", "rank")
