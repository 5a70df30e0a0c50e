"""Language identification by character language models.

For every language an interpolated Kneser-Ney model over the last `ORDER` letters is estimated.
The n-grams of all languages lie in one sorted key array per order, with a column of natural
logarithms per language, so that one binary search serves all models. A text goes to the
language of least cross-entropy per letter (ties: the first name), and is marked `rejected`
where that entropy lies above a limit calibrated on texts that were not counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinemetry.llm.common import blocks, chosen

ORDER = 4
#: Bounds of the sample that the models are fitted on: documents of a language, letters of one.
DOCS_PER_LANGUAGE, LETTERS_PER_DOC = 600, 20_000
#: Of 5 sampled documents, one is not counted but calibrates the rejection.
CALIBRATE_ONE_IN = 5
WINDOW = 100
#: Mean and deviation of the entropy of windows, and that of shuffled letters, of a language of whose
#: texts none is left to calibrate on.
UNCALIBRATED = (3.0, 1.0, 8.0)
#: Letters of a language's calibration texts that are shuffled to stand for noise.
SHUFFLED = 20_000
#: Parts of a language that are ranked apart, each count dividing the one before, down to the whole: one language may
#: hold most rows, and no later step ranks more than 16 parts' rows in one task.
PARTS = (256, 16, 1)
BITS, BLOCK = 12, 250_000
SPACE = 32


@cache
def _symbols() -> np.ndarray:
    """A 12-bit symbol for every code point: its lower case if a letter, else 0."""
    out = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = ord(s.lower()[0])
            out[c] = low if low < 2048 else 2048 + (low * 2654435761 >> 8) % 2048
    return out


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts one after another, and where each begins (one more at the end).

    Each run of other characters is one space; a text begins with one. Texts without letters
    are empty."""
    joined = "\x00".join(texts) + "\x00"  # a break that no letter run crosses
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _symbols()[code]
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate(([True], sym[:-1] != 0))
    first[ends[:-1]] = True  # a text's own first place
    begin = np.concatenate(([0], ends[:-1]))
    keep = sym != 0
    # a space before each run of letters stands for whatever lies between two runs
    lead = keep & first
    put = np.cumsum(keep.astype(np.int64) + lead)
    out = np.full(put[-1] if len(put) else 0, SPACE, np.uint16)
    out[put[keep] - 1] = sym[keep]
    at = np.concatenate((np.where(begin > 0, put[begin - 1], 0), put[-1:]))
    return out, at


def _keys(sym: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each place; -1 where it would reach over its text's start."""
    key = np.zeros(len(sym), np.int64)
    for back in range(n - 1, -1, -1):
        key <<= BITS
        key[back:] |= sym[: len(sym) - back]
    if n > 1:
        for k in range(n - 1):
            bad = at[:-1] + k
            key[bad[bad < at[1:]]] = -1
    return key


@dataclass
class Models:
    """Sorted n-gram keys per order, with columns per language: log probability, log back-off."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    floor: np.ndarray
    mean: np.ndarray | None = None
    sd: np.ndarray | None = None
    shuffled: np.ndarray | None = None

    def _find(self, n: int, key: np.ndarray) -> np.ndarray:
        own = self.keys[n - 1]
        i = np.minimum(np.searchsorted(own, key), len(own) - 1)
        return np.where(own[i] == key, i, -1)

    def letters(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of every letter, a column per language."""
        out = np.zeros((len(sym), len(self.languages)), np.float32)
        left = np.arange(len(sym))
        for n in range(ORDER, 0, -1):
            key = _keys(sym, at, n)[left]
            i = self._find(n, key)
            hit = i >= 0
            out[left[hit]] += self.logp[n - 1][i[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                return out
            if n > 1:
                ctx = np.where(key >= 0, self._find(n - 1, key >> BITS), -1)
                out[left[ctx >= 0]] += self.back[n - 2][ctx[ctx >= 0]]
        out[left] += self.floor
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per letter (spaces included) of each text under each language, and its letters."""
        if not texts:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        sym, at = _letters(texts)
        n = np.diff(at)
        if not len(sym):
            return np.zeros((len(texts), len(self.languages))), n
        total = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(self.letters(sym, at), axis=0, dtype=np.float64)))
        return (total[at[:-1]] - total[at[1:]]) / np.maximum(n, 1)[:, None], n

    def limit(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The entropy from which a text of n letters is rejected in its best language: four
        window deviations above the calibrated mean, and at least nine tenths of the way to shuffled
        letters."""
        wide = self.mean[best] + 4 * self.sd[best] * np.sqrt(np.maximum(1.0, WINDOW / np.maximum(n, 1)))
        return np.maximum(wide, 0.1 * self.mean[best] + 0.9 * self.shuffled[best])


#: What is known where nothing can be learned.
NONE = Models([], [], [], [], np.zeros(0))


def _kneser_ney(languages: list[str], counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]) -> Models:
    """Interpolated Kneser-Ney models from the counts of the ORDER-grams and of shorter starts."""
    alphabet = np.unique(np.concatenate([key & ((1 << BITS) - 1) for key, _ in counts.values()]))
    uniform = 1.0 / (len(alphabet) + 1)
    own: list[list[dict]] = []
    for x in languages:
        grams: list = [None] * ORDER
        grams[-1] = counts.get((x, ORDER), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        for n in range(ORDER - 1, 0, -1):  # how many different letters stand before each
            longer = grams[n][0] & ((1 << BITS * n) - 1)
            first, count = counts.get((x, n), (np.zeros(0, np.int64),) * 2)
            key, where = np.unique(np.concatenate((longer, first)), return_inverse=True)
            grams[n - 1] = key, np.bincount(where[: len(longer)], minlength=len(key)).clip(1)
        lower, levels = None, []
        for n in range(1, ORDER + 1):
            key, count = grams[n - 1]
            ones, twos = (count == 1).sum(), (count == 2).sum()
            d = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))
            ctx, where = np.unique(key >> BITS, return_inverse=True)
            total = np.bincount(where, count, len(ctx))
            kinds = np.bincount(where, minlength=len(ctx))
            rest = d * kinds / np.maximum(total, 1)
            under = uniform if n == 1 else lower[1][np.searchsorted(lower[0], key & ((1 << BITS * (n - 1)) - 1))]
            lower = key, (count - d) / np.maximum(total[where], 1) + rest[where] * under
            levels.append({"key": key, "p": lower[1], "ctx": ctx, "rest": rest})
        own.append(levels)
    keys, logp, back = [], [], []
    floor = np.array([np.log((x[0]["rest"][0] if len(x[0]["rest"]) else 1.0) * uniform) for x in own], np.float32)
    for n in range(1, ORDER + 1):
        ctx = [x[n]["ctx"] for x in own] if n < ORDER else []
        key = np.unique(np.concatenate([x[n - 1]["key"] for x in own] + ctx))
        p, b = np.zeros((len(key), len(own)), np.float32), np.zeros((len(key), len(own)), np.float32)
        for j, x in enumerate(own):
            have, level = np.isin(key, x[n - 1]["key"], assume_unique=True), x[n - 1]
            p[have, j] = np.log(level["p"])
            rest = key[~have]
            if n == 1:
                p[~have, j] = floor[j]
            elif len(rest):  # another language's n-gram: this one backs off
                c = np.searchsorted(level["ctx"], rest >> BITS).clip(max=max(len(level["ctx"]) - 1, 0))
                seen = (level["ctx"][c] == rest >> BITS) if len(level["ctx"]) else np.zeros(len(rest), bool)
                less = rest & ((1 << BITS * (n - 1)) - 1)
                i = np.minimum(np.searchsorted(keys[-1], less), len(keys[-1]) - 1)
                low = np.where(keys[-1][i] == less, logp[-1][i, j], floor[j])
                p[~have, j] = low + np.where(seen, np.log(level["rest"][c]) if len(level["ctx"]) else 0.0, 0.0)
            if n < ORDER and len(x[n]["ctx"]):
                b[np.searchsorted(key, x[n]["ctx"]), j] = np.log(x[n]["rest"])
        keys.append(key), logp.append(p), back.append(b)
    return Models(languages, keys, logp, back, floor)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            sym, at = _letters([t for x, t in zip(langs, texts, strict=True) if x == lang])
            for n in range(1, ORDER + 1):
                key = _keys(sym, at, n)
                if n < ORDER:  # shorter ones only where a text begins; the rest follow from the longest
                    starts = at[:-1][np.diff(at) >= n] + n - 1
                    key = key[starts]
                key, count = np.unique(key[key >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), n, np.int32)), pa.array(key), pa.array(count.astype(np.int64))],
                    names=["lang", "n", "key", "count"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Models:
    """Models from a bounded sample: per language the `docs_per_language` different texts of least
    hash among those of 1 to LETTERS_PER_DOC characters. Rows with a null text or language don't count.

    Of a language with fewer than CALIBRATE_ONE_IN such texts all are counted. If no row can be learned
    from, the models know no language, and every text is `und`."""
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where(
        f"lang is not null and text is not null and length(text) between 1 and {LETTERS_PER_DOC}"
    ).withColumn("h", F.xxhash64("text"))
    least = rows.select("lang", "h").distinct()
    # a language's least hashes are among the least of each of its parts, and those are a bounded number of rows
    for parts in PARTS:
        rank = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(parts))).orderBy("h"))
        least = least.withColumn("r", rank).where(F.col("r") <= docs_per_language).drop("r")
    most = {r.lang: (r.h, r.n) for r in least.groupBy("lang").agg(F.max("h").alias("h"), F.count("*").alias("n")).collect()}
    if not most:
        return NONE
    bound, texts = (F.element_at(F.create_map(*[F.lit(x) for k, v in most.items() for x in (k, v[i])]), F.col("lang")) for i in (0, 1))
    sample = rows.where(F.col("h") <= bound).dropDuplicates(["lang", "h"])
    fold = F.when(texts < CALIBRATE_ONE_IN, 1).otherwise(F.pmod(F.xxhash64("h"), F.lit(CALIBRATE_ONE_IN)))
    found = (sample.where(fold != 0).select("lang", "text")
             .mapInArrow(_counted, "lang string, n int, key long, count long")
             .groupBy("lang", "n", "key").agg(F.sum("count").alias("count")).toArrow().to_pandas())
    if found.empty:
        return NONE
    counts = {}
    for (x, n), part in found.groupby(["lang", "n"]):
        part = part.sort_values("key")
        counts[x, n] = part["key"].to_numpy(np.int64), part["count"].to_numpy(np.int64)
    models = _kneser_ney(sorted({x for x, _ in counts}), counts)
    held = sample.where(fold == 0).select("lang", "text").toArrow().to_pydict()
    mix = np.random.default_rng(0)
    mean, sd, mixed = [], [], []
    for j, x in enumerate(models.languages):
        texts = [t for k, t in zip(held["lang"], held["text"], strict=True) if k == x]
        windows = [w for t in texts for i in range(0, len(t), WINDOW) if len(w := t[i : i + WINDOW]) == WINDOW]
        h, n = models.entropy(windows) if windows else (np.zeros((0, len(models.languages))), np.zeros(0))
        h = h[n > WINDOW // 4, j]
        shuffled, _ = models.entropy(["".join(mix.permutation(list("".join(windows)[:SHUFFLED])))] if windows else [])
        mean.append(h.mean() if len(h) else UNCALIBRATED[0]), sd.append(h.std() if len(h) else UNCALIBRATED[1])
        mixed.append(shuffled[0, j] if len(shuffled) else UNCALIBRATED[2])
    models.mean, models.sd, models.shuffled = map(np.array, (mean, sd, mixed))
    return models


RESULT = "struct<lang_pred:string,score:double,cross_entropy:double,rejected:boolean>"


def label(models: Models, texts: list[str | None]) -> pa.StructArray:
    """Language, score and verdict of each text (see `predict`)."""
    lang, score, nats, out = [], [], [], []
    full = [t or "" for t in texts]
    if models is not None and not models.languages:
        lang, score, nats, out = ["und"] * len(full), [0.0] * len(full), [None] * len(full), [True] * len(full)
        full = []
    for a, b in blocks(np.array([len(t) + 1 for t in full]), BLOCK):
        h, n = models.entropy(full[a:b])
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        share = np.exp(-(h - low[:, None]) * np.minimum(n, 50)[:, None])
        over = (n == 0) | (low > models.limit(best, n))
        for i in range(b - a):
            lang.append(models.languages[best[i]] if n[i] else "und")
            score.append(float(1 / share[i].sum()) if n[i] else 0.0)
            nats.append(float(low[i]) if n[i] else None)
            out.append(bool(over[i]))
    return pa.StructArray.from_arrays(
        [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(nats, pa.float64()), pa.array(out, pa.bool_())],
        names=["lang_pred", "score", "cross_entropy", "rejected"])


def predict(df: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """`df` with lang_pred, score (0 to 1: the best model's share against the others over at most
    50 letters), cross_entropy (nats per letter) and rejected.

    The whole text counts, in blocks. A null text, an empty one or one without a letter is `und`
    with score 0, and rejected; so is every text if the models know no language. Of equal entropies
    the first name is taken. Repeated rows get equal results, an empty table an empty result;
    input columns of the four names are replaced."""
    held = df.sparkSession.sparkContext.broadcast(models)  # bounded: see fit

    @F.arrow_udf(RESULT)
    def of(texts: pa.Array) -> pa.Array:
        return label(held.value, texts.to_pylist())

    return chosen(df, "language", of(F.col(f"`{text}`")))
