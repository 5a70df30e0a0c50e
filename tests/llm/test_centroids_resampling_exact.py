import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from kinemetry.llm import annulus, exact_dedup, importance, queries

VECTORS = "vec_id long, embedding array<float>, cluster string, v int"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_importance_resampling", "op13_exact_dedup"])
def test_query_is_its_sql(spark, data, name):
    same(queries.queries()[name](spark, data), queries.oracle_sql()[name], data)


def test_annulus_finds_the_nearest_with_ties():
    r = np.random.default_rng(3)
    for k, d, top in ((1, 4, 9), (8, 64, 900), (40, 3, 3), (300, 2, 40), (50, 1, 1)):
        c, x = r.integers(-top, top + 1, (k, d)), r.integers(-top, top + 1, (5000, d))
        far = ((x[:, None] - c[None]) ** 2).sum(-1)
        number, distance, pairs = annulus.nearest(x, c)
        assert (number == far.argmin(1)).all() and (distance == far.min(1)).all() and len(x) <= pairs <= len(x) * k
    c = np.array([[1000 * i, 0] for i in range(200)])
    assert annulus.nearest(c, c)[2] < 2000  # norms far apart: the annulus leaves few
    big = np.array([[annulus.largest(64)] * 64, [-annulus.largest(64)] * 64])
    assert annulus.nearest(big[:1], big[1:])[1][0] == 64 * (2 * annulus.largest(64)) ** 2
    assert annulus.nearest(np.zeros((0, 4), np.int64), np.zeros((2, 4), np.int64))[2] == 0


def lloyd(rows, k, rounds, seed):
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r))
    c = [x for _, x in rows[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    of = lambda x: min((far(x, y), i) for i, y in enumerate(c))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, x in rows:
            by[of(x)[1]].append(x)
        c = [[sum(v) // len(by[i]) for v in zip(*by[i], strict=True)] if by[i] else y for i, y in enumerate(c)]
    return sorted((i, *of(x)) for i, x in rows), c


def test_clustering_is_lloyds_in_whole_numbers(spark):
    r = random.Random(2)
    rows = [(i, [r.choice((-1.0, 0.0, 0.25, 0.5, r.random())) for _ in range(3)], "own", 7) for i in range(400)]
    rows += rows[:20] + [(5, [0.5, 0.5, 0.5], "own", 7)]  # repeated rows, a shared id
    bad = [(900, None, "", 1), (901, [], "", 1), (902, [1.0, 2.0], "", 1), (903, [1.0, None, 2.0], "", 1), (904, [1.0, math.nan, 2.0], "", 1), (905, [1.0, math.inf, 2.0], "", 1), (906, [3e38, 0.0, 0.0], "", 1)]
    df = spark.createDataFrame(rows + bad, VECTORS)
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows]
    for parts, k in ((1, 8), (7, 8), (3, 60)):
        found, centroids = annulus.cluster(df.repartition(parts), k, 10, 3, 3)
        want, c = lloyd(whole, k, 10, 3)
        assert sorted((a.id, a.distance, a.cluster) for a in found.collect()) == want and centroids.tolist() == c
    few, centroids = annulus.cluster(df.where("vec_id between 100 and 102"), 8, 10, 3, 3)
    assert few.count() == 3 and len(centroids) == 3
    none, centroids = annulus.cluster(df.limit(0), 8, 10, 3, 3)
    assert none.count() == 0 and none.columns == ["id", "cluster", "distance"] and len(centroids) == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return [zlib.crc32(" ".join(w[i : i + j]).encode()) for j in range(1, n + 1) for i in range(len(w) - j + 1)], len(w)


def resampled(docs, target, n, buckets, share):
    s, t = Counter(), Counter()
    for x in docs:
        s.update(g % buckets for g in grams(x[1], n)[0])
    for x in target:
        t.update(g % buckets for g in grams(x, n)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        g, words = grams(text, n)
        weight = sum(gain[x % buckets] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    large = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = {id(r): p + 1 for p, r in enumerate(large[: len(large) * share[0] // share[1]])}
    return sorted([(*r, drawn.get(id(r), 0)) for r in rows], key=repr)


def texts():
    r = random.Random(4)
    words = ["a", "The", "house", "é", "中文", "x9", "Zug", "w" * 70, "ab", "cde", "I"]
    some = [" ".join(r.choice(words) for _ in range(r.randrange(60))) + r.choice(["", ".", "\x00", "\n"]) for _ in range(150)]
    return [None, "", " .. ", "a", "\x7f", "é" * 500, "x" * 3000, "a " * 3000, ", ".join(words * 90), "-" * 900, *some, *some[:10]]


@pytest.mark.parametrize(("n", "chunk"), [(1, 1 << 18), (1, 40), (3, 1 << 18), (3, 40), (2, 1)])
def test_resampling_is_brute_forces(spark, n, chunk):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b c " * 9), (3, "b " * 30), (3, "b " * 30)]
    df = spark.createDataFrame([(*x, "mine", 2) for x in rows], "doc_id long, text string, row string, own int").repartition(5)
    target = ["The house the zug", None, "", "中文 cde"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, goal, max_n=n, buckets=97, share=(30, 100), chunk=chunk).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"] or 0) for r in got], key=repr) == resampled(rows, target, n, 97, (30, 100))


def test_resampling_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "w " * 25), (2, None)], df.schema)
    assert importance.resample(df, some).count() == 0
    assert [(r.weight, r["rank"]) for r in importance.resample(some, df, share=(1, 1)).orderBy("doc_id").collect()] == [(math.floor(1000 * math.log(10025 / 26 / 10000)), 1), (0, None)]
    assert [r["rank"] for r in importance.resample(some, df, share=(0, 1)).collect()] == [None, None]


def test_chunks_own_each_word_once():
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice("ab  -é中") for _ in range(r.randrange(200))).encode()
        size, carry = r.randrange(1, 40), r.randrange(3)
        parts, at = list(importance.cuts(text, size, carry)), 0
        for start, end, until in parts:
            assert start == at < until <= end
            after = WORD.findall(text[until:].decode())
            assert WORD.findall(text[start:end].decode()) == WORD.findall(text[start:until].decode()) + after[:carry]
            at = until
        assert at == len(text)


def test_exact_classes_are_brute_forces(spark):
    base = ["same text", "same \t text", "same  text", " same text", "same text ", "", None, "\n", "x" * 5000, "x" * 5000 + "y", "x" * 5000, "é", "é", "p" * 256 + "1", "p" * 256 + "2", "p" * 256 + "1"]
    rows = [(i, t) for i, t in enumerate(base)] + [(None, "same text"), (None, "alone"), (None, "both"), (None, "both"), (1, "same text"), (1, "same text"), (20, "z")]
    df = spark.createDataFrame([(*x, "mine", False) for x in rows], "doc_id long, text string, full string, kept boolean")
    groups = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    want = []
    for t, ids in groups.items():
        first = sorted(ids, key=lambda i: (i is None, i))
        want += [(i, first[0], len(ids), n == 0, "mine") for n, i in enumerate(first)]
    for heavy in (10_000, 1):  # every group heavy; none
        was, exact_dedup.HEAVY = exact_dedup.HEAVY, heavy
        got = exact_dedup.classes(df.repartition(6), carry=("full", "kept", "doc_id")).collect()
        exact_dedup.HEAVY = was
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.full) for r in got), key=repr) == sorted(want, key=repr)
    left = exact_dedup.dedup(df).collect()
    assert Counter(norm(r.text) for r in left) == Counter(groups.keys()) and left[0].full == "mine"
    assert exact_dedup.dedup(df.limit(0)).count() == exact_dedup.classes(df.limit(0)).count() == 0


def test_exact_dedup_keeps_one_of_a_large_group(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy " * 400).otherwise(F.concat(F.lit("copy " * 400), "id")).alias("text"))
    assert exact_dedup.classes(df).where("kept").count() == 4001
    assert {r.group_size for r in exact_dedup.classes(df).where("doc_id % 3 = 0").collect()} == {2000}
