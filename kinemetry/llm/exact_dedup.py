"""Exact dedup by progressive refinement, with DataFrame and SQL functions only.

A row is told from others by the length of its text, then by a hash of the text's first characters,
and only rows that both leave together are hashed in full. Texts never leave the task that reads
them: a fixed-size table of bits says which lengths and which beginnings stand twice, and what is
shuffled is a row's id and hashes. Groups that hold many of all rows are few, so their outcome goes
to every task; the others are joined by their hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinemetry.llm.common import drop_table, written

#: Characters of a text's beginning that the second step hashes.
PREFIX = 256
#: Words of 64 bits in the table that says which classes of rows stand twice (a power of two; 2 MB in
#: every task). Rows that share a class by chance only go one step further than they need to.
WORDS = 1 << 18
#: A group with more than this part of all rows is heavy; there are fewer of them than this number.
HEAVY = 10_000
#: White space that is no single space: only this has to be replaced.
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text, each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _twice(rows: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """One row with `twice`: bits of the classes of `keys` that hold more than one row."""
    spark = rows.sparkSession
    classes = rows.groupBy(F.xxhash64(*keys).bitwiseAND(F.lit(64 * WORDS - 1)).alias("c")).agg(F.sum(weight).alias("n")).where("n > 1")
    words = classes.groupBy((F.shiftright("c", 6)).cast("int").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, int(c & 63))")).alias("bits"))
    every = spark.range(0, WORDS, 1, 8).select(F.col("id").cast("int").alias("k")).join(words, "k", "left")
    one = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("twice"))
    return written(one)[0]


def _marked(twice: str, *keys: str) -> str:
    """Whether the class of `keys` has its bit in the array `twice`."""
    c = f"(xxhash64({', '.join(keys)}) & {64 * WORDS - 1})"
    return f"{twice}[int(shiftright({c}, 6))] & shiftleft(1L, int({c} & 63)) <> 0"


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `df`: its id, the columns named in `carry`, keep_id (the smallest id of the
    rows with an equal text), group_size (long, the number of those rows) and kept (the row stays).

    Texts are equal if they are once each run of ASCII white space is one space; a null text is an
    empty one. One row of each group is kept: that of the smallest id; of several rows with that id
    just one. Rows with a null id come after all others, so one stays (with a null keep_id) only where no
    row of the group has an id. An empty table gives an empty result. Other columns are left out;
    `carry` may name any, and one named keep_id, group_size or kept gives way to the result's."""
    spark = df.sparkSession
    made = ("keep_id", "group_size", "kept")
    own = {c: f"_{uuid.uuid4().hex[:8]}" for c in ("id", "body", "size", "start", "full", "row", "twice")}
    carried = [F.col(f"`{c}`") for c in carry if c != doc_id and c not in made]
    body = df.select(F.col(f"`{doc_id}`").alias(own["id"]), normalised(F.col(f"`{text}`")).alias(own["body"]), *carried)
    start = F.xxhash64(F.substring(own["body"], 1, PREFIX))
    # 1 and 2: lengths, and beginnings of the rows whose length stands twice
    short = body.select(F.octet_length(own["body"]).alias("size"), start.alias("start")).groupBy("size", "start").agg(F.count("*").alias("n"))
    short, path = written(short)
    by_size = _twice(short, ["size"], F.col("n"))
    like = short.withColumn("twice", by_size.select("twice").scalar()).where(F.expr(_marked("twice", "size")))
    by_start = _twice(like, ["size", "start"], F.col("n"))
    drop_table(spark, path)
    # 3: the whole text, only where both stand twice
    third = body.select("*", F.octet_length(own["body"]).alias(own["size"]), start.alias(own["start"])).withColumn(own["twice"], by_start.select("twice").scalar())
    full = F.when(F.expr(_marked(own["twice"], own["size"], own["start"])), F.unhex(F.sha2(own["body"], 256)))
    rows, _ = written(third.select(own["id"], *carried, full.alias(own["full"]), F.monotonically_increasing_id().alias(own["row"])))
    first = F.min(F.struct(F.col(own["id"]).isNull().alias("none"), F.col(own["id"]).alias("id"), F.col(own["row"]).alias("row"))).alias("first")
    groups, _ = written(rows.where(F.col(own["full"]).isNotNull()).groupBy(own["full"]).agg(first, F.count("*").alias("n")).where("n > 1"))
    most = F.lit(rows.count() / HEAVY)
    heavy, light = groups.where(F.col("n") > most), groups.where(F.col("n") <= most)
    with_heavy = rows.join(F.broadcast(heavy), own["full"], "left")
    # what has no group, or has one by now, takes no part in the shuffle
    settled = with_heavy.where(F.col(own["full"]).isNull() | F.col("n").isNotNull())
    rest = with_heavy.where(F.col(own["full"]).isNotNull() & F.col("n").isNull()).drop("first", "n").join(light, own["full"], "left")
    alone = F.col("n").isNull()
    return settled.unionByName(rest).select(
        F.col(own["id"]).alias(doc_id), *carried, F.when(alone, F.col(own["id"])).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("first.row") == F.col(own["row"]))).alias("kept"))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that stay, with all their columns: one of each group of equal texts (see
    `classes`). Columns named keep_id, group_size or kept are left out."""
    every = classes(df, doc_id, text, tuple(df.columns))
    return every.where("kept").select(*[F.col(f"`{c}`") for c in df.columns if c not in ("keep_id", "group_size", "kept")])
