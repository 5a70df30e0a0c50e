"""A Spark result against DuckDB's rows for the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def same(spark_df, sql, data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(spark_df.columns)
    assert rows(spark_df.columns, spark_df.collect()) == rows(names, want.fetchall())
