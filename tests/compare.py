"""Spark's rows against DuckDB's for the same tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{data}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
        return repr(x)

    return sorted(columns), sorted(tuple(cell(r[k]) for k in order) for r in rows)


def differences(spark, con, query, sql, data):
    df = query(spark, data)
    ours = normal(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = normal(rel.columns, rel.fetchall())
    if ours == theirs:
        return None
    a, b = set(ours[1]), set(theirs[1])
    return f"columns {ours[0]} {theirs[0]}; rows {len(ours[1])} {len(theirs[1])}; only ours {sorted(a - b)[:3]}; only theirs {sorted(b - a)[:3]}"
