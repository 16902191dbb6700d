"""A query's rows against its SQL's, in DuckDB over the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, folder):
    con = duckdb.connect()
    for name in TABLES:
        if Path(folder, f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return names, found.fetchall()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(row[k]) for k in order) for row in rows)


def assert_same(df, sql, folder):
    names, rows = sql_rows(sql, folder)
    assert sorted(df.columns) == sorted(names)
    got, want = bag(df.columns, [tuple(r) for r in df.collect()]), bag(names, rows)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(want.values())
