"""Spark results against DuckDB on the same tables."""

import math
import os

import duckdb


def tables(folder):
    found = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        found.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{source}'")
    return found


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in data)


def same(df, sql, db):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    db.execute(sql)
    names = [d[0] for d in db.description]
    assert sorted(names) == sorted(df.columns)
    wanted = rows(names, db.fetchall())
    assert len(got) == len(wanted)
    assert got == wanted
