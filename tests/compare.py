"""Side-by-side comparison of a query with its SQL form, insensitive to row and column order."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    db = duckdb.connect()
    db.sql("set timezone = 'UTC'")
    for t in TABLES:
        db.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return db


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())


def duck_rows(db, sql):
    found = db.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    return names, sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
