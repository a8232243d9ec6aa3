"""Comparison of a Spark result with SQL over the same tables."""

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def tables(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        p = os.path.join(sf, f)
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def same_rows(df, sql, con):
    cols = sorted(df.columns)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert have == want
