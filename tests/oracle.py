"""Compares a query with its SQL, as the driver does."""

import datetime
import decimal
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def connect(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


def assert_same(spark, con, sf, name, query, sql):
    df = query(spark, sf)
    columns = sorted(df.columns)
    mine = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    found = con.execute(sql)
    named = [d[0] for d in found.description]
    assert sorted(named) == columns, name
    at = [named.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr), name
