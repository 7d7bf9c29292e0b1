"""Every registered query against its DuckDB text on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from freshet import catalog_queries

QUERIES, ORACLES = catalog_queries.queries(), catalog_queries.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dict):
        return tuple(sorted((plain(a), plain(b)) for a, b in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, (bytearray, memoryview)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 300


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted((plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((plain(tuple(r[i] for i in at)) for r in got.fetchall()), key=str)
    assert ours == theirs
