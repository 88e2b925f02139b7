"""Every registered query with SQL equals DuckDB's answer on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from quillspan.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in df.collect())
    answer = duck.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in answer.fetchall())
    assert got == want
