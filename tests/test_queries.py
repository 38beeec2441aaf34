"""Every query against its SQL on the smallest tables."""

import datetime
import decimal
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {p.partition('.')[0]} AS SELECT * FROM '{FOLDER}/{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v + 0.0, 8))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 8))
    if isinstance(v, datetime.date | datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    want = sql.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).columns == ["dest_peer", "trigger"]
