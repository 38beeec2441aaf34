"""The text queries on empty tables, tables with nulls and repeats, and tables with further columns."""

import os

import pytest

import odd_tables as odd
from sparkloom.llm.queries import REGISTRY

pytestmark = pytest.mark.skipif(not os.path.isdir(odd.FOLDER), reason="no test tables here")
QUERIES = REGISTRY.queries


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return {f.__name__: odd.write(spark, str(tmp_path_factory.mktemp(f.__name__)), f) for f in (odd.empty, odd.extra_columns, odd.nulls_and_repeats)}


def found(df):
    return set(map(tuple, df.collect()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, folders, name):
    assert QUERIES[name](spark, folders["empty"]).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_further_columns_change_nothing(spark, folders, name):
    got, want = (QUERIES[name](spark, f) for f in (folders["extra_columns"], odd.FOLDER))
    if name.startswith("p7"):  # items of one length may change places
        assert got.count() == want.count()
    else:
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_nulls_and_repeats(spark, folders):
    for name in QUERIES:
        got = QUERIES[name](spark, folders["nulls_and_repeats"])
        if name in ("p8_found", "p9_found"):
            assert {r for r in found(QUERIES[name](spark, odd.FOLDER))} <= found(got)
        else:
            got.collect()
    texts = spark.read.parquet(f"{folders['nulls_and_repeats']}/documents.parquet").count()
    packed = QUERIES["p7_packed"](spark, folders["nulls_and_repeats"])
    assert packed.where("part = 0").count() == texts
