"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from changeloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def test_each_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and registry.FLAGSHIP in registry.queries()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"pagerank_converged"}))
def test_runs(spark, con, name):
    assert registry.queries()[name](spark, SF).count() > 0
