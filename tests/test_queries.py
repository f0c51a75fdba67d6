"""Every registered query of the reference's operators against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from corpusloom.plans import registry

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


def rows(df, columns):
    same = lambda x: str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(same(x) for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 0
