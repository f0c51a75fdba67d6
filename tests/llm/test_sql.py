"""Queries with SQL against DuckDB, and the contracts' columns of the others, at the smallest scale."""

import os
import zlib

import duckdb
import pytest

from corpusloom.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    want, got = con.execute(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, DIR).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name,modulus,rest", [("op1_language_id", 4, 2), ("op10_toxicity", 5, 0)])
def test_held_out(spark, name, modulus, rest):
    got = registry.queries()[name](spark, DIR).collect()
    assert len(got) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1 for r in got)
    if name == "op10_toxicity":
        assert all(r.predicted == int(r.score >= 0.5) for r in got)
