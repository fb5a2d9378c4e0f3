"""The driver contract: names, schemas, and every oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from patchweave.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_oracle(spark, name):
    df = entry.queries()[name](spark, SF)
    assert all(kind.split("(")[0] in ("bigint", "int", "double", "string", "boolean") for _, kind in df.dtypes)
    assert df.count() > 0
