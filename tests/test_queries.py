import glob
import os

import duckdb
import pytest

from eventloom.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert len(set(df.columns)) == len(df.columns)
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in columns) for r in rel.fetchall()), key=str)
    assert got == want
