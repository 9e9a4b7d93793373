import glob
import os

import duckdb
import pytest

from eventloom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == columns
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(tuple(dict(zip(rel.columns, r))[c] for c in columns) for r in rel.fetchall())


def test_one_query_an_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_scratch_is_deleted_at_the_end(tmp_path):
    import pathlib
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession; from eventloom.llm.common import Scratch; "
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', '{tmp_path}').getOrCreate(); "
        "x = Scratch(s, 'a'); assert x.save(s.range(3), 't').count() == 3"
    )
    subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parents[2], check=True, timeout=200, capture_output=True)
    assert not list(tmp_path.glob("eventloom/a-*"))
