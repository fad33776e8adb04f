"""The queries that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from lumenstrata.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_suffix_dedup"])
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = queries.queries()[name](spark, SF), db.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.project(", ".join(columns)).fetchall())
