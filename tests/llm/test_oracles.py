"""The corpus queries that SQL can express, against it."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from weftline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_the_oracle(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    wanted = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, wanted.fetchall()))
