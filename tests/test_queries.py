"""Every query over the reference's operators against its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.001"


def plain(x):
    """A value that compares across engines."""
    if isinstance(x, float):
        return f"{x + 0.0:.6f}"
    if hasattr(x, "asDict"):
        return tuple(map(plain, x))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_rows_equal_the_oracle(spark, db, name):
    found = registry.queries()[name](spark, SF)
    wanted = db.execute(registry.oracles()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    rows = wanted.fetchall()
    assert sorted(tuple(map(plain, r)) for r in found.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in rows)
