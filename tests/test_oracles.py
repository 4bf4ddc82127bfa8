"""Every registered query of the core against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from corpuskit.plans import registry
from tests.conftest import SF


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def text(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, db, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in frame.collect())
    result = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
