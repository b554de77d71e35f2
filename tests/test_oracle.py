"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from sweepflow.jobs import queries as jobs

SF = "/root/testdata/sf0.001"


def shown(value) -> str:
    """A value as text, numbers of any type alike."""
    if not isinstance(value, str) and pd.isna(value):
        return "null"
    return value if isinstance(value, str) else f"{round(float(value), 5) + 0.0:.5f}"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(jobs.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = jobs.queries()[name](spark, SF).toPandas(), duck.sql(jobs.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
