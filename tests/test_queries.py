"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from larkspur.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def cell(v) -> str:
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "~"
    if isinstance(v, float):
        return f"{v + 0.0:.7g}"
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, oracle, name):
    assert rows(plans.QUERIES[name](spark, DATA).toPandas()) == rows(oracle.sql(plans.SQL[name]).df())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
