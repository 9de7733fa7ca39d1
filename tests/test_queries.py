"""Every query that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from pathloom.jobs import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA:
            return "null"
        if isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "") == "b":
            return str(bool(v))
        return f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert set(got.columns) == set(want.columns)
    assert canonical(got) == canonical(want)


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
