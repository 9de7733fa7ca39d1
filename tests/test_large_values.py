"""Queries against their SQL on tables whose keys and sizes go beyond those of the given ones."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from test_queries import canonical

from pathloom.jobs import catalog


def both(spark, path, name: str) -> tuple[list, list]:
    con = duckdb.connect()
    for p in glob.glob(f"{path}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return canonical(catalog.queries()[name](spark, str(path)).toPandas()), canonical(con.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["same_shapes", "unique_contours"])
def test_rings_with_ids_above_a_million(spark, tmp_path, name):
    duckdb.sql(f"copy (select r + (r // 60) * 999900 AS p_partkey, (1 + r % 50)::INT AS p_size from range(120) t(r)) to '{tmp_path}/part.parquet'")
    got, want = both(spark, tmp_path, name)
    assert got == want


def test_images_of_many_rows(spark, tmp_path):
    duckdb.sql(f"copy (select r AS vec_id, 3 AS label, [-0.3, 0.4]::FLOAT[] AS embedding from range(12000) t(r)) to '{tmp_path}/embeddings.parquet'")
    got, want = both(spark, tmp_path, "scan_positions")
    assert len(got) == 4800 and got == want
