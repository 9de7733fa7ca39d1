"""Queries against their SQL on events at the edges of their rules: seams of angles, half turns, discs that just touch a centre."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from pathloom.operators import commands, curves, iterative, structure

WHOLE = [("signup", 3.0, 8), ("view", 0.0, 8), ("click", 9.0, 8), ("x", 0.0, 60)]  # an arc from and to direction pi
BACK = [("x", 0.0, 15), ("signup", 9.0, 20), ("click", 3.0, 20), ("click", 8.0, 20)]  # there and back along x
TOUCH = [("signup", 5.12, 9), ("click", 37.0, 15)]  # ends at an odd whole number, two radii from centres


def both(spark, folder, module, name, jobs):
    rows = [(i, t, v, k) for i, r in enumerate(jobs) for t, v, k in r]
    events = pd.DataFrame([(n, i, t, v, f'{{"k": {k}}}') for n, (i, t, v, k) in enumerate(rows)], columns=["event_id", "user_id", "event_type", "value", "props"])
    events.to_parquet(folder / "events.parquet")
    found = module.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    names = ", ".join(f'"{c}"' for c in found.columns)
    def text(r):  # noqa: E306
        return tuple(None if v is None or v != v else v + 0 if isinstance(v, float) else v for v in r)
    wanted = con.execute(f"SELECT {names} FROM ({module.ORACLE_SQL[name]})").fetchall()
    return sorted(map(repr, map(text, found.collect()))), sorted(map(repr, map(text, wanted)))


@pytest.mark.parametrize(("module", "name", "jobs"), [
    (iterative, "cleared_cells", [[("signup", round(0.07 * i + 0.01, 2), 9), ("click", 37.0, 11 + i % 7 * 2)] for i in range(60)] + [TOUCH]),
    (curves, "blade_offset", [BACK, BACK[:1] + [("signup", 1.0, 20), ("click", 9.0, 20), ("click", 4.0, 20), ("click", 11.0, 20)]]),
    (commands, "job_costing", [WHOLE]),
    (commands, "index_at_time", [WHOLE + [("x", 0.0, 40)]]),
])
def test_query_is_its_sql(spark, tmp_path, module, name, jobs):
    found, wanted = both(spark, tmp_path, module, name, jobs)
    assert found == wanted and found


@pytest.mark.parametrize("name", ["path_meetings", "path_self_crossings"])
def test_pieces_of_paths_are_made_once(spark, tmp_path, name):
    """The pairs read saved pieces, whose size is known, and not plans of their windows."""
    jobs = [[("signup", 1.0, 10), ("click", 9.0, 20), ("click", 1.0, 20), ("click", 9.0, 10), ("signup", 5.0, 5), ("click", 5.0, 30)]]
    found, wanted = both(spark, tmp_path, structure, name, jobs)
    assert found == wanted and found
    plan = structure.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Relation") == 2


def test_hulls_keep_large_keys_beside_null(spark):
    big = 2**53 + 1
    rows = [(None, 1.0, 2.0), (None, 3.0, 2.0), (None, 2.0, 5.0), (None, 2.0, 3.0), (big, 1.0, 1.0), (big, 2.0, 2.0), (big, 3.0, 3.0)]
    found = iterative.convex_hulls(spark.createDataFrame(rows, "k long, x double, y double").coalesce(1), "k").collect()
    assert sorted((r.k or 0, r.i, r.x, r.y) for r in found) == [(0, 0, 1.0, 2.0), (0, 1, 3.0, 2.0), (0, 2, 2.0, 5.0), (big, 0, 1.0, 1.0), (big, 1, 3.0, 3.0)]
