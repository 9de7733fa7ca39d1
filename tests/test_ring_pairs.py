"""Rings that meet are judged in their tasks: against the rows of pairs of large rings, and in blocks."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pathloom.functions import ring_pairs
from pathloom.operators import spatial

RING = "geom_id int, ring_id long, seq int, x double, y double"
SQUARE = [(-1, -1), (1, -1), (1, 1), (-1, 1)]


def _stars(seed: int, count: int) -> list[tuple]:
    """Star-shaped rings of 3 to 9 corners round a few middles, both ways round, some of them equal."""
    rng, rows, shape = random.Random(seed), [], []
    for r in range(count):
        if r % 7 or not shape:
            n, mx, my, size = rng.randint(3, 9), rng.choice((0, 0, 3, 8)), rng.choice((0, 2)), rng.choice((1, 2, 4, 7))
            shape = [(mx + math.cos(k * math.tau / n) * size * (q := rng.uniform(0.5, 1)), my + math.sin(k * math.tau / n) * size * q) for k in range(n)][:: rng.choice((1, -1))]
        rows += [(r % 2, r, k, *p) for k, p in enumerate(shape)]
    return rows


def _rows(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("large", [6, 64])
def test_pairs_judged_in_blocks_are_those_of_rows(spark, monkeypatch, large):
    rings = spark.createDataFrame(_stars(5, 60), RING)
    monkeypatch.setattr(spatial, "ROW_EDGES", large)
    monkeypatch.setattr(spatial, "BLOCK", 9)
    monkeypatch.setattr(spatial, "PAIR_BLOCK", 9)
    monkeypatch.setattr(ring_pairs, "TILE", 50)
    pairs = spatial.containers(rings).groupBy("geom_id", "ring_id").agg(F.count(F.lit(1)).alias("depth"), F.min_by("container", F.struct("container_area", "container")).alias("parent"))
    found = _rows(spatial.contained(rings), "geom_id", "ring_id", "depth", "parent")
    assert found == _rows(pairs, "geom_id", "ring_id", "depth", "parent") and len(found) > 10
    found = _rows(spatial.overlapping(rings, 0.5), "geom_id", "ring_id", "other", "area")
    assert found == _rows(spatial.overlap_areas(rings, spatial.box_pairs(rings)).filter("area > 0.5"), "geom_id", "ring_id", "other", "area") and len(found) > 50
    every = rings.select("geom_id", "ring_id").distinct()
    found = _rows(spatial.enclosed(rings), "geom_id", "ring_id", "container")
    assert found == _rows(spatial._enclosed(rings, every), "geom_id", "ring_id", "container") and found
    found = _rows(spatial.boundary_distances(rings, 0.7), "geom_id", "ring_id", "other", "distance")
    assert found == _rows(spatial._large_distances(rings, 0.7, every), "geom_id", "ring_id", "other", "distance") and found


def test_no_row_is_made_for_a_pair_of_small_rings(spark, monkeypatch):
    rows = [(0, r, k, x * (1.0 + r), y * (1.0 + r)) for r in range(300) for k, (x, y) in enumerate(SQUARE)]
    rings = spark.createDataFrame(rows, RING)
    for name in ("in_own_ring", "box_pairs", "crossing_edges"):
        monkeypatch.setattr(spatial, name, lambda *a, **k: pytest.fail("a row for each pair"))
    tree = {r["ring_id"]: (r["depth"], r["parent"]) for r in spatial.hierarchy(rings).collect()}
    assert tree == {r: (299 - r, r + 1 if r < 299 else None) for r in range(300)}
    assert spatial.enclosed(rings).count() == 300 * 299 // 2
    assert spatial.overlapping(rings, 1.0).agg(F.sum("area")).first()[0] == sum(4.0 * (1 + r) ** 2 * (299 - r) for r in range(300))
    assert spatial.boundary_distances(rings, 1.5).count() == 299


def test_hits_of_rays_are_not_sorted(spark, monkeypatch):
    rows = [(0, r, k, x * (1.0 + r), y * (1.0 + r)) for r in range(20) for k, (x, y) in enumerate(SQUARE)]
    rays = spark.createDataFrame([(5, 0, 0.0, 0.0, 1.0, 0.25), (6, 0, 30.0, 3.0, -1.0, 0.0)], "ray_id long, geom_id int, x double, y double, dx double, dy double")
    plans, keep = [], spatial.saved
    monkeypatch.setattr(spatial, "saved", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    got = {r["ray_id"]: (r["ring_id"], r["hx"], r["hy"]) for r in spatial.ray_hits(rays, spark.createDataFrame(rows, RING)).collect()}
    assert got == {5: (0, 1.0, 0.25), 6: (19, 20.0, 3.0)}
    assert plans and all("SortAggregate" not in p for p in plans)


@pytest.mark.parametrize("large", [6, 64])
def test_parts_meet_their_sheets_only(spark, monkeypatch, large):
    rings = spark.createDataFrame(_stars(8, 60), RING)
    monkeypatch.setattr(spatial, "ROW_EDGES", large)
    for name in ("crossings", "crossing_edges"):
        monkeypatch.setattr(spatial, name, lambda *a, **k: pytest.fail("all pairs of a geometry"))
    a = rings.select("geom_id", "ring_id").distinct()
    placed = a.join(a.toDF("geom_id", "sheet"), "geom_id").filter("ring_id <> sheet")
    got = _rows(spatial.within_sheets(rings, placed), "geom_id", "ring_id", "sheet")
    monkeypatch.undo()
    cross = {(r["ring_id"], r["other"]) for r in spatial.crossings(rings).collect()}
    held = spatial.in_own_ring(placed.join(rings, ["geom_id", "ring_id"]).select("geom_id", F.col("ring_id").alias("part"), F.col("sheet").alias("ring_id"), "seq", "x", "y"), spatial.ring_edges(rings, "geom_id"), "part", "seq").filter("on or odd")
    size = {r["ring_id"]: r["n"] for r in rings.groupBy("ring_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = held.groupBy("geom_id", "part", "ring_id").agg(F.count(F.lit(1)).alias("k")).collect()
    assert got == sorted((r["geom_id"], r["part"], r["ring_id"]) for r in whole if r["k"] == size[r["part"]] and not cross & {(r["part"], r["ring_id"]), (r["ring_id"], r["part"])})
    assert len(got) > 20
