"""Ramps from the edge of ink: against a plain search, in work that grows with the pixels."""

from __future__ import annotations

import math
import random

from pathloom.operators import raster


def test_ramp_is_that_of_a_plain_search_and_linear(spark):
    rng = random.Random(3)
    ink = {(g, y, x): int(rng.random() < 0.8) for g in (0, 1) for y in range(12) for x in range(9) if rng.random() < 0.97 or (y, x) == (11, 8)}
    df = raster.edge_ramp(spark.createDataFrame([(*k, v) for k, v in ink.items()], "image_id long, y long, x int, ink int"), 0.45, 10.0, 8.0)
    plan = df._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "explode" not in plan  # a frame read anew for every pixel, a row for each pixel in reach
    got = {(r["image_id"], r["y"], r["x"]): r["ramp"] for r in df.collect()}

    def plain(g, y, x):
        best = (math.inf, 0.0)
        for u in range(x - 6, x + 7):
            if -1 <= u <= 9:
                gaps = [v for v in range(-1, 13) if v in (-1, 12) or ink.get((g, v, u)) == 0] if (g, y, u) in ink else [y]
                dx, dy = abs(u - x) / 10.0, min(abs(v - y) for v in gaps) / 8.0
                away = math.hypot(dx, dy)
                inside = min(0.05 / dx if dx else math.inf, 0.0625 / dy if dy else math.inf, 1.0)
                best = min(best, (round(away, 9), away * (1.0 - inside)))
        return min(best[1] / 0.45, 1.0)

    assert set(got) == {k for k, v in ink.items() if v}
    assert all(abs(v - plain(*k)) < 1e-9 for k, v in got.items())
