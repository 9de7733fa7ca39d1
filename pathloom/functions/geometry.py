"""Column expressions of plane geometry: angles, arcs, curves, segments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances.
GAP_CLOSE, COLLINEAR, INTERSECT = 1e-6, 1e-9, 1e-12
TAU = 2 * math.pi


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def turn(angle: Column) -> Column:
    """An angle brought into [0, 2 pi)."""
    return F.pmod(angle, F.lit(TAU))


def arc_sweep(start: Column, end: Column, cw: Column) -> Column:
    """Signed sweep between two directions; equal ones are a full circle, also where one is given as -pi and one as pi."""
    d = end - start
    full = F.when(cw, F.lit(-TAU)).otherwise(F.lit(TAU))
    back = F.when(d > COLLINEAR, d - TAU).otherwise(d)
    ahead = F.when(d < -COLLINEAR, d + TAU).otherwise(d)
    return F.when((F.abs(d) < COLLINEAR) | (F.abs(d) > TAU - COLLINEAR), full).when(cw, back).otherwise(ahead)


def arc_length(px: Column, py: Column, x: Column, y: Column, ci: Column, cj: Column, cw: Column) -> Column:
    radius = hypot(ci, cj)
    sweep = arc_sweep(F.atan2(-cj, -ci), F.atan2(y - py - cj, x - px - ci), cw)
    return F.when(radius < 1e-9, F.lit(0.0)).otherwise(F.abs(sweep) * radius)


def between(target: float, start: Column, end: Column, cw: Column) -> Column:
    """Does the arc from ``start`` to ``end`` pass the direction ``target``? Ends count."""
    t, s, e = F.lit(target % TAU), turn(start), turn(end)
    clockwise = F.when(s < e, (t <= s) | (t >= e)).otherwise((e <= t) & (t <= s))
    counter = F.when(s > e, (t >= s) | (t <= e)).otherwise((s <= t) & (t <= e))
    return F.when(cw, clockwise).otherwise(counter)


def arc_box(px: Column, py: Column, x: Column, y: Column, ci: Column, cj: Column, cw: Column) -> tuple[Column, Column, Column, Column]:
    """Bounds of an arc: its ends and those of the four extreme directions that it passes."""
    cx, cy, r = px + ci, py + cj, hypot(ci, cj)
    s, e = F.atan2(py - cy, px - cx), F.atan2(y - cy, x - cx)
    def pick(a, b, t, far, f):  # noqa: E306
        return F.when(between(t, s, e, cw), f(a, b, far)).otherwise(f(a, b))
    return (
        pick(px, x, math.pi, cx - r, F.least), pick(py, y, 3 * math.pi / 2, cy - r, F.least),
        pick(px, x, 0.0, cx + r, F.greatest), pick(py, y, math.pi / 2, cy + r, F.greatest),
    )


def bezier_at(p0: Column, c1: Column, c2: Column, p1: Column, t: Column) -> Column:
    u = F.lit(1.0) - t
    return u * u * u * p0 + F.lit(3.0) * u * u * t * c1 + F.lit(3.0) * u * t * t * c2 + t * t * t * p1


def bezier_steps(x0, y0, c1x, c1y, c2x, c2y, x1, y1) -> Column:
    """Chords for a length: about 0.1 of the control polygon each, two at least."""
    rough = hypot(c1x - x0, c1y - y0) + hypot(c2x - c1x, c2y - c1y) + hypot(x1 - c2x, y1 - c2y)
    return F.greatest(F.ceil(rough / 0.1), F.lit(2)).cast("int")


def bezier_chords(tolerance: float, *axes: tuple) -> Column:
    """Chords of even steps that stay within ``tolerance`` of a cubic: its second derivative is at most six times the larger
    second difference of its points, and a chord of 1/n of the way strays by an eighth of that over n squared. ``axes`` are
    (start, control, control, end) for each coordinate."""
    bend = lambda i: F.sqrt(sum((p[i] - F.lit(2.0) * p[i + 1] + p[i + 2]) * (p[i] - F.lit(2.0) * p[i + 1] + p[i + 2]) for p in axes))
    return F.greatest(F.ceil(F.sqrt(F.greatest(bend(0), bend(1)) * (0.75 / tolerance))), F.lit(1)).cast("int")


def bezier_length(steps: Column, x0, y0, c1x, c1y, c2x, c2y, x1, y1) -> Column:
    """Length by ``steps`` chords; ``steps`` and the points should be plain columns, as they are used for every chord."""
    def add(acc, i):  # noqa: E306
        t = i / steps
        x, y = bezier_at(x0, c1x, c2x, x1, t), bezier_at(y0, c1y, c2y, y1, t)
        return F.struct(x.alias("x"), y.alias("y"), (acc["d"] + hypot(x - acc["x"], y - acc["y"])).alias("d"))
    start = F.struct(x0.alias("x"), y0.alias("y"), F.lit(0.0).alias("d"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, add, lambda acc: acc["d"])


def on_segment(px, py, ax, ay, bx, by) -> tuple[Column, Column, Column, Column]:
    """Closest point of a segment: (t, x, y, squared distance); a point-like segment gives t = 0."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n < 1e-18, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(n, F.lit(0.0)))))
    x, y = ax + t * dx, ay + t * dy
    return t, x, y, (px - x) * (px - x) + (py - y) * (py - y)


def shoelace(x, y, nx, ny) -> Column:
    return x * ny - nx * y
