"""Closed rings and vertex paths: measures, corners, resampling, positions along the way.

All take a vertex table ``(geom_id, ring_id, seq, x, y)``; a ring's last vertex joins its first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geometry import COLLINEAR, hypot, on_segment, shoelace
from pathloom.functions.windows import ordered, so_far
from pathloom.operators.commands import rounded
from pathloom.sources.derive import cte, table

x, y = "x", "y"


def _ring(rings: DataFrame) -> list[str]:
    """The key of a ring: ids may repeat between geometries."""
    return [c for c in ("geom_id", "ring_id") if c in rings.columns]


def _whole(rings: DataFrame):
    return Window.partitionBy(*_ring(rings)).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def edges(rings: DataFrame) -> DataFrame:
    """Each vertex with the next one around its ring, ``nx, ny``, and the one after that, ``mx, my``."""
    w, whole = ordered(*_ring(rings)), _whole(rings)
    rows = rings.withColumn("__n", F.count(F.lit(1)).over(whole)).withColumn("__i", F.row_number().over(w))
    first = {c: F.first(c).over(whole) for c in (x, y)}
    second = {c: F.coalesce(F.nth_value(c, 2).over(whole), F.first(c).over(whole)) for c in (x, y)}
    last_but = F.col("__i") == F.col("__n") - 1
    out = rows.select(
        "*", F.coalesce(F.lead(x).over(w), first[x]).alias("nx"), F.coalesce(F.lead(y).over(w), first[y]).alias("ny"),
        F.coalesce(F.lead(x, 2).over(w), F.when(last_but, first[x]).otherwise(second[x])).alias("mx"),
        F.coalesce(F.lead(y, 2).over(w), F.when(last_but, first[y]).otherwise(second[y])).alias("my"),
    )
    return out.drop("__n", "__i")


def ring_measures(rings: DataFrame) -> DataFrame:
    """Area, winding, perimeter, bounds, centroids and convexity of every ring: one window and one aggregate."""
    cross = shoelace(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    bend = (F.col("nx") - F.col("x")) * (F.col("my") - F.col("ny")) - (F.col("ny") - F.col("y")) * (F.col("mx") - F.col("nx"))
    sign = F.when(F.abs(bend) >= 1e-10, F.signum(bend))
    rows = edges(rings).withColumn("cross", cross).withColumn("sign", sign)
    sums = rows.groupBy("geom_id", "ring_id").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("cross") / 2).alias("signed_area"), F.sum(hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("perimeter"),
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.sum((F.col("x") + F.col("nx")) * F.col("cross")).alias("sx"),
        F.sum((F.col("y") + F.col("ny")) * F.col("cross")).alias("sy"), F.min("sign").alias("lo"), F.max("sign").alias("hi"),
    )
    area = F.col("signed_area")
    flat = F.abs(area) < 1e-9
    center = lambda s, m: F.when(flat, F.col(m)).otherwise(F.try_divide(F.col(s), F.lit(6.0) * area))
    convex = F.when(F.col("n") < 3, False).when(F.col("n") == 3, True).otherwise(F.coalesce(F.col("lo") == F.col("hi"), F.lit(True)))
    return sums.select(
        "geom_id", "ring_id", "n", "signed_area", F.abs(area).alias("area"), F.when(~flat, F.when(area > 0, "CCW").otherwise("CW")).alias("winding"),
        "perimeter", "min_x", "min_y", "max_x", "max_y", center("sx", "mean_x").alias("cx"), center("sy", "mean_y").alias("cy"), "mean_x", "mean_y", convex.alias("convex"),
    )


def group_bounds(rings: DataFrame) -> DataFrame:
    """Box and net area (rings of opposite winding subtract) of each geometry."""
    per = ring_measures(rings)
    return per.groupBy("geom_id").agg(
        F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"),
        F.abs(F.sum("signed_area")).alias("area"), F.count(F.lit(1)).alias("n_rings"),
    )


def corners(rings: DataFrame, concave: bool, threshold: float) -> DataFrame:
    """Vertices that turn the wanted way, with an interior angle of at least ``threshold`` degrees."""
    w, whole = ordered(*_ring(rings)), _whole(rings)
    rows = edges(rings)
    before = {c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole)) for c in (x, y)}
    rows = rows.select("*", before[x].alias("bx"), before[y].alias("by"), F.sum(shoelace(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))).over(Window.partitionBy("ring_id")).alias("twice"))
    ux, uy, vx, vy = F.col("x") - F.col("bx"), F.col("y") - F.col("by"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    cross = ux * vy - uy * vx
    hollow = F.when(F.col("twice") > 0, cross < 0).otherwise(cross > 0)
    cosine = -(ux * vx + uy * vy) / F.nullif(hypot(ux, uy) * hypot(vx, vy), F.lit(0.0))
    raw = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))
    angle = F.when(hollow, F.lit(360.0) - raw).otherwise(raw)
    return rows.filter((cross != 0) & (hollow if concave else ~hollow)).select("ring_id", "seq", angle.alias("angle")).filter(F.col("angle") >= threshold)


def resample(rings: DataFrame, spacing: float) -> DataFrame:
    """Vertices at most ``spacing`` apart: each edge is cut into equal parts; ``part`` counts them."""
    rows = edges(rings)
    length = hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    parts = F.greatest(F.ceil(length / spacing), F.lit(1)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    t = F.col("part") / F.col("parts")
    return rows.select("geom_id", "ring_id", "seq", "part", (F.col("x") + t * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("ny") - F.col("y"))).alias("y"))


def moving_average(rings: DataFrame, radius: int) -> DataFrame:
    """Mean of the vertices within ``radius`` positions; windows shrink at the ends of the list."""
    w = ordered("ring_id").rowsBetween(-radius, radius)
    return rings.select("ring_id", "seq", F.avg("x").over(w).alias("x"), F.avg("y").over(w).alias("y"))


def along(rings: DataFrame) -> DataFrame:
    """Open paths: each vertex after the first with its predecessor and the length before and after it."""
    w = ordered("ring_id")
    rows = rings.select("*", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py")).filter("px is not null")
    rows = rows.withColumn("length", hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    rows = rows.withColumn("upto", F.sum("length").over(so_far(w)))
    return rows.withColumn("from", F.col("upto") - F.col("length"))


def positions(rings: DataFrame, distances: DataFrame) -> DataFrame:
    """Points at ``distances(ring_id, d)`` along open paths, clamped to the ends."""
    rows = along(rings).filter(F.col("length") >= COLLINEAR)
    total = rows.groupBy("ring_id").agg(F.max("upto").alias("total"))
    asked = distances.join(total, "ring_id").withColumn("at", F.greatest(F.lit(0.0), F.least("d", "total")))
    hit = asked.join(rows, "ring_id").filter((F.col("at") <= F.col("upto") + COLLINEAR) & (F.col("at") >= F.col("from") - COLLINEAR))
    best = hit.groupBy("ring_id", "d").agg(F.min_by(F.struct("seq", "at", "from", "length", "px", "py", "x", "y"), "seq").alias("s"))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s.at") - F.col("s.from")) / F.col("s.length")))
    return best.select("ring_id", "d", F.col("s.seq").alias("seq"), t.alias("t")).join(rows.select("ring_id", "seq", "px", "py", "x", "y"), ["ring_id", "seq"]).select(
        "ring_id", "d", "seq", "t", (F.col("px") + F.col("t") * (F.col("x") - F.col("px"))).alias("x"), (F.col("py") + F.col("t") * (F.col("y") - F.col("py"))).alias("y")
    )


def first_part(rings: DataFrame, length: float) -> DataFrame:
    """The rows of an open path up to ``length``; the last one is cut where it is reached."""
    rows = along(rings).filter((F.col("length") >= COLLINEAR) & (F.col("from") < length - COLLINEAR))
    t = F.least(F.lit(1.0), (F.lit(length) - F.col("from")) / F.col("length"))
    t = F.when(F.col("upto") <= length + COLLINEAR, F.lit(1.0)).otherwise(t)
    return rows.select("ring_id", "seq", (F.col("px") + t * (F.col("x") - F.col("px"))).alias("x"), (F.col("py") + t * (F.col("y") - F.col("py"))).alias("y"))


def overcut(rings: DataFrame, length: float) -> DataFrame:
    """Closed rings as paths that end with their first part again; ``again`` marks the added rows."""
    ends = rings.groupBy("ring_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("s"), F.max("seq").alias("m"))
    closing = ends.select("ring_id", (F.col("m") + 1).cast("int").alias("seq"), F.col("s.x").alias("x"), F.col("s.y").alias("y"))
    closed = rings.select("ring_id", "seq", "x", "y").unionByName(closing)
    more = first_part(closed, length).withColumn("again", F.lit(1))
    both = closed.withColumn("again", F.lit(0)).unionByName(more)
    return both.select("ring_id", (F.row_number().over(Window.partitionBy("ring_id").orderBy("again", "seq")) - 1).alias("seq"), "x", "y", "again")


def path_lengths(rings: DataFrame) -> DataFrame:
    """Length of each vertex list as an open path, and whether its ends meet."""
    ends = rings.groupBy("ring_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    gap = hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    return along(rings).groupBy("ring_id").agg(F.sum("length").alias("length")).join(ends, "ring_id").select("ring_id", "length", (gap < 1e-6).alias("closed"))


def fit_circles(rings: DataFrame) -> DataFrame:
    """Least-squares circle of each ring's vertices and its largest residual; null for collinear ones.

    Eight moments per ring about its mean point, Cramer's rule in columns, and a second pass for the residual.
    """
    mean = rings.groupBy("ring_id").agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"))
    rows = rings.join(mean, "ring_id").withColumn("u", F.col("x") - F.col("ox")).withColumn("v", F.col("y") - F.col("oy"))
    u, v = F.col("u"), F.col("v")
    m = rows.groupBy("ring_id", "ox", "oy").agg(
        F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), F.sum(u * (u * u + v * v)).alias("uz"),
        F.sum(v * (u * u + v * v)).alias("vz"), F.avg(u * u + v * v).alias("z"),
    )
    det = F.nullif(F.when(F.abs(F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")) > 1e-9, F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")), F.lit(0.0))
    a = (F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv")) / det / 2
    b = (F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv")) / det / 2
    circle = m.select("ring_id", (F.col("ox") + a).alias("cx"), (F.col("oy") + b).alias("cy"), F.sqrt(a * a + b * b + F.col("z")).alias("r"))
    error = rings.join(circle, "ring_id").groupBy("ring_id", "cx", "cy", "r").agg(F.max(F.abs(hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r"))).alias("residual"))
    return error


def holes(rings: DataFrame, spacing: float, tolerance: float) -> DataFrame:
    """Rings that are circles within ``tolerance`` after resampling."""
    return fit_circles(resample(rings, spacing).select("ring_id", "x", "y")).filter(F.col("residual") <= tolerance)


def chord_deviation(rings: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Largest distance of inner vertices from the line through a path's ends, and the first vertex where it is."""
    ends = rings.groupBy("ring_id").agg(F.min_by(F.struct("x", "y", "seq"), "seq").alias("a"), F.max_by(F.struct("x", "y", "seq"), "seq").alias("b"))
    rows = rings.join(ends, "ring_id").filter((F.col("seq") > F.col("a.seq")) & (F.col("seq") < F.col("b.seq")))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    ux, uy = F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
    n = dx * dx + dy * dy
    d2 = F.when(n < 1e-12, ux * ux + uy * uy).otherwise((ux * dy - uy * dx) * (ux * dy - uy * dx) / F.nullif(n, F.lit(0.0)))
    best = rows.withColumn("d2", d2).groupBy("ring_id").agg(F.max(F.struct("d2", (-F.col("seq")).alias("m"))).alias("s"))
    return best.select("ring_id", F.sqrt("s.d2").alias("deviation"), (-F.col("s.m")).alias("seq"), (F.sqrt("s.d2") <= tolerance).alias("straight"))


def at_origin(rings: DataFrame) -> DataFrame:
    """Rings moved so that each geometry's lowest corner is the origin."""
    w = Window.partitionBy("geom_id")
    return rings.select("geom_id", "ring_id", "seq", (F.col("x") - F.min("x").over(w)).alias("x"), (F.col("y") - F.min("y").over(w)).alias("y"))


def transformed(rings: DataFrame, a: float, b: float, c: float, d: float, tx: float, ty: float) -> DataFrame:
    """Rings under the matrix (a b tx; c d ty); mirrored ones are reversed, so that windings stay."""
    rows = rings.select("geom_id", "ring_id", "seq", (F.col("x") * a + F.col("y") * b + tx).alias("x"), (F.col("x") * c + F.col("y") * d + ty).alias("y"))
    return rows.withColumn("seq", F.max("seq").over(Window.partitionBy("ring_id")) - F.col("seq")) if a * d - b * c < 0 else rows


def rectangles(boxes: DataFrame, a: float, b: float, c: float, d: float, tx: float, ty: float) -> DataFrame:
    """Boxes of transformed boxes ``(ring_id, min_x, min_y, max_x, max_y)``: of their four corners."""
    px = [F.col(u) * a + F.col(v) * b + tx for u in ("min_x", "max_x") for v in ("min_y", "max_y")]
    py = [F.col(u) * c + F.col(v) * d + ty for u in ("min_x", "max_x") for v in ("min_y", "max_y")]
    return boxes.select("ring_id", F.least(*px).alias("min_x"), F.least(*py).alias("min_y"), F.greatest(*px).alias("max_x"), F.greatest(*py).alias("max_y"))


def headings(rings: DataFrame) -> DataFrame:
    """Midpoint, direction in degrees and outward normal of each edge."""
    rows = edges(rings)
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    n = F.nullif(hypot(dx, dy), F.lit(0.0))
    ccw = F.sum(shoelace(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))).over(Window.partitionBy("ring_id")) > 0
    side = F.when(ccw, F.lit(1.0)).otherwise(F.lit(-1.0))
    return rows.select("ring_id", "seq", ((F.col("x") + F.col("nx")) / 2).alias("mx"), ((F.col("y") + F.col("ny")) / 2).alias("my"), F.degrees(F.atan2(dy, dx)).alias("heading"), (side * dy / n).alias("normal_x"), (-side * dx / n).alias("normal_y"))


def circles(points: DataFrame, radius: float, n: int) -> DataFrame:
    """A ring of ``n`` vertices around each point."""
    angle = F.col("seq") * F.lit(2 * math.pi / n)
    return points.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("point_id", "seq", (F.col("x") + radius * F.cos(angle)).alias("x"), (F.col("y") + radius * F.sin(angle)).alias("y"))


def closest_on_segment(rings: DataFrame, px: float, py: float) -> DataFrame:
    """The point of each edge that is nearest to a given one."""
    t, qx, qy, d2 = on_segment(F.lit(px), F.lit(py), F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    return edges(rings).select("ring_id", "seq", t.alias("t"), qx.alias("qx"), qy.alias("qy"), d2.alias("d2"))


def clip_to_box(rings: DataFrame, lo: tuple[float, float], hi: tuple[float, float]) -> DataFrame:
    """The part of each edge inside a box, by the range of its parameter; edges outside are left out."""
    rows = edges(rings)
    def span(p, q, a, b):  # noqa: E306
        d = q - p
        inside = (p >= a) & (p <= b)
        t0, t1 = (F.lit(a) - p) / F.nullif(d, F.lit(0.0)), (F.lit(b) - p) / F.nullif(d, F.lit(0.0))
        return F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(t0, t1)), F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(t0, t1))
    x0, x1 = span(F.col("x"), F.col("nx"), lo[0], hi[0])
    y0, y1 = span(F.col("y"), F.col("ny"), lo[1], hi[1])
    rows = rows.withColumn("t0", F.greatest(F.lit(0.0), x0, y0)).withColumn("t1", F.least(F.lit(1.0), x1, y1)).filter("t0 < t1")
    at = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    return rows.select("ring_id", "seq", at("x", "nx", "t0").alias("x0"), at("y", "ny", "t0").alias("y0"), at("x", "nx", "t1").alias("x1"), at("y", "ny", "t1").alias("y1"))


# Queries and their SQL ----------------------------------------------------------------------------------------------


def _q(f, name="rings", digits=6):
    return lambda spark, sf_dir: rounded(f(table(spark, sf_dir, name)), digits=digits)


_EDGES = f"""{cte('rings')}, r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY ring_id) AS n FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY seq)),
e AS (SELECT r.*, a.x AS nx, a.y AS ny, b.x AS mx, b.y AS my, c.x AS bx, c.y AS by_ FROM r JOIN r a ON a.ring_id = r.ring_id AND a.i = r.i % r.n + 1
 JOIN r b ON b.ring_id = r.ring_id AND b.i = (r.i + 1) % r.n + 1 JOIN r c ON c.ring_id = r.ring_id AND c.i = (r.i + r.n - 2) % r.n + 1)"""
_MEASURES = f"""{_EDGES}, g AS (SELECT geom_id, ring_id, count(*) AS n, sum(x * ny - nx * y) / 2 AS signed_area, sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)) AS perimeter,
 min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, avg(x) AS mean_x, avg(y) AS mean_y, sum((x + nx) * (x * ny - nx * y)) AS sx, sum((y + ny) * (x * ny - nx * y)) AS sy,
 count(*) FILTER ((nx - x) * (my - ny) - (ny - y) * (mx - nx) > 1e-10) AS l, count(*) FILTER ((nx - x) * (my - ny) - (ny - y) * (mx - nx) < -1e-10) AS r FROM e GROUP BY ALL)"""
_ALONG = f"""{cte('rings')}, l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY seq)),
k AS (SELECT *, sqrt((x - px) ** 2 + (y - py) ** 2) AS len, sum(sqrt((x - px) ** 2 + (y - py) ** 2)) OVER (PARTITION BY ring_id ORDER BY seq) AS upto FROM l WHERE px IS NOT NULL)"""


def _distances(r: DataFrame) -> DataFrame:
    return r.select("ring_id").distinct().select("ring_id", F.explode(F.array(*[F.lit(v) for v in (-1.0, 10.5, 33.25, 1e6)])).alias("d"))


QUERIES = {
    "ring_measures": _q(ring_measures),
    "group_bounds": _q(group_bounds),
    "convex_corners": _q(lambda r: corners(r, False, 45.0)),
    "resample_rings": _q(lambda r: resample(r, 7.5), digits=9),
    "moving_average": _q(lambda r: moving_average(r, 1)),
    "positions_along": _q(lambda r: positions(r, _distances(r))),
    "first_part": _q(lambda r: first_part(r, 30.0)),
    "overcut": _q(lambda r: overcut(r, 5.0)),
    "path_lengths": _q(path_lengths),
    "fit_circles": _q(fit_circles),
    "holes": _q(lambda r: holes(r, 0.5, 5.0)),
    "chord_deviation": _q(lambda r: chord_deviation(r, 8.0)),
    "rings_at_origin": _q(at_origin),
    "mirror_rings": _q(lambda r: transformed(r, -1.0, 0.0, 0.0, 1.0, 3.0, 0.5)),
    "transform_boxes": _q(lambda r: rectangles(ring_measures(r), 0.6, -0.8, 0.8, 0.6, 1.0, 2.0)),
    "edge_headings": _q(headings),
    "circle_rings": _q(lambda p: circles(p, 2.5, 12), "points"),
    "closest_on_edges": _q(lambda r: closest_on_segment(r, 300.0, 300.0), digits=3),
    "clip_to_box": _q(lambda r: clip_to_box(r, (100.0, 100.0), (500.0, 500.0))),
}
ORACLE_SQL = {
    "ring_measures": f"""{_MEASURES} SELECT geom_id, ring_id, n, round(signed_area, 6) AS signed_area, round(abs(signed_area), 6) AS area,
 CASE WHEN abs(signed_area) >= 1e-9 THEN CASE WHEN signed_area > 0 THEN 'CCW' ELSE 'CW' END END AS winding, round(perimeter, 6) AS perimeter, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y,
 round(max_x, 6) AS max_x, round(max_y, 6) AS max_y, round(CASE WHEN abs(signed_area) < 1e-9 THEN mean_x ELSE sx / (6 * signed_area) END, 6) AS cx,
 round(CASE WHEN abs(signed_area) < 1e-9 THEN mean_y ELSE sy / (6 * signed_area) END, 6) AS cy, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, n = 3 OR n > 3 AND (l = 0 OR r = 0) AS convex FROM g""",
    "group_bounds": f"""{_MEASURES} SELECT geom_id, round(min(min_x), 6) AS min_x, round(min(min_y), 6) AS min_y, round(max(max_x), 6) AS max_x, round(max(max_y), 6) AS max_y,
 round(abs(sum(signed_area)), 6) AS area, count(*) AS n_rings FROM g GROUP BY geom_id""",
    "convex_corners": f"""{_EDGES}, c AS (SELECT *, (x - bx) * (ny - y) - (y - by_) * (nx - x) AS k, sum(x * ny - nx * y) OVER (PARTITION BY ring_id) > 0 AS ccw,
 degrees(acos(greatest(-1, least(1, ((bx - x) * (nx - x) + (by_ - y) * (ny - y)) / (sqrt((x - bx) ** 2 + (y - by_) ** 2) * sqrt((nx - x) ** 2 + (ny - y) ** 2)))))) AS a FROM e)
 SELECT ring_id, seq, round(a, 6) AS angle FROM c WHERE k <> 0 AND ccw = (k > 0) AND a >= 45""",
    "resample_rings": f"""{_EDGES}, p AS (SELECT *, greatest(ceil(sqrt((nx - x) ** 2 + (ny - y) ** 2) / 7.5), 1)::INT AS parts FROM e), s AS (SELECT *, unnest(range(parts))::INT AS part FROM p)
 SELECT geom_id, ring_id, seq, part, round(x + part / parts * (nx - x), 9) AS x, round(y + part / parts * (ny - y), 9) AS y FROM s""",
    "moving_average": f"""{cte('rings')} SELECT ring_id, seq, round(avg(x) OVER w, 6) AS x, round(avg(y) OVER w, 6) AS y FROM rings
 WINDOW w AS (PARTITION BY ring_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    "positions_along": f"""{_ALONG}, d AS (SELECT ring_id, unnest([-1.0, 10.5, 33.25, 1e6])::DOUBLE AS d, max(upto) AS total FROM k GROUP BY ring_id),
 c AS (SELECT *, greatest(0, least(d, total)) AS pos FROM d), h AS (SELECT c.ring_id, c.d, k.seq, least(1, greatest(0, (pos - (upto - len)) / len)) AS t, px, py, x, y,
 row_number() OVER (PARTITION BY c.ring_id, c.d ORDER BY k.seq) AS i FROM c JOIN k ON k.ring_id = c.ring_id AND pos <= upto + 1e-9 AND len >= 1e-9)
 SELECT ring_id, d, seq, round(t, 6) AS t, round(px + t * (x - px), 6) AS x, round(py + t * (y - py), 6) AS y FROM h WHERE i = 1""",
    "first_part": f"""{_ALONG}, c AS (SELECT *, CASE WHEN upto <= 30 + 1e-9 THEN 1 ELSE (30 - (upto - len)) / len END AS t FROM k WHERE len >= 1e-9 AND upto - len < 30 - 1e-9)
 SELECT ring_id, seq, round(px + t * (x - px), 6) AS x, round(py + t * (y - py), 6) AS y FROM c""",
    "overcut": f"""{cte('rings')}, c AS (SELECT ring_id, seq, x, y FROM rings UNION ALL SELECT ring_id, max(seq) + 1, arg_min(x, seq), arg_min(y, seq) FROM rings GROUP BY ring_id),
 l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c WINDOW w AS (PARTITION BY ring_id ORDER BY seq)),
 k AS (SELECT *, sqrt((x - px) ** 2 + (y - py) ** 2) AS len, sum(sqrt((x - px) ** 2 + (y - py) ** 2)) OVER (PARTITION BY ring_id ORDER BY seq) AS upto FROM l WHERE px IS NOT NULL),
 m AS (SELECT *, CASE WHEN upto <= 5 + 1e-9 THEN 1 ELSE (5 - (upto - len)) / len END AS t FROM k WHERE len >= 1e-9 AND upto - len < 5 - 1e-9),
 u AS (SELECT ring_id, seq, x, y, 0 AS again FROM c UNION ALL SELECT ring_id, seq, px + t * (x - px), py + t * (y - py), 1 FROM m)
 SELECT ring_id, (row_number() OVER (PARTITION BY ring_id ORDER BY again, seq) - 1)::INT AS seq, round(x, 6) AS x, round(y, 6) AS y, again FROM u""",
    "path_lengths": f"""{_ALONG}, e AS (SELECT ring_id, sqrt((arg_min(x, seq) - arg_max(x, seq)) ** 2 + (arg_min(y, seq) - arg_max(y, seq)) ** 2) < 1e-6 AS closed FROM rings GROUP BY ring_id)
 SELECT ring_id, round(sum(len), 6) AS length, closed FROM k JOIN e USING (ring_id) GROUP BY ring_id, closed""",
    "rings_at_origin": f"""{cte('rings')} SELECT geom_id, ring_id, seq, round(x - min(x) OVER (PARTITION BY geom_id), 6) AS x, round(y - min(y) OVER (PARTITION BY geom_id), 6) AS y FROM rings""",
    "mirror_rings": f"{cte('rings')} SELECT geom_id, ring_id, max(seq) OVER (PARTITION BY ring_id) - seq AS seq, round(3 - x, 6) AS x, round(y + 0.5, 6) AS y FROM rings",
    "transform_boxes": f"""{cte('rings')}, b AS (SELECT ring_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM rings GROUP BY ring_id)
 SELECT ring_id, round(0.6 * x0 - 0.8 * y1 + 1, 6) AS min_x, round(0.8 * x0 + 0.6 * y0 + 2, 6) AS min_y, round(0.6 * x1 - 0.8 * y0 + 1, 6) AS max_x, round(0.8 * x1 + 0.6 * y1 + 2, 6) AS max_y FROM b""",
    "edge_headings": f"""{_EDGES}, h AS (SELECT *, CASE WHEN sum(x * ny - nx * y) OVER (PARTITION BY ring_id) > 0 THEN 1.0 ELSE -1.0 END AS side, nullif(sqrt((nx - x) ** 2 + (ny - y) ** 2), 0) AS len FROM e)
 SELECT ring_id, seq, round((x + nx) / 2, 6) AS mx, round((y + ny) / 2, 6) AS my, round(degrees(atan2(ny - y, nx - x)), 6) AS heading, round(side * (ny - y) / len, 6) AS normal_x, round(-side * (nx - x) / len, 6) AS normal_y FROM h""",
    "circle_rings": f"""{cte('points')} SELECT point_id, seq::INT AS seq, round(x + 2.5 * cos(seq * 2 * pi() / 12), 6) AS x, round(y + 2.5 * sin(seq * 2 * pi() / 12), 6) AS y FROM points, range(12) AS t(seq)""",
    "closest_on_edges": f"""{_EDGES}, t AS (SELECT *, least(1, greatest(0, ((300 - x) * (nx - x) + (300 - y) * (ny - y)) / ((nx - x) ** 2 + (ny - y) ** 2))) AS t FROM e)
 SELECT ring_id, seq, round(t, 3) AS t, round(x + t * (nx - x), 3) AS qx, round(y + t * (ny - y), 3) AS qy, round((300 - x - t * (nx - x)) ** 2 + (300 - y - t * (ny - y)) ** 2, 3) AS d2 FROM t""",
    "clip_to_box": f"""{_EDGES}, b AS (SELECT *, CASE WHEN nx = x THEN CASE WHEN x BETWEEN 100 AND 500 THEN 0 ELSE 2 END ELSE least((100 - x) / (nx - x), (500 - x) / (nx - x)) END AS u0,
 CASE WHEN nx = x THEN CASE WHEN x BETWEEN 100 AND 500 THEN 1 ELSE -1 END ELSE greatest((100 - x) / (nx - x), (500 - x) / (nx - x)) END AS u1,
 CASE WHEN ny = y THEN CASE WHEN y BETWEEN 100 AND 500 THEN 0 ELSE 2 END ELSE least((100 - y) / (ny - y), (500 - y) / (ny - y)) END AS v0,
 CASE WHEN ny = y THEN CASE WHEN y BETWEEN 100 AND 500 THEN 1 ELSE -1 END ELSE greatest((100 - y) / (ny - y), (500 - y) / (ny - y)) END AS v1 FROM e),
 t AS (SELECT *, greatest(0, u0, v0) AS t0, least(1, u1, v1) AS t1 FROM b)
 SELECT ring_id, seq, round(x + t0 * (nx - x), 6) AS x0, round(y + t0 * (ny - y), 6) AS y0, round(x + t1 * (nx - x), 6) AS x1, round(y + t1 * (ny - y), 6) AS y1 FROM t WHERE t0 < t1""",
}
_CIRCLE = """, mo AS (SELECT ring_id, avg(x) AS ox, avg(y) AS oy FROM {0} GROUP BY ring_id), uv AS (SELECT p.ring_id, ox, oy, x - ox AS u, y - oy AS v FROM {0} p JOIN mo USING (ring_id)),
 su AS (SELECT ring_id, ox, oy, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * (u * u + v * v)) AS uz, sum(v * (u * u + v * v)) AS vz, avg(u * u + v * v) AS z FROM uv GROUP BY ALL),
 ci AS (SELECT ring_id, ox + (uz * vv - vz * uv) / (uu * vv - uv * uv) / 2 AS cx, oy + (vz * uu - uz * uv) / (uu * vv - uv * uv) / 2 AS cy,
 sqrt(((uz * vv - vz * uv) / (uu * vv - uv * uv) / 2) ** 2 + ((vz * uu - uz * uv) / (uu * vv - uv * uv) / 2) ** 2 + z) AS r FROM su),
 er AS (SELECT ring_id, cx, cy, r, max(abs(sqrt((x - cx) ** 2 + (y - cy) ** 2) - r)) AS residual FROM {0} JOIN ci USING (ring_id) GROUP BY ALL)
 SELECT ring_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(r, 6) AS r, round(residual, 6) AS residual FROM er"""
ORACLE_SQL["fit_circles"] = cte("rings") + _CIRCLE.format("rings")
ORACLE_SQL["holes"] = f"""{_EDGES}, pa AS (SELECT *, greatest(ceil(sqrt((nx - x) ** 2 + (ny - y) ** 2) / 0.5), 1)::INT AS parts FROM e), se AS (SELECT *, unnest(range(parts)) AS part FROM pa),
 q AS (SELECT ring_id, x + part / parts * (nx - x) AS x, y + part / parts * (ny - y) AS y FROM se)""" + _CIRCLE.format("q") + " WHERE residual <= 5"
ORACLE_SQL["chord_deviation"] = f"""{cte('rings')}, en AS (SELECT ring_id, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, min(seq) AS lo, arg_max(x, seq) AS bx, arg_max(y, seq) AS by_, max(seq) AS hi FROM rings GROUP BY ring_id),
 di AS (SELECT ring_id, seq, ((x - ax) * (by_ - ay) - (y - ay) * (bx - ax)) ** 2 / ((bx - ax) ** 2 + (by_ - ay) ** 2) AS d2 FROM rings JOIN en USING (ring_id) WHERE seq > lo AND seq < hi),
 ra AS (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY d2 DESC, seq) AS i FROM di) SELECT ring_id, round(sqrt(d2), 6) AS deviation, seq, sqrt(d2) <= 8 AS straight FROM ra WHERE i = 1"""
