"""Triangle meshes as vertex and triangle tables: adjacency, gradients, assembly, and the Laplace field."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.geometry import hypot
from pathloom.functions.grid import in_cells, joined
from pathloom.functions.loops import discard, saved
from pathloom.operators.commands import rounded
from pathloom.sources.derive import cte, table

#: Vertices that a cell of the Laplace field should have; a cell with over twice as many is crowded.
CELL_NODES = 800


def sides(tris: DataFrame) -> DataFrame:
    """The three edges of each triangle, ends in order."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    return tris.select("t", F.inline(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))))


def adjacency(tris: DataFrame) -> DataFrame:
    """Triangles that share an edge."""
    s = sides(tris)
    return s.alias("l").join(s.alias("r"), ["u", "v"]).filter("l.t <> r.t").select(F.col("l.t").alias("t"), F.col("r.t").alias("other"), "u", "v")


def with_corners(tris: DataFrame, verts: DataFrame) -> DataFrame:
    out = tris
    for corner in "abc":
        out = out.join(verts.select(F.col("v").alias(corner), *[F.col(c).alias(f"{corner}{c}") for c in verts.columns if c != "v"]), corner)
    return out


def gradients(tris: DataFrame, verts: DataFrame) -> DataFrame:
    """Gradient of ``verts.u`` on each triangle; 0 for triangles without area."""
    rows = with_corners(tris, verts)
    c = F.col
    twice = (c("bx") - c("ax")) * (c("cy") - c("ay")) - (c("cx") - c("ax")) * (c("by") - c("ay"))
    gx = (c("au") * (c("by") - c("cy")) + c("bu") * (c("cy") - c("ay")) + c("cu") * (c("ay") - c("by"))) / F.nullif(twice, F.lit(0.0))
    gy = (c("au") * (c("cx") - c("bx")) + c("bu") * (c("ax") - c("cx")) + c("cu") * (c("bx") - c("ax"))) / F.nullif(twice, F.lit(0.0))
    small = F.abs(twice) < 1e-30
    return rows.select("t", F.when(small, 0.0).otherwise(gx).alias("gx"), F.when(small, 0.0).otherwise(gy).alias("gy"))


def stiffness(tris: DataFrame, verts: DataFrame) -> DataFrame:
    """Sparse matrix of the Laplace problem, ``i, j, k``: nine entries a triangle, summed."""
    rows = with_corners(tris, verts.select("v", "x", "y"))
    c = F.col
    twice = F.abs((c("bx") - c("ax")) * (c("cy") - c("ay")) - (c("cx") - c("ax")) * (c("by") - c("ay")))
    grad = {"a": (c("by") - c("cy"), c("cx") - c("bx")), "b": (c("cy") - c("ay"), c("ax") - c("cx")), "c": (c("ay") - c("by"), c("bx") - c("ax"))}
    entry = [F.struct(c(p).alias("i"), c(q).alias("j"), ((grad[p][0] * grad[q][0] + grad[p][1] * grad[q][1]) / (F.lit(2.0) * F.nullif(twice, F.lit(0.0)))).alias("k")) for p in "abc" for q in "abc"]
    return rows.filter(twice > 1e-30).select(F.inline(F.array(*entry))).groupBy("i", "j").agg(F.sum("k").alias("k"))


def long_edges(tris: DataFrame, verts: DataFrame, longest: float) -> DataFrame:
    """Midpoints of edges longer than ``longest`` that do not join two boundary vertices."""
    e = sides(tris).select("u", "v").distinct()
    p = verts.select(F.col("v").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("tag").alias("ut"))
    q = verts.select("v", F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("tag").alias("vt"))
    rows = e.join(p, "u").join(q, "v").filter(((F.col("ut") == "NONE") | (F.col("vt") == "NONE")) & (hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")) > longest))
    return rows.select("u", "v", ((F.col("ux") + F.col("vx")) / 2).alias("x"), ((F.col("uy") + F.col("vy")) / 2).alias("y"))


def _eliminated(i: np.ndarray, j: np.ndarray, k: np.ndarray, inner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of the inner rows of a cell for every column of ``right``: entries ``i, j, k`` among the sorted nodes ``inner``.

    Where nothing holds a part of the cell, its solution is the smallest one, as that of conjugate gradients from 0."""
    a = np.zeros((len(inner), len(inner)))
    np.add.at(a, (np.searchsorted(inner, i), np.searchsorted(inner, j)), k)
    try:
        low = np.diag(np.linalg.cholesky(a))
        if low.min() ** 2 > 1e-11 * np.abs(np.diag(a)).max():
            return np.linalg.solve(a, right)
    except np.linalg.LinAlgError:
        pass
    e, v = np.linalg.eigh((a + a.T) / 2)
    good = e > 1e-11 * max(e.max(), 1e-300)
    return (v[:, good] / e[good]) @ (v[:, good].T @ right)


def _condensed(g: pd.DataFrame) -> pd.DataFrame:
    """What a cell's inner nodes add to the matrix ``i, j, k`` of the nodes between cells, and to their right sides (``side``)."""
    inner, edge = np.unique(g["i"].to_numpy()), np.unique(g.loc[g["kind"] == 1, "j"].to_numpy())
    own, across, given = (g[g["kind"] == n] for n in range(3))
    out = np.zeros((len(inner), len(edge) + 1))
    np.add.at(out, (np.searchsorted(inner, across["i"]), np.searchsorted(edge, across["j"])), across["k"])
    np.add.at(out[:, -1], np.searchsorted(inner, given["i"]), given["k"])
    added = -(out[:, :-1].T @ _eliminated(own["i"], own["j"], own["k"], inner, out))
    i, side = np.repeat(edge, len(edge) + 1), np.tile(np.r_[np.zeros(len(edge), dtype=bool), True], len(edge))
    return pd.DataFrame({"i": i, "j": np.where(side, i, np.tile(np.r_[edge, 0], len(edge))), "k": added.ravel(), "side": side})


def _filled(g: pd.DataFrame) -> pd.DataFrame:
    """The field at a cell's inner nodes, from their entries (``kind`` 0) and right sides (2)."""
    inner, own, given = np.unique(g["i"].to_numpy()), g[g["kind"] == 0], g[g["kind"] == 2]
    right = np.zeros((len(inner), 1))
    np.add.at(right[:, 0], np.searchsorted(inner, given["i"]), given["k"])
    return pd.DataFrame({"v": inner, "u": _eliminated(own["i"], own["j"], own["k"], inner, right)[:, 0]})


def _in_cells(verts: DataFrame) -> DataFrame:
    """Free vertices with their cell (``i, cx, cy``), cells of about ``CELL_NODES``; of crowded cells, and of vertices without a place, null."""
    free = verts.filter("tag = 'NONE'").select(F.col("v").alias("i"), "x", "y")
    left, low, right, top, n = free.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count(F.lit(1))).first()
    wide, high = (right or 0.0) - (left or 0.0), (top or 0.0) - (low or 0.0)
    share = min(CELL_NODES / max(n, 1), 1 / 16)  # small meshes have some cells too
    size = max((wide * high * share) ** 0.5, max(wide, high) * share, 1e-300)
    cells = free.select("i", F.floor((F.col("x") - F.lit(left)) / size).alias("cx"), F.floor((F.col("y") - F.lit(low)) / size).alias("cy"))
    few = cells.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= 2 * CELL_NODES).select("cx", "cy", F.lit(True).alias("few"))
    known = cells.join(few, ["cx", "cy"], "left")
    return known.select("i", *[F.when(F.col("few"), F.col(c)).alias(c) for c in ("cx", "cy")])


def laplace(tris: DataFrame, verts: DataFrame, tolerance: float = 1e-8, most: int | None = None) -> DataFrame:
    """Field that is 1 on OUTER, 0 on INNER vertices and harmonic elsewhere: cells are eliminated, conjugate gradients join them.

    A vertex with a neighbour in a smaller cell lies between cells. Within a cell the other ones meet no other cell's, so
    each cell is solved for them in a task of at most ``2 * CELL_NODES`` nodes, and what it adds to the matrix of the nodes
    between cells is exact; these are few, and rounds grow with the cells across the mesh, not with its vertices. Nodes of crowded
    cells all count as between cells. The matrix times a vector is a join and a sum by row; the vectors are one table,
    written each round. Rounds stop at the relative residual, which exact sums reach in as many rounds as there are nodes; a field that is not
    there after ``most`` (else 400 or ten times the nodes) is an error. The driver sees two sums a round.
    """
    fixed = verts.filter("tag <> 'NONE'").select(F.col("v").alias("j"), (F.col("tag") == "OUTER").cast("double").alias("u"))
    cells = saved(_in_cells(verts.select("v", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "tag")))
    free = cells.select("i")
    k = saved(stiffness(tris, verts).join(free, "i", "left_semi"))
    right = saved(k.join(fixed, "j").groupBy("i").agg((-F.sum(F.col("k") * F.col("u"))).alias("b")))
    at, to = cells, cells.toDF("j", "dx", "dy")
    rows = saved(k.join(at, "i").join(to, "j"))
    outside = F.col("cx").isNull() | F.col("dx").isNotNull() & (F.struct("dx", "dy") < F.struct("cx", "cy"))
    between = saved(rows.filter(outside).select("i").distinct().withColumn("between", F.lit(True)))
    rows = rows.join(between, "i", "left").join(between.toDF("j", "far"), "j", "left")
    rows = saved(rows.select("i", "j", "k", "cx", "cy", F.col("between").isNotNull().alias("between"), F.col("far").isNotNull().alias("far")))
    inner = cells.join(between, "i", "left_anti").filter("cx is not null")
    given = inner.join(right, "i").select("cx", "cy", F.col("i").cast("long").alias("i"), F.col("i").cast("long").alias("j"), F.col("b").alias("k"), F.lit(2).alias("kind"))
    own = rows.filter("not between").select("cx", "cy", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "k", F.col("far").cast("int").alias("kind"))
    added = saved(own.unionByName(given).groupBy("cx", "cy").applyInPandas(_condensed, "i long, j long, k double, side boolean"))
    matrix = rows.filter("between and far").select("i", "j", "k").unionByName(added.filter("not side").drop("side")).groupBy("i", "j").agg(F.sum("k").alias("k"))
    matrix = saved(matrix).persist()
    sums = right.join(between.select("i"), "i", "left_semi").unionByName(added.filter("side").select("i", F.col("k").alias("b"))).groupBy("i").agg(F.sum("b").alias("b"))
    state = saved(between.select("i").join(sums, "i", "left").select("i", F.lit(0.0).alias("x"), F.coalesce("b", F.lit(0.0)).alias("r"), F.coalesce("b", F.lit(0.0)).alias("p")))
    most = max(400, 10 * state.count()) if most is None else most
    rr = start = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    done = 0
    while rr > tolerance**2 * start:
        if done >= most:
            raise RuntimeError(f"the field needs more than {most} rounds")
        done += 1
        product = matrix.join(state.select(F.col("i").alias("j"), "p"), "j").groupBy("i").agg(F.sum(F.col("k") * F.col("p")).alias("q"))
        step = saved(state.join(product, "i", "left").withColumn("q", F.coalesce("q", F.lit(0.0))))
        alpha = rr / step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        moved = step.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p")
        new = moved.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        before, state = state, saved(moved.withColumn("p", F.col("r") + F.lit(new / rr) * F.col("p")))
        discard(before, step)
        rr = new
    matrix.unpersist()
    pull = own.filter("kind = 1").join(state.select(F.col("i").alias("j"), "x"), "j").select("cx", "cy", "i", F.col("i").alias("j"), (-F.col("k") * F.col("x")).alias("k"), F.lit(2).alias("kind"))
    inside = own.filter("kind = 0").unionByName(given).unionByName(pull).groupBy("cx", "cy").applyInPandas(_filled, "v long, u double")
    found = state.select(F.col("i").alias("v"), F.col("x").alias("u")).unionByName(inside)
    return free.select(F.col("i").alias("v")).join(found, "v", "left").select("v", F.coalesce("u", F.lit(0.0)).alias("u")).unionByName(fixed.select(F.col("j").alias("v"), "u"))


def locate(points: DataFrame, tris: DataFrame, verts: DataFrame, size: float = 2.0) -> DataFrame:
    """The triangle of each point, the first of several, with barycentric weights and the interpolated ``verts.u``."""
    rows = with_corners(tris, verts)
    named = rows.withColumnsRenamed({"cx": "qx", "cy": "qy", "cu": "qu"})
    boxed = in_cells(named, F.least("ax", "bx", "qx"), F.least("ay", "by", "qy"), F.greatest("ax", "bx", "qx"), F.greatest("ay", "by", "qy"), size)
    both = joined(in_cells(points, F.col("x"), F.col("y"), F.col("x"), F.col("y"), size), boxed)
    c = F.col
    det = F.nullif((c("by") - c("qy")) * (c("ax") - c("qx")) + (c("qx") - c("bx")) * (c("ay") - c("qy")), F.lit(0.0))
    wa = ((c("by") - c("qy")) * (c("x") - c("qx")) + (c("qx") - c("bx")) * (c("y") - c("qy"))) / det
    wb = ((c("qy") - c("ay")) * (c("x") - c("qx")) + (c("ax") - c("qx")) * (c("y") - c("qy"))) / det
    rows = both.withColumn("wa", wa).withColumn("wb", wb).withColumn("wc", F.lit(1.0) - c("wa") - c("wb")).filter((c("wa") >= -1e-9) & (c("wb") >= -1e-9) & (c("wc") >= -1e-9))
    value = c("wa") * c("au") + c("wb") * c("bu") + c("wc") * c("qu")
    return rows.withColumn("u", value).groupBy("point_id").agg(F.min_by(F.struct("t", "wa", "wb", "u"), "t").alias("s")).select("point_id", "s.*")


# Queries and their SQL ----------------------------------------------------------------------------------------------


def _verts(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "mesh_verts")
    edge = (F.col("v") % 50).isin(0, 49) | (F.floor(F.col("v") / 50) == 0) | (F.floor(F.col("v") / 50) == F.col("__last"))
    top = v.agg(F.floor(F.max("v") / 50).alias("__last"), F.lit(1).alias("__one"))
    rows = v.withColumn("__one", F.lit(1)).join(top, "__one").drop("__one")
    inner = (F.floor(F.col("v") / 50) == F.floor(F.col("__last") / 2)) & (F.col("v") % 50).between(20, 29)
    return rows.withColumn("tag", F.when(edge, "OUTER").when(inner, "INNER").otherwise("NONE")).withColumn("u", F.col("x") * 0.5 + F.col("y") * F.col("y")).drop("__last")


def _q(f, digits=6):
    return lambda spark, sf_dir: rounded(f(table(spark, sf_dir, "mesh_tris"), _verts(spark, sf_dir), spark, sf_dir), digits=digits)


def _places(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "points").select("point_id", (F.col("x") / 25).alias("x"), (F.col("y") / 30).alias("y"))


QUERIES = {
    "mesh_adjacency": _q(lambda t, v, *_: adjacency(t)),
    "mesh_gradients": _q(lambda t, v, *_: gradients(t, v.select("v", "x", "y", "u"))),
    "mesh_stiffness": _q(lambda t, v, *_: stiffness(t, v)),
    "mesh_long_edges": _q(lambda t, v, *_: long_edges(t, v, 1.05)),
    "mesh_locate": _q(lambda t, v, s, d: locate(_places(s, d), t, v.select("v", "x", "y", "u"))),
    "mesh_laplace": _q(lambda t, v, *_: laplace(t, v), digits=4),
}
_V = cte("mesh_verts", "mesh_tris")
_T = f"""{_V}, ve AS (SELECT *, x * 0.5 + y * y AS u, v % 50 IN (0, 49) OR v // 50 IN (0, (SELECT max(v) // 50 FROM mesh_verts)) AS rim FROM mesh_verts),
 q AS (SELECT t.*, A.x AS ax, A.y AS ay, A.u AS au, B.x AS bx, B.y AS by_, B.u AS bu, C.x AS cx, C.y AS cy, C.u AS cu, (B.x - A.x) * (C.y - A.y) - (C.x - A.x) * (B.y - A.y) AS d FROM mesh_tris t JOIN ve A ON A.v = t.a JOIN ve B ON B.v = t.b JOIN ve C ON C.v = t.c)"""
_S = "SELECT t, unnest([{'u': least(a, b), 'v': greatest(a, b)}, {'u': least(b, c), 'v': greatest(b, c)}, {'u': least(c, a), 'v': greatest(c, a)}], recursive := true) FROM mesh_tris"
ORACLE_SQL = {
    "mesh_adjacency": f"{_V}, s AS ({_S}) SELECT l.t, r.t AS other, l.u, l.v FROM s l JOIN s r ON l.u = r.u AND l.v = r.v AND l.t <> r.t",
    "mesh_gradients": f"{_T} SELECT t, round((au * (by_ - cy) + bu * (cy - ay) + cu * (ay - by_)) / d, 6) AS gx, round((au * (cx - bx) + bu * (ax - cx) + cu * (bx - ax)) / d, 6) AS gy FROM q",
    "mesh_stiffness": f"""{_T}, g AS (SELECT d, unnest([{{'i': a, 'gx': by_ - cy, 'gy': cx - bx}}, {{'i': b, 'gx': cy - ay, 'gy': ax - cx}}, {{'i': c, 'gx': ay - by_, 'gy': bx - ax}}], recursive := true), t FROM q)
 SELECT p.i, r.i AS j, round(sum((p.gx * r.gx + p.gy * r.gy) / (2 * abs(p.d))), 6) AS k FROM g p JOIN g r ON r.t = p.t GROUP BY ALL""",
    "mesh_long_edges": f"""{_T}, s AS ({_S}), e AS (SELECT DISTINCT u, v FROM s), m AS (SELECT max(v) // 50 // 2 AS mid FROM mesh_verts),
 w AS (SELECT v, x, y, rim OR v // 50 = (SELECT mid FROM m) AND v % 50 BETWEEN 20 AND 29 AS tagged FROM ve)
 SELECT e.u, e.v, round((p.x + q.x) / 2, 6) AS x, round((p.y + q.y) / 2, 6) AS y FROM e JOIN w p ON p.v = e.u JOIN w q ON q.v = e.v WHERE NOT (p.tagged AND q.tagged) AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) > 1.05""",
    "mesh_locate": f"""{_T.replace('WITH ', cte('points') + ', ', 1)}, pl AS (SELECT point_id, x / 25 AS x, y / 30 AS y FROM points),
 k AS (SELECT point_id, t, au, bu, cu, ((by_ - cy) * (x - cx) + (cx - bx) * (y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS wa, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS wb
  FROM pl JOIN q ON x BETWEEN least(ax, bx, cx) - 1e-6 AND greatest(ax, bx, cx) + 1e-6 AND y BETWEEN least(ay, by_, cy) - 1e-6 AND greatest(ay, by_, cy) + 1e-6),
 f AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY t) AS i FROM k WHERE wa >= -1e-9 AND wb >= -1e-9 AND 1 - wa - wb >= -1e-9)
 SELECT point_id, t, round(wa, 6) AS wa, round(wb, 6) AS wb, round(wa * au + wb * bu + (1 - wa - wb) * cu, 6) AS u FROM f WHERE i = 1""",
}
