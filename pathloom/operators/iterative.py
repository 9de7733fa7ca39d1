"""Work that is no single plan: hulls of hulls, greedy orders on metas, simplification by rounds, containment groups, cleared cells."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.loops import component_labels, saved
from pathloom.operators import commands as ops
from pathloom.functions.windows import so_far
from pathloom.operators.commands import by_job, is_, is_moving, rounded
from pathloom.sources.derive import table


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by the monotone chain, counter-clockwise from the lowest left point."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    def half(rows):  # noqa: E306
        out: list = []
        for q in rows.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]
    return np.asarray(half(p) + half(p[::-1]))


def convex_hulls(points: DataFrame, key: str) -> DataFrame:
    """Hull of each group of ``points(key, x, y)``: hulls of the parts that a batch holds, then hulls of hulls, batches of groups at a time.

    A group's raw points never meet in one task; what meets are the few corners of its parts' hulls.
    """
    def hulls(batches: Iterator[pa.RecordBatch], listed: bool) -> Iterator[pa.RecordBatch]:  # noqa: E306
        for b in batches:
            keys, at = b.column(0), b.column(1).flatten() if listed else None
            xy = np.column_stack([(c.cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in ((at.field(0), at.field(1)) if listed else (b.column(1), b.column(2)))])
            if listed:  # a row is a group
                ends, which = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False)), np.arange(len(keys))
                parts = np.split(xy, ends[:-1])
            else:  # equal keys of the batch are a group
                null, ids = keys.is_null().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy(zero_copy_only=False)
                order = np.lexsort((ids, null))
                first = np.flatnonzero(np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(null[order].astype(int)) != 0)][: len(ids)])
                parts, which = np.split(xy[order], first[1:]), order[first]
            shapes = [hull(p) for p in parts if len(p)]
            if shapes:
                sizes = [len(h) for h in shapes]
                corners = np.concatenate(shapes)
                out = {key: keys.take(pa.array(np.repeat(which, sizes))), "i": pa.array(np.concatenate([np.arange(n) for n in sizes])), "x": pa.array(corners[:, 0], from_pandas=True), "y": pa.array(corners[:, 1], from_pandas=True)}
                yield pa.RecordBatch.from_pydict(out)

    schema = f"{key} long, i long, x double, y double"
    parts = points.select(F.col(key).cast("long").alias(key), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).mapInArrow(lambda batches: hulls(batches, False), schema)
    corners = parts.groupBy(key).agg(F.collect_list(F.struct("x", "y")).alias("corners"))
    return corners.mapInArrow(lambda batches: hulls(batches, True), schema)


class Starts:
    """Distinct finite points in a tree of boxes, each with the rows left there; the nearest is found without the emptied ones."""

    def __init__(self, points: np.ndarray, leaf: int = 8):
        finite = np.flatnonzero(np.isfinite(points).all(axis=1))
        self.at, which = np.unique(points[finite], axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        parts = np.split(finite[order], np.cumsum(np.bincount(which, minlength=len(self.at)))[:-1]) if len(finite) else []
        self.rows = [p[::-1].tolist() for p in parts]  # the first is taken from the end
        self.x, self.y = self.at[:, 0].tolist(), self.at[:, 1].tolist()
        self.box, self.kids, self.parent, self.alive, self.points, self.home = [], [], [], [], [], [0] * len(self.at)
        todo = [(np.arange(len(self.at)), -1)] if len(finite) else []
        while todo:
            ids, parent = todo.pop()
            me, p = len(self.box), self.at[ids]
            lo, hi = p.min(axis=0), p.max(axis=0)
            self.box.append((*lo.tolist(), *hi.tolist()))
            self.kids.append([])
            self.parent.append(parent)
            self.alive.append(len(ids))
            if parent >= 0:
                self.kids[parent].append(me)
            if len(ids) <= leaf:
                self.points.append(ids.tolist())
                for q in ids:
                    self.home[q] = me
            else:
                self.points.append([])
                half = np.argpartition(p[:, int(hi[1] - lo[1] > hi[0] - lo[0])], len(ids) // 2)
                todo += [(ids[half[: len(ids) // 2]], me), (ids[half[len(ids) // 2 :]], me)]
        self.point_of = dict(zip(finite.tolist(), which.tolist()))

    def drop(self, row: int) -> None:
        q = self.point_of.get(row)
        if q is None:
            return
        self.rows[q].remove(row) if self.rows[q][-1] != row else self.rows[q].pop()
        node = self.home[q] if not self.rows[q] else -1
        while node >= 0:
            self.alive[node] -= 1
            node = self.parent[node]

    def nearest(self, x: float, y: float) -> int:
        """The row whose point is nearest, the first of equally near ones; -1 if none is left."""
        best, row = float("inf"), -1
        todo = [(0.0, 0)] if self.alive and self.alive[0] else []
        while todo:
            d, node = todo.pop()
            if d > best:
                continue
            for q in self.points[node]:
                if self.rows[q]:
                    ux, uy = self.x[q] - x, self.y[q] - y
                    d, r = ux * ux + uy * uy, self.rows[q][-1]
                    if row < 0 or d < best or (d == best and r < row):
                        best, row = d, r
            near = []
            for kid in self.kids[node]:
                if self.alive[kid]:
                    x0, y0, x1, y1 = self.box[kid]
                    ux, uy = max(x0 - x, x - x1, 0.0), max(y0 - y, y - y1, 0.0)
                    near.append((ux * ux + uy * uy, kid))
            todo += sorted(near, reverse=True)
        return row


def nearest_walk(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[int]:
    """Rows in the order of the walk from starts ``a`` and ends ``b``; unknown starts come first, after an unknown end the first row left."""
    at = int(len(a) - 1 - n[::-1].argmax())
    left, order, starts = np.ones(len(a), dtype=bool), [at], Starts(a)
    unknown, first = np.flatnonzero(np.isnan(a).any(axis=1)).tolist()[::-1], 0
    left[at] = False
    starts.drop(at)
    ends = b.tolist()
    while len(order) < len(a):
        while not left[first]:
            first += 1
        while unknown and not left[unknown[-1]]:
            unknown.pop()
        x, y = ends[at]
        if not (np.isfinite(x) and np.isfinite(y)):
            at = first
        elif unknown:
            at = unknown[-1]
        else:
            at = starts.nearest(x, y)
            at = first if at < 0 else at
        left[at] = False
        starts.drop(at)
        order.append(at)
    return order


def nearest_order(df: DataFrame) -> DataFrame:
    """Order of a job's subpaths: from the one with most moves (the last of equal ones), always the nearest next start.

    Paths are reduced to their entry, exit and size before the walk, which is sequential per job: one task holds these
    few numbers of all paths of its job, and a step takes about the logarithm of their count.
    """
    paths = ops.with_subpaths(df).filter(is_moving()).groupBy("job_id", "subpath").agg(
        F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"), F.count(F.lit(1)).alias("n")
    ).select("job_id", "subpath", "n", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("subpath", ignore_index=True)
        order = nearest_walk(g[["ax", "ay"]].to_numpy(dtype=float), g[["bx", "by"]].to_numpy(dtype=float), g["n"].to_numpy())
        return pd.DataFrame({"job_id": g["job_id"].iloc[0], "subpath": g["subpath"].to_numpy()[order], "rank": np.arange(len(g))})

    return paths.groupBy("job_id").applyInPandas(walk, "job_id long, subpath long, rank long")


def piece_walk(a: np.ndarray, b: np.ndarray, flips: np.ndarray) -> list[tuple[int, bool]]:
    """Pieces in the order of the walk from the first one: always the nearest entry ``a`` or exit ``b`` of those left; a piece met at
    its exit is run backwards if it can be. Of equally near points the one of the first piece counts, its entry before its exit."""
    ends = np.stack([a, b], axis=1).reshape(-1, 2)  # rows 2 i and 2 i + 1
    points, out, done = Starts(ends), [(0, False)], np.zeros(len(a), dtype=bool)
    here, first = b[0], 0
    for at in (0, 1):
        points.drop(at)
    done[0] = True
    while len(out) < len(a):
        row = points.nearest(*here.tolist()) if np.isfinite(here).all() else -1
        if row < 0:  # unknown places: the first piece left
            while done[first]:
                first += 1
            row = 2 * first
        piece, back = row // 2, bool(row % 2 and flips[row // 2])
        out.append((piece, back))
        here = a[piece] if back else b[piece]
        done[piece] = True
        for at in (2 * piece, 2 * piece + 1):
            points.drop(at)
    return out


def workpiece_order(df: DataFrame) -> DataFrame:
    """Order of a job's workpieces: ``job_id, piece, uid, rank, flipped``; ``piece`` is the row of its start marker.

    A workpiece is what moves between its markers; one without moves is left out, one that another start interrupts too, and
    the last one may lack its end. Pieces are reduced to entry, exit and whether they cut (only those can be run
    backwards) before the walk, which is sequential per job: a step takes about the logarithm of their count.
    """
    w = so_far(by_job())
    start = is_("WORKPIECE_START")
    rows = df.withColumn("piece", F.max(F.when(start, F.col("seq"))).over(w))
    rows = rows.filter(F.col("piece").isNotNull())
    ends = rows.groupBy("job_id", "piece").agg(F.min(F.when(is_("WORKPIECE_END"), F.col("seq"))).alias("end"), F.max_by("sval", F.when(start, F.col("seq"))).alias("uid"))
    last = Window.partitionBy("job_id")
    ends = ends.withColumn("whole", F.col("end").isNotNull() | (F.col("piece") == F.max("piece").over(last))).filter("whole")
    moves = rows.filter(is_moving()).join(ends, ["job_id", "piece"]).filter(F.col("end").isNull() | (F.col("seq") < F.col("end")))
    pieces = moves.groupBy("job_id", "piece").agg(
        F.first("uid").alias("uid"), F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"), F.bool_or(~is_("MOVE_TO")).alias("cuts"),
    ).select("job_id", "piece", "uid", "cuts", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("piece", ignore_index=True)
        order = piece_walk(g[["ax", "ay"]].to_numpy(dtype=float), g[["bx", "by"]].to_numpy(dtype=float), g["cuts"].to_numpy(dtype=bool))
        own = g.iloc[[p for p, _ in order]]
        return pd.DataFrame({"job_id": own["job_id"], "piece": own["piece"], "uid": own["uid"], "rank": np.arange(len(own)), "flipped": [f for _, f in order]})

    return pieces.groupBy("job_id").applyInPandas(walk, "job_id long, piece long, uid string, rank long, flipped boolean")


def simplified(points: DataFrame, tolerance: float) -> DataFrame:
    """Paths ``(path, seq, x, y)`` without points nearer than ``tolerance`` to the line between the kept ones.

    Rounds keep the farthest point of every open range; a range that needs none is closed, and only rows of open
    ranges go on, until none is open. The driver sees one count a round.
    """
    ends = points.groupBy("path").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    rows = points.join(ends, "path")
    kept = saved(rows.filter("seq = lo or seq = hi").select("path", "seq"))
    left = saved(rows.filter("seq > lo and seq < hi").select("path", "seq", "x", "y", "lo", "hi"))
    for done in itertools.count(1):
        if not left.limit(1).count():
            return points.join(kept.distinct(), ["path", "seq"], "left_semi")
        a = points.select("path", F.col("seq").alias("lo"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        b = points.select("path", F.col("seq").alias("hi"), F.col("x").alias("bx"), F.col("y").alias("by"))
        r = left.join(a, ["path", "lo"]).join(b, ["path", "hi"])
        dx, dy, ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
        n = dx * dx + dy * dy
        d = F.sqrt(F.when(n < 1e-12, ux * ux + uy * uy).otherwise((ux * dy - uy * dx) * (ux * dy - uy * dx) / F.nullif(n, F.lit(0.0))))
        far = r.withColumn("d", d).groupBy("path", "lo", "hi").agg(F.max(F.struct("d", (-F.col("seq")).alias("m"))).alias("s"))
        far = saved(far.filter(F.col("s.d") > tolerance).select("path", "lo", "hi", (-F.col("s.m")).alias("mid")))
        kept = kept.unionByName(far.select("path", F.col("mid").alias("seq")))
        if done % 16 == 0:
            kept = saved(kept)
        left = left.join(far, ["path", "lo", "hi"]).filter("seq <> mid")
        left = saved(left.withColumns({"lo": F.when(F.col("seq") > F.col("mid"), F.col("mid")).otherwise(F.col("lo")), "hi": F.when(F.col("seq") < F.col("mid"), F.col("mid")).otherwise(F.col("hi"))}).drop("mid"))


def containment_groups(tree: DataFrame) -> DataFrame:
    """Rings linked by containment: the smallest ring of each linked set, from ``(geom_id, ring_id, parent)``."""
    nodes = tree.select("geom_id", F.col("ring_id").alias("node"))
    links = tree.filter("parent is not null").select("geom_id", F.col("ring_id").alias("a"), F.col("parent").alias("b"))
    return component_labels(nodes, links, "geom_id")


def cleared_cells(df: DataFrame, radius: float, size: float) -> DataFrame:
    """Cells whose centre a disc of ``radius`` sweeps along the cuts, its edge included, per job: ``cells`` and their area.

    Centres beside a cut count by their distance from its line, all others by that from the nearer end as given."""
    rows = ops.with_previous(df).filter(is_("LINE_TO") & F.col("px").isNotNull())
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - radius) / size), F.floor((F.greatest(a, b) + radius) / size))
    cells = rows.withColumn("cx", F.explode(span("px", "x"))).withColumn("cy", F.explode(span("py", "y")))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    at = [((F.col(f"c{c}") + 0.5) * size) for c in "xy"]
    ux, uy, vx, vy = at[0] - F.col("px"), at[1] - F.col("py"), at[0] - F.col("x"), at[1] - F.col("y")
    n, along, across, r2 = dx * dx + dy * dy, ux * dx + uy * dy, ux * dy - uy * dx, F.lit(float(radius * radius))
    near = F.when((n < 1e-18) | (along <= 0), ux * ux + uy * uy <= r2).when(along >= n, vx * vx + vy * vy <= r2).otherwise(across * across <= r2 * n)
    return cells.filter(near).select("job_id", "cx", "cy").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * size * size).alias("area"))


def _q(f, *names):
    return lambda spark, sf_dir: rounded(f(*[table(spark, sf_dir, n) for n in names]))


def _as_pieces(d: DataFrame) -> DataFrame:
    """Layers as workpieces, so that jobs have many."""
    return d.withColumn("cmd", F.when(is_("LAYER_START"), "WORKPIECE_START").when(is_("LAYER_END"), "WORKPIECE_END").otherwise(F.col("cmd")))


def _groups(r: DataFrame) -> DataFrame:
    from pathloom.operators.spatial import hierarchy

    return containment_groups(hierarchy(r))


QUERIES = {
    "convex_hulls": _q(lambda d: convex_hulls(d.filter(is_moving()), "job_id"), "commands"),
    "nearest_order": _q(nearest_order, "commands"),
    "workpiece_order": _q(lambda d: workpiece_order(_as_pieces(d)), "commands"),
    "simplified_paths": _q(lambda d: simplified(d.filter(is_moving()).select(F.col("job_id").alias("path"), "seq", "x", "y"), 25.0), "commands"),
    "containment_groups": _q(_groups, "rings"),
    "cleared_cells": _q(lambda d: cleared_cells(d, 2.0, 2.0), "commands"),
}
from pathloom.operators.commands import _lag  # noqa: E402
from pathloom.operators.spatial import _HOLDS  # noqa: E402
from pathloom.sources.derive import cte  # noqa: E402

ORACLE_SQL = {
    "containment_groups": f"""{_HOLDS.replace('WITH ', 'WITH RECURSIVE ', 1)}, li AS (SELECT geom_id, ring_id AS a, parent AS b FROM tree WHERE parent IS NOT NULL UNION SELECT geom_id, parent, ring_id FROM tree WHERE parent IS NOT NULL),
 rr AS (SELECT geom_id, ring_id AS node, ring_id AS label FROM tree UNION SELECT li.geom_id, li.b, rr.label FROM rr JOIN li ON li.geom_id = rr.geom_id AND li.a = rr.node AND rr.label < li.b)
 SELECT geom_id, node, min(label) AS label FROM rr GROUP BY ALL""",
    "cleared_cells": f"""{cte('commands')}, p AS (SELECT *, {_lag('x')} AS px, {_lag('y')} AS py FROM commands), l AS (SELECT * FROM p WHERE cmd = 'LINE_TO' AND px IS NOT NULL),
 c AS (SELECT l.*, unnest(range(floor((least(px, x) - 2) / 2)::BIGINT, floor((greatest(px, x) + 2) / 2)::BIGINT + 1)) AS cx FROM l),
 d AS (SELECT c.*, unnest(range(floor((least(py, y) - 2) / 2)::BIGINT, floor((greatest(py, y) + 2) / 2)::BIGINT + 1)) AS cy FROM c),
 t AS (SELECT *, (x - px) * (x - px) + (y - py) * (y - py) AS n, (cx * 2 + 1 - px) * (x - px) + (cy * 2 + 1 - py) * (y - py) AS along, (cx * 2 + 1 - px) * (y - py) - (cy * 2 + 1 - py) * (x - px) AS across FROM d),
 u AS (SELECT DISTINCT job_id, cx, cy FROM t WHERE CASE WHEN n < 1e-18 OR along <= 0 THEN (cx * 2 + 1 - px) * (cx * 2 + 1 - px) + (cy * 2 + 1 - py) * (cy * 2 + 1 - py) <= 4
  WHEN along >= n THEN (cx * 2 + 1 - x) * (cx * 2 + 1 - x) + (cy * 2 + 1 - y) * (cy * 2 + 1 - y) <= 4 ELSE across * across <= 4 * n END)
 SELECT job_id, count(*) AS cells, count(*) * 4.0::DOUBLE AS area FROM u GROUP BY job_id""",
}
