"""Pairs of small rings judged where they meet: rings go to tasks in blocks, so no row is made for a pair that is only looked at.

A ring is a row with its box and vertices, a copy for each cell that its box touches. The rings of a cell are dealt to
blocks by hash; a task has two blocks and compares their rings in tiles with numpy. What is shuffled are rings, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.grid import in_cells

#: Rings of four vertices that a block has at most on average, where a task hands on sums, and where it hands on pairs; pairs that are
#: looked at in one step.
BLOCK, PAIR_BLOCK, TILE = 1 << 17, 1 << 13, 1 << 17
#: Names of the columns that are numbers.
_NUMBERS = ["ring_id", "x0", "y0", "x1", "y1", "signed_area", "n"]


class Rings:
    """Rings of a group, by signed area's size and id; vertex ``k`` of all rings lies in one row of ``ax, ay``, the next one in ``bx, by``.

    Shorter rings repeat their last vertex before they close: such edges have no length, so nothing crosses or lies between.
    """

    def __init__(self, table: pa.Table):
        col = {c: table.column(c).to_numpy() for c in [*_NUMBERS, "cx0", "cy0", "own"]}
        flat = [np.asarray(pa.concat_arrays(table.column(c).chunks).flatten(), np.float64) for c in ("xs", "ys")]
        order = np.lexsort([col["ring_id"], np.abs(col["signed_area"])])
        start = (np.cumsum(col["n"]) - col["n"])[order]
        for name, values in col.items():
            setattr(self, name, values[order])
        self.area, self.edges = np.abs(self.signed_area), int(self.n.max())
        k, last = np.arange(self.edges)[:, None], self.n - 1
        here, ahead = np.minimum(k, last), np.where(k < last, k + 1, np.where(k == last, 0, last))
        self.ax, self.ay, self.bx, self.by = (v[start + at] for at in (here, ahead) for v in flat)
        px, py, qx, qy = self.ax - self.x0, self.ay - self.y0, self.bx - self.x0, self.by - self.y0
        self.own_area = np.abs((px * qy - qx * py).sum(axis=0) / 2)  # from its own corner, so rounded less

    @classmethod
    def in_order(cls, rows: pa.StructArray) -> Rings:
        """Rings of the rows ``x0, y0, x1, y1, n, xs, ys`` in their order, with no areas, and numbers for ids."""
        flat = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
        none = pa.array(np.zeros(len(rows)))
        return cls(pa.table(flat | {"ring_id": pa.array(np.arange(len(rows))), "signed_area": none, "cx0": none, "cy0": none, "own": none}))

    def inside(self, i: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Is point ``x, y`` on an edge of ring ``i``, and is the number of edges to its right odd?"""
        on, odd = np.zeros(len(i), bool), np.zeros(len(i), bool)
        for ax, ay, bx, by in zip(self.ax, self.ay, self.bx, self.by, strict=True):
            ax, ay, bx, by = ax[i], ay[i], bx[i], by[i]
            dx, dy, px, py = bx - ax, by - ay, x - ax, y - ay
            on |= (np.abs(px * dy - py * dx) < 1e-9) & (x >= np.minimum(ax, bx)) & (x <= np.maximum(ax, bx)) & (y >= np.minimum(ay, by)) & (y <= np.maximum(ay, by))
            odd ^= ((ay > y) != (by > y)) & (py * dx / dy + ax > x)
        return on, odd


    def odd(self, i: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Is the number of edges of ring ``i`` to the right of point ``x, y`` odd?"""
        odd = np.zeros(len(i), bool)
        for ax, ay, bx, by in zip(self.ax, self.ay, self.bx, self.by, strict=True):
            ay, by = ay[i], by[i]
            s = np.flatnonzero((ay > y) != (by > y))
            at, ay, by = i[s], ay[s], by[s]
            odd[s] ^= (y[s] - ay) * (bx[at] - ax[at]) / (by - ay) + ax[at] > x[s]
        return odd


def near(a: Rings, i: np.ndarray, b: Rings, j: np.ndarray, reach: float = 0.0) -> np.ndarray:
    """Does the box of an edge of ``a[i]`` touch the box of ``b[j]``, grown by ``reach``?"""
    hit, x0, y0, x1, y1 = np.zeros(len(i), bool), b.x0[j] - reach, b.y0[j] - reach, b.x1[j] + reach, b.y1[j] + reach
    for ax, ay, bx, by in zip(a.ax, a.ay, a.bx, a.by, strict=True):
        hit |= (np.maximum(ax, bx)[i] >= x0) & (np.minimum(ax, bx)[i] <= x1) & (np.maximum(ay, by)[i] >= y0) & (np.minimum(ay, by)[i] <= y1)
    return hit


def crossing(a: Rings, i: np.ndarray, b: Rings, j: np.ndarray) -> np.ndarray:
    """Do edges of ``a[i]`` and ``b[j]`` properly cross?"""
    out = np.zeros(len(i), bool)
    some = np.flatnonzero(near(a, i, b, j))
    some = some[near(b, j[some], a, i[some])]
    i, j, hit = i[some], j[some], np.zeros(len(some), bool)
    side = lambda x0, y0, x1, y1, x, y: (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
    for e in zip(a.ax, a.ay, a.bx, a.by, strict=True):
        ax, ay, bx, by = (v[i] for v in e)
        for f in zip(b.ax, b.ay, b.bx, b.by, strict=True):
            px, py, qx, qy = (v[j] for v in f)
            hit |= (side(ax, ay, bx, by, px, py) * side(ax, ay, bx, by, qx, qy) < 0) & (side(px, py, qx, qy, ax, ay) * side(px, py, qx, qy, bx, by) < 0)
    out[some] = hit
    return out


def _half(a: Rings, i: np.ndarray, b: Rings, j: np.ndarray, left: float) -> np.ndarray:
    """Sum of the cross products of the pieces of ``a[i]`` inside ``b[j]``, both turning left; pieces are looked at ``left`` of them.
    Products are taken from the corner of the common box, so that they are no larger than the area."""
    total, ox, oy = np.zeros(len(i)), np.maximum(a.x0[i], b.x0[j]), np.maximum(a.y0[i], b.y0[j])
    flip_a, flip_b = a.signed_area[i] < 0, b.signed_area[j] < 0
    turned = lambda r, k, at, flip: [np.where(flip, v[k][at], u[k][at]) for u, v in ((r.ax, r.bx), (r.ay, r.by), (r.bx, r.ax), (r.by, r.ay))]
    for k in range(a.edges):
        ax, ay, bx, by = turned(a, k, i, flip_a)
        rx, ry = bx - ax, by - ay
        n, cuts = rx * rx + ry * ry, [(np.zeros(len(i)), ax, ay), (np.ones(len(i)), bx, by)]
        for m in range(b.edges):
            cx, cy, dx, dy = turned(b, m, j, flip_b)
            sx, sy = dx - cx, dy - cy
            den, off = rx * sy - ry * sx, (cx - ax) * ry - (cy - ay) * rx
            flat, u = np.abs(den) < 1e-12, off / den
            own = ~flat & (u >= -1e-12) & (u <= 1 + 1e-12)
            line = flat & (np.abs(off) < 1e-9)
            t = np.where(own, ((cx - ax) * sy - (cy - ay) * sx) / den, np.where(line, ((cx - ax) * rx + (cy - ay) * ry) / n, 0.0))
            # an upright or level edge gives its own coordinate, without rounding
            cuts.append((t, np.where(line | (sx == 0), cx, ax + t * rx), np.where(line | (sy == 0), cy, ay + t * ry)))
            if line.any():
                cuts.append((np.where(line, ((dx - ax) * rx + (dy - ay) * ry) / n, 0.0), dx, dy))
        t, x, y = (np.stack(v) for v in zip(*cuts, strict=True))
        idle = ~((t > 1e-12) & (t < 1 - 1e-12))
        idle[:2] = False
        t[idle], x[idle], y[idle] = 0.0, np.broadcast_to(ax, t.shape)[idle], np.broadcast_to(ay, t.shape)[idle]
        order = np.argsort(t, axis=0, kind="stable")
        t, x, y = (np.take_along_axis(v, order, axis=0) for v in (t, x, y))
        for m in range(len(t) - 1):
            own = np.flatnonzero(t[m + 1] - t[m] >= 1e-9)
            x0, y0, x1, y1 = x[m][own], y[m][own], x[m + 1][own], y[m + 1][own]
            shift = left / np.hypot(x1 - x0, y1 - y0)
            on, odd = b.inside(j[own], (x0 + x1) / 2 - (y1 - y0) * shift, (y0 + y1) / 2 + (x1 - x0) * shift)
            x0, y0, x1, y1 = x0 - ox[own], y0 - oy[own], x1 - ox[own], y1 - oy[own]
            total[own] += np.where(odd & ~on, x0 * y1 - x1 * y0, 0.0)
    return total


def common(a: Rings, i: np.ndarray, b: Rings, j: np.ndarray) -> np.ndarray:
    """Area that ``a[i]`` and ``b[j]`` have in common, as ``overlap_areas``. Where no edge of one comes to the box of the other, that
    box lies in it or beside it."""
    out = np.zeros(len(i))
    far_a, far_b = ~near(a, i, b, j), ~near(b, j, a, i)
    s = np.flatnonzero(far_a & ~far_b)
    out[s] = np.where(a.odd(i[s], b.ax[0][j[s]], b.ay[0][j[s]]), b.own_area[j[s]], 0.0)
    s = np.flatnonzero(far_b & ~far_a)
    out[s] = np.where(b.odd(j[s], a.ax[0][i[s]], a.ay[0][i[s]]), a.own_area[i[s]], 0.0)
    s = np.flatnonzero(~far_a & ~far_b)
    i, j = i[s], j[s]
    out[s] = (_half(a, i, b, j, 1e-7) + _half(b, j, a, i, 0.0)) / 2
    return out


def distance2(a: Rings, i: np.ndarray, b: Rings, j: np.ndarray) -> np.ndarray:
    """Smallest squared distance from the middle of an edge of ``a[i]`` to the edges of ``b[j]``."""
    out = np.full(len(i), np.inf)
    for k, mid in enumerate(zip(a.ax, a.ay, a.bx, a.by, strict=True)):
        ax, ay, bx, by = (v[i] for v in mid)
        x, y, real = (ax + bx) / 2, (ay + by) / 2, k < a.n[i]
        for cx, cy, dx, dy in zip(b.ax, b.ay, b.bx, b.by, strict=True):
            cx, cy, dx, dy = cx[j], cy[j], dx[j], dy[j]
            ex, ey = dx - cx, dy - cy
            n = ex * ex + ey * ey
            t = np.where(n < 1e-18, 0.0, np.minimum(1.0, np.maximum(0.0, ((x - cx) * ex + (y - cy) * ey) / n)))
            ux, uy = x - (cx + t * ex), y - (cy + t * ey)
            out = np.where(real, np.fmin(out, ux * ux + uy * uy), out)
    return out


def ring_rows(rings: DataFrame, measures: DataFrame, most: int) -> DataFrame:
    """A row for each ring of at most ``most`` vertices: ``geom_id``, its numbers, and its vertices ``xs, ys`` in their order."""
    keys = ["geom_id", "ring_id"]
    line = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    boxes = measures.filter(F.col("n") <= most).select(*keys, F.col("min_x").alias("x0"), F.col("min_y").alias("y0"), F.col("max_x").alias("x1"), F.col("max_y").alias("y1"), "signed_area", "n")
    return boxes.join(rings.groupBy(*keys).agg(line.alias("v")), keys).select(*keys, "x0", "y0", "x1", "y1", "signed_area", "n", F.col("v.x").alias("xs"), F.col("v.y").alias("ys"))


def judged(rows: DataFrame, size: float, block: int, reach: float, judge: Callable[..., Iterator[dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """What ``judge(a, b, tiles)`` yields for rings ``a`` and ``b`` of one geometry whose boxes, grown by ``reach``, share a cell; ``geom_id`` is added.

    Every ordered pair of rings is in one of the ``tiles()``, (i, j) of ``a`` and ``b``, once: in the lowest cell that both touch, here
    ``a.cell``. Boxes touch, give or take ``reach``. ``schema`` names the columns, each a ``ring``, ``long`` or ``double``. What is
    yielded is handed on tile by tile, so a task holds two blocks of rings and no list of their pairs.
    """
    cells = in_cells(rows, *map(F.col, ("x0", "y0", "x1", "y1")), size, reach)
    at = ["geom_id", "cx", "cy"]
    blocks = cells.groupBy(*at).agg(F.ceil(F.sum(F.greatest(F.col("n") / 4, F.lit(1.0))) / block).alias("blocks"))
    dealt = cells.join(blocks, at).withColumn("own", F.pmod(F.xxhash64("ring_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).drop("blocks")
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    names, kinds = zip(*(part.split() for part in schema.split(",")), strict=True)
    geom_kind, ring_kind = (rows.schema[c].dataType.simpleString() for c in ("geom_id", "ring_id"))

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        cx, cy, low, high = (v.as_py() for v in key[1:])
        own = table.column("own").to_numpy()
        sides = [Rings(table.filter(pa.array(own == b))) for b in dict.fromkeys((low, high)) if (own == b).any()]
        types = {"ring": table.schema.field("ring_id").type, "long": pa.int64(), "double": pa.float64()}
        del table
        for side in sides:
            side.cell = (cx, cy)
        if low != high and len(sides) < 2:
            sides = []

        def tiles(a: Rings, b: Rings):
            def pairs():
                step = max(1, TILE // len(b.n))
                for lo in range(0, len(a.n), step):
                    c = lambda v: v[lo : lo + step][:, None]  # noqa: B023, E731
                    ok = (np.maximum(c(a.cx0), b.cx0) == cx) & (np.maximum(c(a.cy0), b.cy0) == cy)
                    for p, q, u, v in ((a.x0, a.x1, b.x0, b.x1), (a.y0, a.y1, b.y0, b.y1)):
                        ok &= (c(p) - reach <= v) & (u - reach <= c(q))
                    i, j = np.nonzero(ok)
                    if len(i):
                        yield i + lo, j
            return pairs

        with np.errstate(all="ignore"):
            for a, b in [(sides[0], sides[0])] if low == high else [(sides[0], sides[1]), (sides[1], sides[0])] if sides else []:
                for t in judge(a, b, tiles(a, b)):
                    if len(t[names[0]]):
                        columns = [pa.array(t[c], types[k]) for c, k in zip(names, kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(columns[0])), *columns], names=["geom_id", *names])

    columns = ", ".join(f"{c} {ring_kind if k == 'ring' else k}" for c, k in zip(names, kinds, strict=True))
    # few bytes are much work here, so tasks must not be made by bytes
    spread = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *at, "low", "high")
    return spread.groupBy(*at, "low", "high").applyInArrow(group, f"geom_id {geom_kind}, {columns}")
