"""Cleaning and cutting of contours and cuts: gaps, repeats, regions, leads, tabs, heights of rings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geometry import hypot, on_segment
from pathloom.functions.grid import in_cells, joined
from pathloom.functions.loops import discard, saved
from pathloom.functions.ring_pairs import Rings, ring_rows
from pathloom.functions.ring_trees import region_pieces
from pathloom.functions.windows import before, ffill, islands, ordered
from pathloom.operators.commands import by_job, is_, is_moving, rounded, with_subpaths
from pathloom.operators.rings import edges, ring_measures
from pathloom.operators.spatial import _SHIFT, ROW_EDGES, _cell_of, _crossing, _large, box_cell, in_own_ring, nearest_edges, pieces, ring_boxes, ring_edges, sweep_hits
from pathloom.sources.derive import cte, table

#: Points compared along a contour, besides its vertices.
SAMPLES = 32
#: Cuts of a block that meets all rings of a cell.
CUTS = 1 << 14


def first_kept(nodes: DataFrame, pairs: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """``nodes(keys, node)`` that stay when each is dropped if it equals an earlier one that stayed: ``pairs(keys, a, b)``, a before b.

    Only nodes in pairs take part. In a round, nodes with nothing before them stay. A node with one node before it is the
    opposite of that one, so chains of such nodes are settled at once, by jumps that double: a node at an even distance from
    a chain's head that stays, stays too. What equals a node that stays goes, and pairs with settled nodes are done.
    Chains of any length so take one round; rounds grow only with chains of nodes that equal several earlier ones.
    """
    pairs = saved(pairs.select(*keys, "a", "b").distinct())
    out: list[DataFrame] = []
    left = pairs
    while left.limit(1).count():
        before = saved(left.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("top")))
        heads = left.select(*keys, F.col("a").alias("b")).distinct().join(before, [*keys, "b"], "left_anti")
        chain = saved(before.filter("n = 1").select(*keys, "b", "top", F.lit(True).alias("odd")))
        while True:
            above = chain.select(*keys, F.col("b").alias("top"), F.col("top").alias("over"), F.col("odd").alias("o"))
            longer = saved(chain.join(above, [*keys, "top"], "left").select(*keys, "b", F.coalesce("over", "top").alias("top"), F.when(F.col("o").isNull(), F.col("odd")).otherwise(F.col("odd") != F.col("o")).alias("odd"), F.col("over").isNotNull().alias("moved")))
            discard(chain)
            chain = longer.drop("moved")
            if not longer.filter("moved").limit(1).count():
                break
        settled = chain.join(heads.withColumnRenamed("b", "top"), [*keys, "top"], "left_semi")
        keep = saved(heads.unionByName(settled.filter("not odd").select(*keys, "b")))
        gone = left.join(keep.withColumnRenamed("b", "a"), [*keys, "a"], "left_semi").select(*keys, "b").unionByName(settled.filter("odd").select(*keys, "b"))
        gone = saved(gone.distinct().withColumnRenamed("b", node))
        out.append(gone)
        done = keep.withColumnRenamed("b", node).unionByName(gone)
        rest = left
        for end in ("a", "b"):
            rest = rest.join(done.withColumnRenamed(node, end), [*keys, end], "left_anti")
        used, left = left, saved(rest)
        discard(used, before, longer, keep)
    return nodes.join(reduce(DataFrame.unionByName, out), [*keys, node], "left_anti") if out else nodes


def deduplicated(df: DataFrame, tolerance: float) -> DataFrame:
    """Commands without cuts that equal an earlier one of their subpath: same kind, ends, and for arcs centres, within
    ``tolerance``. Travels and other rows stay."""
    rows = with_subpaths(df)
    cuts = rows.filter(is_("LINE_TO", "ARC_TO")).select("job_id", "subpath", "cmd", "seq", "x", "y", "z", "ci", "cj", "cw")
    a = in_cells(cuts, F.col("x"), F.col("y"), F.col("x"), F.col("y"), max(tolerance, 1e-9), tolerance)
    b = in_cells(cuts.toDF("job_id", "subpath", "cmd", "later", "qx", "qy", "qz", "qi", "qj", "qw"), F.col("qx"), F.col("qy"), F.col("qx"), F.col("qy"), max(tolerance, 1e-9))
    near = joined(a, b, "job_id", "subpath", "cmd").filter("seq < later")
    same = (F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2 + (F.col("z") - F.col("qz")) ** 2 <= tolerance**2
    arcs = ((F.col("ci") - F.col("qi")) ** 2 + (F.col("cj") - F.col("qj")) ** 2 <= tolerance**2) & (F.col("cw") == F.col("qw"))
    pairs = near.filter(same & ((F.col("cmd") == "LINE_TO") | arcs)).select("job_id", F.col("seq").alias("a"), F.col("later").alias("b"))
    return first_kept(rows.drop("subpath"), pairs, ["job_id"], "seq")


def gaps_closed(df: DataFrame, tolerance: float) -> DataFrame:
    """Subpaths that end within ``tolerance`` of their start end there, and a travel shorter than that becomes a cut of no length.

    Moving rows only; of a subpath of one row nothing is moved.
    """
    rows = with_subpaths(df.filter(is_moving()))
    whole = Window.partitionBy("job_id", "subpath").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    point = F.struct("x", "y", "z")
    rows = rows.withColumns({"s": F.first(point).over(whole), "e": F.last(point).over(whole), "last": F.last("seq").over(whole), "n": F.count(F.lit(1)).over(whole)})
    gap = lambda p, q: sum((p[c] - q[c]) ** 2 for c in "xyz")
    close = (F.col("n") >= 2) & (F.col("seq") == F.col("last")) & (gap(F.col("s"), F.col("e")) < tolerance**2)
    rows = rows.withColumns({c: F.when(close, F.col(f"s.{c}")).otherwise(F.col(c)) for c in "xyz"})
    rows = rows.withColumn("p", F.lag(point).over(by_job()))
    short = is_("MOVE_TO") & F.col("p").isNotNull() & (gap(F.col("p"), {c: F.col(c) for c in "xyz"}) < tolerance**2)
    short = F.coalesce(short, F.lit(False))
    out = rows.withColumns({"cmd": F.when(short, "LINE_TO").otherwise(F.col("cmd")), **{c: F.when(short, F.col(f"p.{c}")).otherwise(F.col(c)) for c in "xyz"}})
    return out.select(*df.columns)


def _samples(rings: DataFrame) -> DataFrame:
    """Vertices and evenly spaced points of every ring."""
    e = edges(rings).select("geom_id", "ring_id", "seq", "x", "y", "nx", "ny").withColumn("len", hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))
    w = ordered("geom_id", "ring_id")
    e = e.withColumns({"upto": F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("len").over(Window.partitionBy("geom_id", "ring_id"))})
    step = F.col("total") / SAMPLES
    e = e.filter("len > 0").withColumn("k", F.explode(F.sequence(F.ceil((F.col("upto") - F.col("len")) / step - 1e-9), F.floor(F.col("upto") / step + 1e-9))))
    t = F.least(F.greatest((F.col("k") * step - F.col("upto") + F.col("len")) / F.col("len"), F.lit(0.0)), F.lit(1.0))
    along = e.select("geom_id", "ring_id", (F.col("x") + t * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("ny") - F.col("y"))).alias("y"))
    return rings.select("geom_id", "ring_id", "x", "y").unionByName(along)


def contour_matches(ours: DataFrame, theirs: DataFrame, tolerance: float) -> DataFrame:
    """Pairs ``geom_id, ring_id, other`` of contours that trace the same path, whatever their direction and start.

    Candidates share a cell of the box's lower corner, or a neighbouring one, have equal boxes, and lengths within four
    tolerances. Then the vertices and 32 points of either must lie on the other one.
    """
    box = lambda r: ring_boxes(r).join(ring_measures(r).select("geom_id", "ring_id", "perimeter"), ["geom_id", "ring_id"])
    a, b = box(ours), box(theirs).toDF("geom_id", "other", "u0", "v0", "u1", "v1", "length")
    size = max(tolerance, 1e-9) * 4
    near = joined(in_cells(a, F.col("x0"), F.col("y0"), F.col("x0"), F.col("y0"), size, tolerance), in_cells(b, F.col("u0"), F.col("v0"), F.col("u0"), F.col("v0"), size), "geom_id")
    fits = F.abs(F.col("perimeter") - F.col("length")) <= 4 * tolerance + 1e-9
    for p, q in (("x0", "u0"), ("y0", "v0"), ("x1", "u1"), ("y1", "v1")):
        fits = fits & (F.abs(F.col(p) - F.col(q)) <= tolerance)
    pairs = saved(near.filter(fits).select("geom_id", "ring_id", "other"))

    def uncovered(points: DataFrame, lines: DataFrame, mine: str, yours: str) -> DataFrame:
        rows = pairs.join(_samples(points).withColumnRenamed("ring_id", mine), ["geom_id", mine]).join(ring_edges(lines, "geom_id").withColumnRenamed("ring_id", yours).drop("seq"), ["geom_id", yours])
        d2 = on_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))[3]
        far = rows.groupBy("geom_id", "ring_id", "other", "x", "y").agg(F.min(d2).alias("d2")).filter(F.col("d2") > tolerance**2)
        return far.select("geom_id", "ring_id", "other").distinct()

    return pairs.join(uncovered(ours, theirs, "ring_id", "other").unionByName(uncovered(theirs, ours, "other", "ring_id")), ["geom_id", "ring_id", "other"], "left_anti")


def unique_contours(rings: DataFrame, tolerance: float) -> DataFrame:
    """Rings of each geometry without those that repeat an earlier one that stays."""
    pairs = contour_matches(rings, rings, tolerance).filter("ring_id < other").select("geom_id", F.col("ring_id").alias("a"), F.col("other").alias("b"))
    return first_kept(rings.select("geom_id", "ring_id").distinct(), pairs, ["geom_id"], "ring_id")


def same_shapes(ours: DataFrame, theirs: DataFrame, tolerance: float) -> DataFrame:
    """For geometries of both tables: as many contours, and each of either with a match in the other. No contours never match."""
    count = lambda r, n: r.groupBy("geom_id").agg(F.countDistinct("ring_id").alias(n))
    m = contour_matches(ours, theirs, tolerance).groupBy("geom_id").agg(F.countDistinct("ring_id").alias("p"), F.countDistinct("other").alias("q"))
    rows = count(ours, "n").join(count(theirs, "k"), "geom_id").join(m, "geom_id", "left")
    return rows.select("geom_id", ((F.col("n") == F.col("k")) & (F.coalesce("p", F.lit(0)) == F.col("n")) & (F.coalesce("q", F.lit(0)) == F.col("k"))).alias("same"))


def cut_by_regions(cuts: DataFrame, regions: DataFrame, keep_inside: bool) -> DataFrame:
    """Pieces of straight cuts ``(job_id, seg, geom_id, x0, y0, x1, y1, z0, z1)`` inside, or outside, any ring of their geometry.

    A cut is cut where it crosses the edges of a ring, and the middle of every part is tested against that ring; parts end
    where they do for any ring. Edges belong to the inside. Z changes evenly along a cut. ``part`` numbers the pieces of a cut,
    ``jump`` tells those that the pen has to travel to.

    Cuts near their geometry go to the task of the one cell where they begin, which has all rings that can reach them; cells are as
    large as the mean box, larger for longer cuts. A task hands on pieces and shuffles nothing: a first pass finds the first and
    the last piece of each cut, which tell the jumps between cuts, a second one makes all pieces but the first.
    Regions with large rings go through ``_cut_by_edges``.
    """
    measures = saved(ring_measures(regions))
    if _large(measures) is not None:
        return _cut_by_edges(cuts, regions, keep_inside)
    ends = ["x0", "y0", "z0", "x1", "y1", "z1"]
    cuts = cuts.select("job_id", "seg", "geom_id", *ends)
    around = saved(measures.groupBy("geom_id").agg(F.min("min_x").alias("u0"), F.min("min_y").alias("v0"), F.max("max_x").alias("u1"), F.max("max_y").alias("v1")))
    met = (F.least("x0", "x1") <= F.col("u1")) & (F.greatest("x0", "x1") >= F.col("u0")) & (F.least("y0", "y1") <= F.col("v1")) & (F.greatest("y0", "y1") >= F.col("v0"))
    beside = cuts.join(around, "geom_id", "left").withColumn("met", F.coalesce(met, F.lit(False))).drop("u0", "v0", "u1", "v1")
    near = saved(beside.filter("met").drop("met"))
    size = _cell_of(measures)
    level = F.greatest(F.ceil(F.log2(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))) / size)), F.lit(0)).cast("int")
    at = ["geom_id", "level", "cx", "cy"]
    cell = lambda v: F.floor(v / (F.pow(F.lit(2.0), "level") * size))
    placed = near.withColumn("level", F.coalesce(level, F.lit(0))).withColumns({"cx": cell(F.least("x0", "x1")), "cy": cell(F.least("y0", "y1"))})
    blocks = saved(placed.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / CUTS).cast("int").alias("blocks")))
    placed = placed.join(blocks, at).withColumn("block", F.pmod(F.xxhash64("job_id", "seg"), F.col("blocks")).cast("int")).drop("blocks")
    reach = lambda lo, hi: F.sequence(cell(F.col(lo)) - 1, cell(F.col(hi)))
    rows = ring_rows(regions, measures, ROW_EDGES).join(blocks.select("geom_id", "level").distinct(), "geom_id")
    rows = rows.withColumn("cx", F.explode(reach("x0", "x1"))).withColumn("cy", F.explode(reach("y0", "y1"))).join(blocks, at)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*at, "block", F.struct("x0", "y0", "x1", "y1", "n", "xs", "ys").alias("ring"))
    both = placed.unionByName(rows, allowMissingColumns=True).repartition(int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *at, "block").groupBy(*at, "block")

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Names of the cuts, and for pieces the row of their cut, their number and their ends."""
        table = pa.Table.from_batches(list(batches))
        ring = table.column("ring").combine_chunks()
        is_ring = np.asarray(ring.is_valid())
        table, ring = table.filter(pa.array(~is_ring)).select(["job_id", "seg", *ends]), ring.filter(pa.array(is_ring))
        if not len(table):
            return
        p = {c: table.column(c).to_numpy() for c in ends}
        with np.errstate(all="ignore"):
            for cut, t0, t1 in region_pieces(p["x0"], p["y0"], p["x1"], p["y1"], Rings.in_order(ring), keep_inside) if len(ring) else _all_of(len(table), keep_inside):
                first = np.append(True, cut[1:] != cut[:-1])
                part = np.arange(len(cut)) - np.maximum.accumulate(np.where(first, np.arange(len(cut)), 0))
                place = [p[f"{c}0"][cut] + t * (p[f"{c}1"][cut] - p[f"{c}0"][cut]) for t in (t0, t1) for c in "xyz"]
                yield table.select(["job_id", "seg"]), cut, part, place

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, cut, part, place in pieces_of(batches):
            first = np.flatnonzero(part == 0)
            last = np.append(first[1:], len(cut)) - 1
            yield from _batches(names.take(pa.array(cut[first])), [v[first] for v in place] + [v[last] for v in place[3:]], [*ends, "ex", "ey", "ez"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, cut, part, place in pieces_of(batches):
            own = np.flatnonzero(part > 0)
            jump = sum((e[own - 1] - s[own]) ** 2 for s, e in zip(place[:3], place[3:], strict=True)) > 1e-12
            yield from _batches(names.take(pa.array(cut[own])), [part[own].astype(np.int32), *[v[own] for v in place], jump], ["part", *ends, "jump"])

    kinds = ", ".join(f"{c} {cuts.schema[c].dataType.simpleString()}" for c in ("job_id", "seg"))
    doubles = lambda names: ", ".join(f"{c} double" for c in names)
    heads = both.applyInArrow(summed, f"{kinds}, {doubles([*ends, 'ex', 'ey', 'ez'])}")
    if not keep_inside:  # what is near no region stays whole
        at_end = {f"{c}1": F.col(f"{c}0") + F.lit(1.0) * (F.col(f"{c}1") - F.col(f"{c}0")) for c in "xyz"}
        far = beside.filter("not met").select("job_id", "seg", *ends).withColumns(at_end)
        heads = heads.unionByName(far.select("*", *[F.col(f"{c}1").alias(f"e{c}") for c in "xyz"]))
    pen = F.lag(F.struct("ex", "ey", "ez")).over(Window.partitionBy("job_id").orderBy("seg"))
    jump = F.coalesce((F.col("pen.ex") - F.col("x0")) ** 2 + (F.col("pen.ey") - F.col("y0")) ** 2 + (F.col("pen.ez") - F.col("z0")) ** 2 > 1e-12, F.lit(True))
    firsts = heads.withColumn("pen", pen).select("job_id", "seg", F.lit(0).alias("part"), *ends, jump.alias("jump"))
    return firsts.unionByName(both.applyInArrow(others, f"{kinds}, part int, {doubles(ends)}, jump boolean"))


def _all_of(n: int, keep_inside: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of cuts that no ring is near to: all outside."""
    return [] if keep_inside else [(np.arange(n), np.zeros(n), np.ones(n))]


def _batches(names: pa.Table, columns: list[np.ndarray], more: list[str]) -> Iterator[pa.RecordBatch]:
    for name, values in zip(more, columns, strict=True):
        names = names.append_column(name, pa.array(values))
    return iter(names.combine_chunks().to_batches())


def _cut_by_edges(cuts: DataFrame, regions: DataFrame, keep_inside: bool) -> DataFrame:
    """The same for regions with rings of any size.

    A cut meets the rings whose box it touches, each for itself: it is cut where it crosses the ring's edges, and the middle
    of every part is tested against that ring alone. Then all crossings of a cut are put in order, with how many rings
    begin and end to hold it there, and a running sum tells the pieces that any ring holds; so work grows with the
    crossings, not with pieces times rings. Cells are as large as the mean box.
    """
    boxes = saved(ring_boxes(regions))
    edge_rows = saved(ring_edges(regions, "geom_id"))
    size = box_cell(boxes)
    segments = cuts.select("job_id", "seg", "geom_id", F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    low, high = (F.least("ax", "bx"), F.least("ay", "by")), (F.greatest("ax", "bx"), F.greatest("ay", "by"))
    around = boxes.groupBy("geom_id").agg(F.min("x0").alias("u0"), F.min("y0").alias("v0"), F.max("x1").alias("u1"), F.max("y1").alias("v1"))
    near = segments.join(around, "geom_id").filter((low[0] <= F.col("u1")) & (high[0] >= F.col("u0")) & (low[1] <= F.col("v1")) & (high[1] >= F.col("v0"))).drop("u0", "v0", "u1", "v1")
    met = joined(in_cells(near, *low, *high, size), in_cells(boxes, *map(F.col, ("x0", "y0", "x1", "y1")), size), "geom_id")
    pairs = met.filter((low[0] <= F.col("x1")) & (high[0] >= F.col("x0")) & (low[1] <= F.col("y1")) & (high[1] >= F.col("y0"))).drop("x0", "y0", "x1", "y1")
    cutters = edge_rows.select("geom_id", "ring_id", F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    parts = saved(pieces(pairs, cutters, ["job_id", "seg", "ring_id"], ["geom_id", "ring_id"], size))
    middle = (F.col("t0") + F.col("t1")) / 2
    probe = parts.select("job_id", "seg", "geom_id", "ring_id", "t0", "t1", *[(F.col(f"a{c}") + middle * (F.col(f"b{c}") - F.col(f"a{c}"))).alias(c) for c in "xy"])
    held = in_own_ring(probe, edge_rows, "job_id", "seg", "t0", "t1", size=size).filter("on or odd").select("job_id", "seg", F.inline(F.array(F.struct(F.col("t0").alias("t"), F.lit(1).alias("k")), F.struct(F.col("t1").alias("t"), F.lit(-1).alias("k")))))
    at_all = parts.select("job_id", "seg", F.explode(F.array("t0", "t1")).alias("t"), F.lit(0).alias("k"))
    if not keep_inside:
        at_all = at_all.unionByName(cuts.select("job_id", "seg", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"), F.lit(0).alias("k")))
    w = ordered("job_id", "seg", by="t")
    steps = at_all.unionByName(held).groupBy("job_id", "seg", "t").agg(F.sum("k").alias("k"))
    steps = steps.select("job_id", "seg", F.col("t").alias("t0"), F.lead("t").over(w).alias("t1"), (F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0).alias("inside"))
    kept = steps.filter((F.col("t1") - F.col("t0") >= 1e-9) & (F.col("inside") if keep_inside else ~F.col("inside"))).join(cuts.drop("geom_id"), ["job_id", "seg"])
    at = lambda c, t: F.col(f"{c}0") + t * (F.col(f"{c}1") - F.col(f"{c}0"))
    out = kept.select("job_id", "seg", (F.row_number().over(ordered("job_id", "seg", by="t0")) - 1).alias("part"), *[at(c, F.col(t)).alias(f"{c}{t[1]}") for t in ("t0", "t1") for c in "xyz"])
    pen = F.lag(F.struct("x1", "y1", "z1")).over(Window.partitionBy("job_id").orderBy("seg", "part"))
    return out.withColumn("pen", pen).withColumn("jump", F.coalesce((F.col("pen.x1") - F.col("x0")) ** 2 + (F.col("pen.y1") - F.col("y0")) ** 2 + (F.col("pen.z1") - F.col("z0")) ** 2 > 1e-12, F.lit(True))).drop("pen")


def with_leads(df: DataFrame, lead_in: float, lead_out: float) -> DataFrame:
    """Lead-ins and lead-outs at zero power on the contours of vector sections: the rows of the job with ``part``.

    A contour is a MOVE_TO and the rows up to the next one inside a VECTOR_OUTLINE section, with a cut at least. Its travel
    (part 0) goes to the lead's start, then follow SET_POWER 0 (1), a cut to the contour's start (2) and, unless the
    contour sets it next, the power of its first cut (3); after its last row SET_POWER 0 (1) and the lead-out (2). The
    direction is that of the first and of the last command, straight or arc; without one there is no lead.
    """
    vector = F.col("section_type") == "VECTOR_OUTLINE"
    marker = is_("OPS_SECTION_START", "OPS_SECTION_END")
    inside = F.coalesce(ffill(F.when(is_("OPS_SECTION_START") & vector, True).when(is_("OPS_SECTION_END") & vector, False), by_job()), F.lit(False))
    edge = F.coalesce(marker & vector, F.lit(False))
    rows = df.withColumn("__in", inside & ~edge).withColumn("__line", islands((is_("MOVE_TO") & F.col("__in")) | edge, by_job()))
    rows = rows.withColumn("__power", F.coalesce(ffill(F.when(is_("SET_POWER"), F.col("val")), by_job()), F.lit(0.0)))
    w = ordered("job_id", "__line")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    point = F.when(is_moving(), F.struct("x", "y"))
    rows = rows.withColumn("__p", F.last(point, ignorenulls=True).over(before(w)))
    sx, sy = F.col("x") - F.col("__p.x"), F.col("y") - F.col("__p.y")
    side = F.when(F.col("cw"), -1.0).otherwise(1.0)
    arc = is_("ARC_TO")
    first = F.struct(F.when(arc, F.col("cj") * side).otherwise(sx).alias("x"), F.when(arc, -F.col("ci") * side).otherwise(sy).alias("y"))
    ox, oy = F.col("x") - F.col("__p.x") - F.col("ci"), F.col("y") - F.col("__p.y") - F.col("cj")
    final = F.struct(F.when(arc, -oy * side).otherwise(sx).alias("x"), F.when(arc, ox * side).otherwise(sy).alias("y"))
    cut = is_moving() & ~is_("MOVE_TO")
    real = cut & (hypot(sx, sy) >= 1e-9)
    rows = rows.withColumns({
        "__head": F.first("cmd").over(whole), "__cuts": F.count(F.when(cut, 1)).over(whole), "__end": F.last(F.when(is_moving(), F.col("seq")), ignorenulls=True).over(whole), "__tail": F.last("seq").over(whole),
        "__a": F.first(F.when(cut, F.struct(first.alias("t"), real.alias("ok"))), ignorenulls=True).over(whole), "__b": F.last(F.when(is_moving(), F.struct(final.alias("t"), real.alias("ok"), F.col("x").alias("x"), F.col("y").alias("y"), F.col("z").alias("z"))), ignorenulls=True).over(whole),
        "__first_power": F.first(F.when(cut, F.col("__power")), ignorenulls=True).over(whole), "__next": F.lead("cmd").over(w),
    })
    length = lambda t: F.nullif(hypot(F.col(f"{t}.x"), F.col(f"{t}.y")), F.lit(0.0))
    good = F.col("__in") & (F.col("__head") == "MOVE_TO") & (F.col("__cuts") >= 1)
    has_in = F.coalesce(good & F.col("__a.ok") & length("__a.t").isNotNull(), F.lit(False)) & F.lit(lead_in > 0)
    has_out = F.coalesce(good & F.col("__b.ok") & length("__b.t").isNotNull(), F.lit(False)) & F.lit(lead_out > 0)
    null = F.lit(None).cast("double")

    def row(part: int, cmd: Column, x: Column, y: Column, z: Column, val: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), cmd.alias("cmd"), x.alias("x"), y.alias("y"), z.alias("z"), val.alias("val"))

    start = is_("MOVE_TO")
    back = lambda c: F.col(c) - F.col(f"__a.t.{c}") / length("__a.t") * lead_in
    ahead = lambda c: F.col(f"__b.{c}") + F.col(f"__b.t.{c}") / length("__b.t") * lead_out
    power, line, zero = F.lit("SET_POWER"), F.lit("LINE_TO"), F.lit(0.0)
    lead = start & has_in
    emitted = F.array_compact(F.array(
        row(0, F.col("cmd"), F.when(lead, back("x")).otherwise(F.col("x")), F.when(lead, back("y")).otherwise(F.col("y")), F.col("z"), F.col("val")),
        F.when(lead, row(1, power, null, null, null, zero)), F.when(lead, row(2, line, F.col("x"), F.col("y"), F.col("z"), null)),
        F.when(start & (has_in | has_out) & ~F.coalesce(F.col("__next") == "SET_POWER", F.lit(False)), row(3, power, null, null, null, F.col("__first_power"))),
        F.when((F.col("seq") == F.col("__tail")) & has_out, row(4, power, null, null, null, zero)), F.when((F.col("seq") == F.col("__tail")) & has_out, row(5, line, ahead("x"), ahead("y"), F.col("__b.z"), null)),
    ))
    return rows.select("job_id", "seq", F.inline(emitted))


def assign_tabs(clips: DataFrame, rings: DataFrame) -> DataFrame:
    """The nearest contour of each tab ``(point_id, geom_id, x, y, width)`` of its geometry, if within twice the width: with ``at``,
    the tab's place along the contour from its first vertex."""
    hit = nearest_edges(clips.select("point_id", "geom_id", "x", "y"), ring_edges(rings, "geom_id"), "geom_id")
    near = hit.join(clips, ["point_id", "geom_id"]).filter(F.col("d2") <= 4 * F.col("width") ** 2)
    w = ordered("geom_id", "ring_id")
    e = ring_edges(rings, "geom_id").withColumn("len", hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    e = e.withColumn("from", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
    rows = near.join(e, ["geom_id", "ring_id", "seq"])
    t = on_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))[0]
    return rows.select("point_id", "geom_id", "ring_id", "width", (F.col("from") + t * F.col("len")).alias("at"))


def tab_gaps(clips: DataFrame, rings: DataFrame) -> DataFrame:
    """What remains of contours with tabs, as stretches of their edges: ``geom_id, ring_id, seq, from, to`` along the contour.

    Each tab takes half its width on both sides, also across the contour's end; stretches between are the complement of
    the united gaps on every edge, found by the running maximum of their ends.
    """
    e = ring_edges(rings, "geom_id").withColumn("len", hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    w = ordered("geom_id", "ring_id")
    e = e.withColumns({"e0": F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"), "total": F.sum("len").over(Window.partitionBy("geom_id", "ring_id"))})
    e = e.withColumn("e1", F.col("e0") + F.col("len")).select("geom_id", "ring_id", "seq", "e0", "e1", "total")
    gap = assign_tabs(clips, rings).select("geom_id", "ring_id", (F.col("at") - F.col("width") / 2).alias("g0"), (F.col("at") + F.col("width") / 2).alias("g1"))
    rows = e.join(gap, ["geom_id", "ring_id"])
    turns = rows.withColumn("turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumns({"g0": F.col("g0") + F.col("turn") * F.col("total"), "g1": F.col("g1") + F.col("turn") * F.col("total")})
    cover = turns.filter("g1 > e0 and g0 < e1").select("geom_id", "ring_id", "seq", "e0", "e1", F.greatest("g0", "e0").alias("g0"), F.least("g1", "e1").alias("g1"))
    tabbed = gap.select("geom_id", "ring_id").distinct()
    ends = e.join(tabbed, ["geom_id", "ring_id"]).select("geom_id", "ring_id", "seq", "e0", "e1", F.col("e1").alias("g0"), F.col("e1").alias("g1"))
    line = Window.partitionBy("geom_id", "ring_id", "seq").orderBy("g0", "g1")
    free = cover.unionByName(ends).withColumn("done", F.greatest(F.col("e0"), F.coalesce(F.max("g1").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.col("e0"))))
    return free.filter(F.col("g0") > F.col("done") + 1e-9).select("geom_id", "ring_id", "seq", F.col("done").alias("from"), F.col("g0").alias("to"))


def corners_cut(points: DataFrame, rounds: int, obstacles: DataFrame | None = None, clearance: float = 0.0) -> DataFrame:
    """Paths ``(ring_id, seq, x, y)`` whose corners sharper than about 45 degrees are cut off at a quarter of both sides, ``rounds`` times.

    With ``obstacles``, rings of the paths' ``geom_id``, a corner stays where the way from the point before it over the cut to the
    point after it would come nearer than ``clearance`` to solid ground; every round looks at its own cuts, by an anti
    join of the corners with those whose moves hit.
    """
    keys = ["geom_id", "ring_id"] if obstacles is not None else ["ring_id"]
    for _ in range(rounds):
        w = ordered(*keys)
        rows = points.select(*keys, "seq", "x", "y", *[f(c).over(w).alias(f"{n}{c}") for c in "xy" for f, n in ((F.lag, "p"), (F.lead, "q"))])
        ux, uy, vx, vy = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("qx") - F.col("x"), F.col("qy") - F.col("y")
        long = (hypot(ux, uy) >= 1e-12) & (hypot(vx, vy) >= 1e-12)
        sharp = F.coalesce(long & ((ux * vx + uy * vy) / F.nullif(hypot(ux, uy) * hypot(vx, vy), F.lit(0.0)) < 0.707), F.lit(False))
        mixed = lambda n, c: F.col(c) * 0.75 + F.col(f"{n}{c}") * 0.25
        rows = rows.withColumn("sharp", sharp)
        if obstacles is not None:
            rows = saved(rows)
            way = [(F.col("px"), F.col("py")), (mixed("p", "x"), mixed("p", "y")), (mixed("q", "x"), mixed("q", "y")), (F.col("qx"), F.col("qy"))]
            moves = F.array(*[F.struct(F.lit(i).alias("part"), a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")) for i, (a, b) in enumerate(zip(way, way[1:], strict=False))])
            tried = rows.filter("sharp").select(*keys, "seq", F.inline(moves)).withColumn("move_id", F.struct(*keys, "seq", "part")).drop("ring_id", "seq", "part")
            hit = sweep_hits(tried, obstacles, clearance).select("move_id.geom_id", "move_id.ring_id", "move_id.seq").distinct().withColumn("hit", F.lit(True))
            rows = rows.join(hit, [*keys, "seq"], "left").withColumn("sharp", F.col("sharp") & F.col("hit").isNull())
        at = lambda i, x, y: F.struct(F.lit(i).alias("i"), x.alias("nx"), y.alias("ny"))
        out = F.when(F.col("sharp"), F.array(at(0, mixed("p", "x"), mixed("p", "y")), at(1, mixed("q", "x"), mixed("q", "y")))).otherwise(F.array(at(0, F.col("x"), F.col("y"))))
        cut = rows.select(*keys, "seq", F.inline(out))
        points = cut.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "i")) - 1).alias("seq"), F.col("nx").alias("x"), F.col("ny").alias("y"))
    return points


def ring_heights(rings: DataFrame, tolerance: float) -> DataFrame:
    """3-D measures of rings ``(.., x, y, z)``: true perimeter, extent and mean of Z, and the common Z where all lie within ``tolerance``
    of the first vertex."""
    w = ordered("geom_id", "ring_id")
    nz = F.coalesce(F.lead("z").over(w), F.first("z").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    flat = edges(rings).select("geom_id", "ring_id", "seq", "x", "y", "z", "nx", "ny").withColumn("nz", nz).withColumn("z0", F.first("z").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    d = F.sqrt((F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2 + (F.col("nz") - F.col("z")) ** 2)
    per = flat.groupBy("geom_id", "ring_id").agg(F.sum(d).alias("perimeter"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z"), F.bool_and(F.abs(F.col("z") - F.col("z0")) <= tolerance).alias("level"), F.first("z0").alias("z0"))
    return per.select("geom_id", "ring_id", "perimeter", "min_z", "max_z", "mean_z", F.when(F.col("level"), F.col("z0")).alias("common_z"))


def rotary_positions(df: DataFrame) -> DataFrame:
    """Moving commands with Y replaced by the first rotary angle of ``extra_axes`` in the order A, B, C, U, Y; other rows as they are."""
    angle = F.coalesce(*[F.element_at("extra_axes", F.lit(k)) for k in "ABCUY"])
    return df.withColumn("y", F.when(is_moving(), F.coalesce(angle, F.col("y"))).otherwise(F.col("y")))


# Queries and their SQL ----------------------------------------------------------------------------------------------


def _q(f, *names, digits=6):
    return lambda spark, sf_dir: rounded(f(*[table(spark, sf_dir, n) for n in names]), digits=digits)


def _repeated(df: DataFrame) -> DataFrame:
    """Commands in which cuts come once more at the end of their subpath's row, a little moved."""
    twice = df.withColumn("copy", F.explode(F.when(is_("LINE_TO", "ARC_TO") & (F.col("seq") % 3 != 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    moved = twice.withColumn("x", F.col("x") + F.col("copy") * 1e-4).withColumn("seq", F.col("seq") * 2 + F.col("copy"))
    return moved.drop("copy")


#: Ids of copies lie this much above those of their rings, and above all ids of rings.
COPIES = 1 << 40


def _doubled(r: DataFrame) -> DataFrame:
    """Some rings again under other ids: with another start, or the other way round."""
    start = r.filter("ring_id % 3 = 0").withColumns({"ring_id": F.col("ring_id") + COPIES, "seq": ((F.col("seq") + 1) % 4).cast("int")})
    other = r.filter("ring_id % 3 = 1").withColumns({"ring_id": F.col("ring_id") + COPIES, "seq": (3 - F.col("seq")).cast("int"), "x": F.col("x") + 2e-5})
    return r.unionByName(start).unionByName(other)


def _cuts(h: DataFrame) -> DataFrame:
    return h.select("job_id", "seg", (F.col("job_id") % 97).alias("geom_id"), "x0", (F.col("y0") - 60.03).alias("y0"), "x1", (F.col("y1") - 60.03).alias("y1"), F.col("z").alias("z0"), (F.col("z") + 1.0).alias("z1"))


def _regions(r: DataFrame) -> DataFrame:
    return _crossing(r)


def _tabs(p: DataFrame) -> DataFrame:
    """Tabs on the right side of the geometry's middle."""
    k = F.col("point_id")
    return p.select("point_id", (k % 97).alias("geom_id"), (((k % 97) % 10) * 120.0 + 3.0 + k % 41).alias("x"), (F.floor((k % 97) / 10) * 120.0 + k % 13 * 0.31).alias("y"), (k % 3 + 1.25).alias("width"))


def _zigzag(r: DataFrame) -> DataFrame:
    return r.select("ring_id", "seq", "x", "y")


def _free_paths(r: DataFrame) -> DataFrame:
    """Rings that are no obstacles as open paths, from their second vertex on a little to the side."""
    return r.filter("ring_id % 4 <> 1").select("geom_id", "ring_id", "seq", (F.col("x") + F.col("ring_id") % 11 * 0.3).alias("x"), "y")


QUERIES = {
    "remove_repeated_cuts": _q(lambda d: deduplicated(_repeated(d), 1e-3).select("job_id", "seq", "cmd"), "commands"),
    "close_gaps": _q(lambda d: gaps_closed(d, 12.0).select("job_id", "seq", "cmd", "x", "y", "z"), "commands"),
    "unique_contours": _q(lambda r: unique_contours(_doubled(r), 1e-4), "rings"),
    "same_shapes": _q(lambda r: same_shapes(r, _doubled(r).filter(f"ring_id >= {COPIES} or ring_id % 3 = 2 or geom_id % 7 = 0"), 1e-4), "rings"),
    "clip_to_regions": _q(lambda h, r: cut_by_regions(_cuts(h), _regions(r), True), "hatch", "rings"),
    "subtract_regions": _q(lambda h, r: cut_by_regions(_cuts(h), _regions(r), False), "hatch", "rings"),
    "lead_in_out": _q(lambda d: with_leads(d, 2.0, 1.5), "commands"),
    "assign_tabs": _q(lambda p, r: assign_tabs(_tabs(p), r), "points", "rings"),
    "tab_gaps": _q(lambda p, r: tab_gaps(_tabs(p), r), "points", "rings"),
    "cut_corners": _q(lambda r: corners_cut(_zigzag(r), 2), "rings"),
    "cut_free_corners": _q(lambda r: corners_cut(_free_paths(r), 1, r.filter("ring_id % 4 = 1"), 0.4), "rings"),
    "ring_heights": _q(lambda r: ring_heights(r.withColumn("z", (F.col("ring_id") % 3 * F.col("seq") * 0.5)), 1e-6), "rings"),
    "rotary_positions": _q(lambda d: rotary_positions(d.withColumn("extra_axes", F.when(F.col("seq") % 4 == 1, F.create_map(F.lit("B"), F.col("seq") * 0.5)).when(F.col("seq") % 4 == 2, F.create_map(F.lit("X"), F.lit(1.0))))).select("job_id", "seq", "cmd", "x", "y"), "commands"),
}
_CUT = f"""{_SHIFT.split(', sh AS')[0]}, {cte('hatch')[5:]}, bx AS (SELECT geom_id, ring_id, min(x) AS u0, min(y) AS v0, max(x) AS u1, max(y) AS v1 FROM (SELECT geom_id, ring_id, x + (ring_id * 13) % 40 AS x, y FROM rings) GROUP BY ALL),
 cu AS (SELECT job_id, seg, job_id % 97 AS geom_id, x0, x1, y0 - 60.03::DOUBLE AS y, z FROM hatch),
 ts AS (SELECT job_id, seg, 0::DOUBLE AS t FROM cu UNION SELECT job_id, seg, 1 FROM cu UNION SELECT job_id, seg, (u - x0) / (x1 - x0) FROM (SELECT cu.*, unnest([u0, u1]) AS u FROM cu JOIN bx ON bx.geom_id = cu.geom_id AND y BETWEEN v0 AND v1) WHERE (u - x0) / (x1 - x0) > 1e-12 AND (u - x0) / (x1 - x0) < 1 - 1e-12),
 pi AS (SELECT *, lead(t) OVER (PARTITION BY job_id, seg ORDER BY t) AS t1 FROM ts), pp AS (SELECT pi.job_id, pi.seg, pi.t AS t0, t1, cu.x0 AS p, cu.x1 AS q, y, z, geom_id FROM pi JOIN cu ON cu.job_id = pi.job_id AND cu.seg = pi.seg WHERE t1 - t >= 1e-9),
 ki AS (SELECT pp.*, EXISTS (SELECT 1 FROM bx WHERE bx.geom_id = pp.geom_id AND y BETWEEN v0 AND v1 AND p + (t0 + t1) / 2 * (q - p) BETWEEN u0 AND u1) AS ins FROM pp),
 ko AS (SELECT job_id, seg, row_number() OVER (PARTITION BY job_id, seg ORDER BY t0) - 1 AS part, p + t0 * (q - p) AS x0, y, z + t0 AS z0, p + t1 * (q - p) AS x1, z + t1 AS z1 FROM ki WHERE ins = {{inside}}),
 kp AS (SELECT *, lag(x1) OVER w AS lx, lag(y) OVER w AS ly, lag(z1) OVER w AS lz FROM ko WINDOW w AS (PARTITION BY job_id ORDER BY seg, part))
 SELECT job_id, seg, part::INT AS part, round(x0, 6) AS x0, round(y, 6) AS y0, round(z0, 6) AS z0, round(x1, 6) AS x1, round(y, 6) AS y1, round(z1, 6) AS z1, coalesce((lx - x0) ** 2 + (ly - y) ** 2 + (lz - z0) ** 2 > 1e-12, true) AS jump FROM kp"""
_TABS = f"""{_SHIFT.split(', sh AS')[0]}, {cte('points')[5:]}, n AS (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY seq) AS i FROM rings),
 ed AS (SELECT a.geom_id, a.ring_id, a.seq, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len FROM n a JOIN n b ON b.ring_id = a.ring_id AND b.i = a.i % 4 + 1),
 ln AS (SELECT *, sum(len) OVER (PARTITION BY ring_id ORDER BY seq) - len AS e0, sum(len) OVER (PARTITION BY ring_id ORDER BY seq) AS e1, sum(len) OVER (PARTITION BY ring_id) AS total FROM ed),
 cp AS (SELECT point_id, point_id % 97 AS geom_id, ((point_id % 97) % 10) * 120.0::DOUBLE + 3 + point_id % 41 AS px, floor((point_id % 97) / 10.0) * 120.0::DOUBLE + point_id % 13 * 0.31::DOUBLE AS py, point_id % 3 + 1.25::DOUBLE AS width FROM points),
 tt AS (SELECT point_id, width, px, py, ln.*, least(1, greatest(0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (len * len))) AS t FROM cp JOIN ln ON ln.geom_id = cp.geom_id),
 dd AS (SELECT *, (px - ax - t * (bx - ax)) ** 2 + (py - ay - t * (by_ - ay)) ** 2 AS d2 FROM tt),
 tb AS (SELECT point_id, geom_id, ring_id, width, total, e0 + t * len AS "at" FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, ring_id, seq) AS k FROM dd) WHERE k = 1 AND d2 <= 4 * width * width)"""
_J = "OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
_L = "OVER (PARTITION BY job_id, line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LEAD = f"""{cte('commands')}, s AS (SELECT *, cmd IN ('OPS_SECTION_START', 'OPS_SECTION_END') AS mk, cmd IN ('LINE_TO', 'ARC_TO') AS cut, cmd IN ('MOVE_TO', 'LINE_TO', 'ARC_TO') AS mv, coalesce(last_value(CASE WHEN cmd = 'SET_POWER' THEN val END IGNORE NULLS) {_J}, 0) AS pw,
  coalesce(last_value(CASE WHEN section_type = 'VECTOR_OUTLINE' THEN cmd = 'OPS_SECTION_START' END IGNORE NULLS) {_J}, false) AS v FROM commands),
 l AS (SELECT *, v AND NOT (mk AND coalesce(section_type = 'VECTOR_OUTLINE', false)) AS ins, sum(CASE WHEN cmd = 'MOVE_TO' AND v OR mk AND section_type = 'VECTOR_OUTLINE' THEN 1 ELSE 0 END) {_J} AS line FROM s),
 q AS (SELECT *, last_value(CASE WHEN mv THEN x END IGNORE NULLS) {_L} AS px, last_value(CASE WHEN mv THEN y END IGNORE NULLS) {_L} AS py, lead(cmd) OVER (PARTITION BY job_id, line ORDER BY seq) AS nx, CASE WHEN cw THEN -1 ELSE 1 END AS sd FROM l),
 t AS (SELECT *, sqrt((x - px) ** 2 + (y - py) ** 2) >= 1e-9 AS ok, CASE WHEN cmd = 'ARC_TO' THEN cj * sd ELSE x - px END AS fx, CASE WHEN cmd = 'ARC_TO' THEN -ci * sd ELSE y - py END AS fy,
  CASE WHEN cmd = 'ARC_TO' THEN -(y - py - cj) * sd ELSE x - px END AS bx, CASE WHEN cmd = 'ARC_TO' THEN (x - px - ci) * sd ELSE y - py END AS by_ FROM q),
 g AS (SELECT job_id, line, min(seq) AS h, max(seq) AS tail, min(seq) FILTER (cut) AS f, max(seq) FILTER (mv) AS e FROM t WHERE ins GROUP BY ALL),
 k AS (SELECT g.*, a.ok AND sqrt(a.fx ** 2 + a.fy ** 2) > 0 AS hin, coalesce(b.ok, false) AND b.cut AND sqrt(b.bx ** 2 + b.by_ ** 2) > 0 AS hout, a.fx / sqrt(a.fx ** 2 + a.fy ** 2) AS ux, a.fy / sqrt(a.fx ** 2 + a.fy ** 2) AS uy, b.bx / sqrt(b.bx ** 2 + b.by_ ** 2) AS wx, b.by_ / sqrt(b.bx ** 2 + b.by_ ** 2) AS wy,
  a.pw AS fp, b.x AS ex, b.y AS ey, b.z AS ez FROM g JOIN t a ON a.job_id = g.job_id AND a.seq = g.f JOIN t b ON b.job_id = g.job_id AND b.seq = g.e JOIN t c ON c.job_id = g.job_id AND c.seq = g.h WHERE c.cmd = 'MOVE_TO'),
 o AS (SELECT t.job_id, t.seq, 0 AS part, cmd, CASE WHEN k.hin AND t.seq = k.h THEN x - ux * 2 ELSE x END AS x, CASE WHEN k.hin AND t.seq = k.h THEN y - uy * 2 ELSE y END AS y, z, val FROM t LEFT JOIN k ON k.job_id = t.job_id AND k.line = t.line AND t.ins
  UNION ALL SELECT job_id, h, 1, 'SET_POWER', NULL, NULL, NULL, 0 FROM k WHERE hin UNION ALL SELECT k.job_id, h, 2, 'LINE_TO', x, y, z, NULL FROM k JOIN t ON t.job_id = k.job_id AND t.seq = k.h WHERE hin
  UNION ALL SELECT k.job_id, h, 3, 'SET_POWER', NULL, NULL, NULL, fp FROM k JOIN t ON t.job_id = k.job_id AND t.seq = k.h WHERE (hin OR hout) AND coalesce(nx <> 'SET_POWER', true)
  UNION ALL SELECT job_id, tail, 4, 'SET_POWER', NULL, NULL, NULL, 0 FROM k WHERE hout UNION ALL SELECT job_id, tail, 5, 'LINE_TO', ex + wx * 1.5, ey + wy * 1.5, ez, NULL FROM k WHERE hout)
 SELECT job_id, seq, part, cmd, round(x, 6) AS x, round(y, 6) AS y, z, round(val, 6) AS val FROM o"""
_MV = "cmd IN ('MOVE_TO','LINE_TO','ARC_TO')"


def _to_line(x: str, y: str, ax: str, ay: str, bx: str, by: str) -> str:
    """SQL of the squared distance of a point to a segment."""
    t = f"least(1, greatest(0, (({x} - {ax}) * ({bx} - {ax}) + ({y} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2, 0)))"
    return f"(({x} - {ax} - coalesce({t}, 0) * ({bx} - {ax})) ** 2 + ({y} - {ay} - coalesce({t}, 0) * ({by} - {ay})) ** 2)"


ORACLE_SQL = {
    "remove_repeated_cuts": f"""{cte('commands')}, s AS (SELECT *, greatest(count(*) FILTER (cmd = 'MOVE_TO') OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1, 0) AS sub FROM commands),
 d AS (SELECT job_id, seq * 2 AS seq, cmd, sub, x, y, z, ci, cj, cw FROM s UNION ALL SELECT job_id, seq * 2 + 1, cmd, sub, x, y, z, ci, cj, cw FROM s WHERE cmd IN ('LINE_TO', 'ARC_TO') AND seq % 3 <> 0),
 n AS (SELECT *, row_number() OVER (PARTITION BY job_id, sub, cmd, x, y, z, ci, cj, cw ORDER BY seq) AS i FROM d)
 SELECT job_id, seq, cmd FROM n WHERE i = 1 OR cmd NOT IN ('LINE_TO', 'ARC_TO')""",
    "close_gaps": f"""{cte('commands')}, s AS (SELECT *, greatest(count(*) FILTER (cmd = 'MOVE_TO') OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1, 0) AS sub FROM commands WHERE {_MV}),
 f AS (SELECT *, first_value({{'x': x, 'y': y, 'z': z}}) OVER w AS s, last_value(seq) OVER w AS l, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY job_id, sub ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 c AS (SELECT *, n >= 2 AND seq = l AND (x - s.x) ** 2 + (y - s.y) ** 2 + (z - s.z) ** 2 < 144 AS k FROM f),
 m AS (SELECT job_id, seq, cmd, CASE WHEN k THEN s.x ELSE x END AS x, CASE WHEN k THEN s.y ELSE y END AS y, CASE WHEN k THEN s.z ELSE z END AS z FROM c),
 p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM m WINDOW w AS (PARTITION BY job_id ORDER BY seq)),
 t AS (SELECT *, coalesce(cmd = 'MOVE_TO' AND (x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2 < 144, false) AS sh FROM p)
 SELECT job_id, seq, CASE WHEN sh THEN 'LINE_TO' ELSE cmd END AS cmd, round(CASE WHEN sh THEN px ELSE x END, 6) AS x, round(CASE WHEN sh THEN py ELSE y END, 6) AS y, round(CASE WHEN sh THEN pz ELSE z END, 6) AS z FROM t""",
    "unique_contours": f"{cte('rings')} SELECT DISTINCT geom_id, ring_id FROM rings",
    "same_shapes": f"{cte('rings')} SELECT geom_id, geom_id % 7 <> 0 OR count(*) FILTER (ring_id % 3 <> 2) = 0 AS same FROM (SELECT DISTINCT geom_id, ring_id FROM rings) GROUP BY geom_id",
    "clip_to_regions": _CUT.format(inside="true"),
    "subtract_regions": _CUT.format(inside="false"),
    "lead_in_out": _LEAD,
    "assign_tabs": _TABS + ' SELECT point_id, geom_id, ring_id, width, round("at", 6) AS "at" FROM tb',
    "tab_gaps": f"""{_TABS}, gp AS (SELECT geom_id, ring_id, "at" - width / 2 + k * total AS g0, "at" + width / 2 + k * total AS g1 FROM tb, range(-1, 2) t(k)),
 cv AS (SELECT l.geom_id, l.ring_id, l.seq, e0, e1, greatest(g0, e0) AS g0, least(g1, e1) AS g1 FROM ln l JOIN gp ON gp.ring_id = l.ring_id AND g1 > e0 AND g0 < e1
  UNION ALL SELECT geom_id, ring_id, seq, e0, e1, e1, e1 FROM ln WHERE ring_id IN (SELECT ring_id FROM tb)),
 fr AS (SELECT *, greatest(e0, coalesce(max(g1) OVER (PARTITION BY ring_id, seq ORDER BY g0, g1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e0)) AS done FROM cv)
 SELECT geom_id, ring_id, seq, round(done, 6) AS "from", round(g0, 6) AS "to" FROM fr WHERE g0 > done + 1e-9""",
    "cut_corners": f"""{cte('rings')}, a AS (SELECT ring_id, seq, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY seq)),
 b AS (SELECT ring_id, seq, 0 AS i, CASE WHEN px IS NULL OR qx IS NULL THEN x ELSE x * 0.75 + px * 0.25 END AS x, CASE WHEN px IS NULL OR qx IS NULL THEN y ELSE y * 0.75 + py * 0.25 END AS y FROM a
  UNION ALL SELECT ring_id, seq, 1, x * 0.75 + qx * 0.25, y * 0.75 + qy * 0.25 FROM a WHERE px IS NOT NULL AND qx IS NOT NULL),
 c AS (SELECT ring_id, row_number() OVER (PARTITION BY ring_id ORDER BY seq, i) - 1 AS seq, x, y FROM b),
 d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM c WINDOW w AS (PARTITION BY ring_id ORDER BY seq)),
 e AS (SELECT *, coalesce(((x - px) * (qx - x) + (y - py) * (qy - y)) / (sqrt((x - px) ** 2 + (y - py) ** 2) * sqrt((qx - x) ** 2 + (qy - y) ** 2)) < 0.707, false) AS s FROM d),
 f AS (SELECT ring_id, seq, 0 AS i, CASE WHEN s THEN x * 0.75 + px * 0.25 ELSE x END AS x, CASE WHEN s THEN y * 0.75 + py * 0.25 ELSE y END AS y FROM e UNION ALL SELECT ring_id, seq, 1, x * 0.75 + qx * 0.25, y * 0.75 + qy * 0.25 FROM e WHERE s)
 SELECT ring_id, (row_number() OVER (PARTITION BY ring_id ORDER BY seq, i) - 1)::INT AS seq, round(x, 6) AS x, round(y, 6) AS y FROM f""",
    "cut_free_corners": f"""{cte('rings')}, pa AS (SELECT geom_id, ring_id, seq, x + ring_id % 11 * 0.3::DOUBLE AS x, y FROM rings WHERE ring_id % 4 <> 1),
 a AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM pa WINDOW w AS (PARTITION BY geom_id, ring_id ORDER BY seq)), c AS (SELECT *, px IS NOT NULL AND qx IS NOT NULL AS sharp FROM a),
 m AS (SELECT geom_id, ring_id, seq, px AS x0, py AS y0, x * 0.75 + px * 0.25 AS x1, y * 0.75 + py * 0.25 AS y1 FROM c WHERE sharp UNION ALL SELECT geom_id, ring_id, seq, x * 0.75 + px * 0.25, y * 0.75 + py * 0.25, x * 0.75 + qx * 0.25, y * 0.75 + qy * 0.25 FROM c WHERE sharp
  UNION ALL SELECT geom_id, ring_id, seq, x * 0.75 + qx * 0.25, y * 0.75 + qy * 0.25, qx, qy FROM c WHERE sharp),
 n AS (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY seq) AS i FROM rings WHERE ring_id % 4 = 1), e AS (SELECT p.geom_id, p.ring_id AS o, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM n p JOIN n q ON q.ring_id = p.ring_id AND q.i = p.i % 4 + 1),
 b AS (SELECT geom_id, ring_id AS o, min(x) AS u0, max(x) AS u1, min(y) AS v0, max(y) AS v1, ring_id % 2 = 0 AS ccw FROM n GROUP BY ALL),
 k AS (SELECT m.*, e.ax, e.ay, e.bx, e.by_, (x1 - x0) * (ay - y0) - (y1 - y0) * (ax - x0) AS s0, (x1 - x0) * (by_ - y0) - (y1 - y0) * (bx - x0) AS s1, (bx - ax) * (y0 - ay) - (by_ - ay) * (x0 - ax) AS s2, (bx - ax) * (y1 - ay) - (by_ - ay) * (x1 - ax) AS s3 FROM m JOIN e ON e.geom_id = m.geom_id),
 h AS (SELECT DISTINCT geom_id, ring_id, seq FROM k WHERE s0 * s1 <= 0 AND s2 * s3 <= 0 AND s0 * s1 + s2 * s3 <> 0 OR least({_to_line('x0', 'y0', 'ax', 'ay', 'bx', 'by_')}, {_to_line('x1', 'y1', 'ax', 'ay', 'bx', 'by_')}, {_to_line('ax', 'ay', 'x0', 'y0', 'x1', 'y1')}, {_to_line('bx', 'by_', 'x0', 'y0', 'x1', 'y1')}) < 0.16
  UNION SELECT geom_id, ring_id, seq FROM (SELECT m.geom_id, m.ring_id, m.seq, x1 + y1 AS z, i, sum(CASE WHEN ccw THEN 1 ELSE -1 END) AS t FROM (SELECT *, unnest([x0, x1]) AS x, unnest([y0, y1]) AS y, unnest([0, 1]) AS i FROM m) m JOIN b ON b.geom_id = m.geom_id AND x BETWEEN u0 AND u1 AND y BETWEEN v0 AND v1 GROUP BY ALL) WHERE t > 0),
 f AS (SELECT c.*, sharp AND h.seq IS NULL AS cut FROM c LEFT JOIN h ON h.geom_id = c.geom_id AND h.ring_id = c.ring_id AND h.seq = c.seq),
 o AS (SELECT geom_id, ring_id, seq, 0 AS i, CASE WHEN cut THEN x * 0.75 + px * 0.25 ELSE x END AS x, CASE WHEN cut THEN y * 0.75 + py * 0.25 ELSE y END AS y FROM f UNION ALL SELECT geom_id, ring_id, seq, 1, x * 0.75 + qx * 0.25, y * 0.75 + qy * 0.25 FROM f WHERE cut)
 SELECT geom_id, ring_id, (row_number() OVER (PARTITION BY geom_id, ring_id ORDER BY seq, i) - 1)::INT AS seq, round(x, 6) AS x, round(y, 6) AS y FROM o""",
    "ring_heights": f"""{cte('rings')}, z AS (SELECT *, ring_id % 3 * seq * 0.5::DOUBLE AS z FROM rings), n AS (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY seq) AS i FROM z),
 e AS (SELECT a.geom_id, a.ring_id, a.seq, a.z, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) AS d FROM n a JOIN n b ON b.ring_id = a.ring_id AND b.i = a.i % 4 + 1)
 SELECT geom_id, ring_id, round(sum(d), 6) AS perimeter, min(z) AS min_z, max(z) AS max_z, round(avg(z), 6) AS mean_z, CASE WHEN max(z) - arg_min(z, seq) <= 1e-6 THEN arg_min(z, seq) END AS common_z FROM e GROUP BY ALL""",
    "rotary_positions": f"{cte('commands')} SELECT job_id, seq, cmd, round(x, 6) AS x, round(CASE WHEN {_MV} AND seq % 4 = 1 THEN seq * 0.5 ELSE y END, 6)::DOUBLE AS y FROM commands",
}
