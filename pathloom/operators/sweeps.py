"""Raster sweeps as commands with samples, and what finishes them: overscan, offsets, clipping, boxes, sizes.

A sweep table is ``(job_id, seq, cmd, x, y, z, samples, section_type)``; a SCAN_LINE burns ``samples`` (power bytes) on
its way from the move before. Ordered windows are per job, one exchange for a chain of operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geometry import hypot
from pathloom.functions.windows import before, islands, ordered
from pathloom.operators.commands import by_job, is_, is_moving, rounded
from pathloom.operators.raster import _COMPONENTS, _POWER, _RUNS, components, power, runs, scan_rows
from pathloom.sources.derive import cte, table

#: Fixed value: bytes of a command in memory, as the container's estimate counts them.
COMMAND_BYTES = 96


def from_rows(rows: DataFrame, pitch: float) -> DataFrame:
    """A job for each image: per row with ink a MOVE_TO and a SCAN_LINE over its content, odd rows backwards, between the
    markers of a raster section. Samples run in the direction of travel."""
    span = runs(rows).groupBy("image_id", "y").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cut = span.join(rows, ["image_id", "y"]).withColumn("cut", F.slice("samples", F.col("lo") + 1, F.col("hi") - F.col("lo")))
    back = F.col("y") % 2 == 1
    x0, x1 = F.when(back, F.col("hi")).otherwise(F.col("lo")) * pitch, F.when(back, F.col("lo")).otherwise(F.col("hi")) * pitch
    none = F.lit(None).cast("array<int>")

    def row(part: int, name: str, x: Column, samples: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(name).alias("cmd"), x.alias("x"), (F.col("y") * pitch).alias("line_y"), samples.alias("samples"))

    lines = cut.select(F.col("image_id").alias("job_id"), "y", F.inline(F.array(row(1, "MOVE_TO", x0, none), row(2, "SCAN_LINE", x1, F.when(back, F.reverse("cut")).otherwise(F.col("cut"))))))
    ends = rows.select(F.col("image_id").alias("job_id")).distinct().select("job_id", F.inline(F.array(*[
        F.struct(F.lit(k).cast("long").alias("y"), F.lit(0).alias("part"), F.lit(c).alias("cmd"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("line_y"), none.alias("samples"))
        for k, c in ((-1, "OPS_SECTION_START"), (1 << 40, "OPS_SECTION_END"))
    ])))
    seq = (F.row_number().over(Window.partitionBy("job_id").orderBy("y", "part")) - 1).cast("long")
    z = F.when(is_moving(), F.lit(0.0))
    kind = F.when(~is_moving(), F.lit("RASTER_FILL"))
    return lines.unionByName(ends).withColumn("seq", seq).select("job_id", "seq", "cmd", "x", F.col("line_y").alias("y"), z.alias("z"), "samples", kind.alias("section_type"))


def segmented(rows: DataFrame, pitch: float) -> DataFrame:
    """A line for each run of non-zero samples: ``job_id, y, x0, x1, samples``, all from left to right, on a grid of ``pitch``."""
    cut = runs(rows).select("image_id", "y", "lo", "hi").join(rows, ["image_id", "y"])
    return cut.select(F.col("image_id").alias("job_id"), "y", (F.col("lo") * pitch).alias("x0"), (F.col("hi") * pitch).alias("x1"), F.slice("samples", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("samples"))


def merged_lines(lines: DataFrame, most_gap: float) -> DataFrame:
    """Lines of one row that are at most ``most_gap`` apart as one sweep, its samples with zeros for the gaps.

    A gap gets as many zeros as the samples of the line after it have in that length. Gaps and islands: one window for
    each row of a job, and one array for each sweep.
    """
    w = Window.partitionBy("job_id", "y").orderBy("x0", "x1")
    gap = F.col("x0") - F.lag("x1").over(w)
    rows = lines.withColumn("gap", gap).withColumn("new", F.coalesce(F.col("gap") > most_gap + 1e-9, F.lit(True)))
    rows = rows.withColumn("sweep", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    zeros = F.round(F.greatest(F.col("gap"), F.lit(0.0)) * F.size("samples") / (F.col("x1") - F.col("x0"))).cast("int")
    padded = F.when(F.col("new"), F.col("samples")).otherwise(F.concat(F.array_repeat(F.lit(0), zeros), "samples"))
    per = rows.withColumn("part", F.struct("x0", padded.alias("s"))).groupBy("job_id", "y", "sweep").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("part")).alias("parts"))
    return per.select("job_id", "y", "x0", "x1", "n", F.flatten(F.transform("parts", lambda q: q["s"])).alias("samples"))


def scanline_boxes(df: DataFrame) -> DataFrame:
    """Box of each job's scanlines: they start where the MOVE_TO or SCAN_LINE before them ended, at first at the origin."""
    rows = df.filter(is_("MOVE_TO", "SCAN_LINE"))
    px, py = (F.coalesce(F.lag(c).over(by_job()), F.lit(0.0)) for c in "xy")
    rows = rows.withColumns({"px": px, "py": py}).filter(is_("SCAN_LINE"))
    per = rows.groupBy("job_id").agg(*[f(g(p, c)).alias(f"{n}_{c}") for p, c in (("px", "x"), ("py", "y")) for f, g, n in ((F.min, F.least, "min"), (F.max, F.greatest, "max"))])
    return per.select("job_id", "min_x", "min_y", (F.col("max_x") - F.col("min_x")).alias("width"), (F.col("max_y") - F.col("min_y")).alias("height"))


def container_bytes(df: DataFrame) -> DataFrame:
    """Estimated memory of each job's container: its commands and one byte for each sample."""
    return df.groupBy("job_id").agg((F.count(F.lit(1)) * COMMAND_BYTES + F.coalesce(F.sum(F.when(is_("SCAN_LINE"), F.size("samples"))), F.lit(0))).cast("long").alias("bytes"))


def capped(df: DataFrame, most: float) -> DataFrame:
    """Sample bytes at most ``round(255 * most)``; state rows are capped by ``transforms.cap_power``."""
    top = int(min(1.0, max(0.0, most)) * 255 + 0.5)
    return df.withColumn("samples", F.transform("samples", lambda v: F.least(v, F.lit(top))))


def sliced(samples: Column, t0: Column, t1: Column) -> Column:
    """Samples of the part [t0, t1) of a scanline."""
    lo = F.floor(F.size(samples) * t0).cast("int")
    return F.slice(samples, lo + 1, F.floor(F.size(samples) * t1).cast("int") - lo)


def overscanned(df: DataFrame, distance: float) -> DataFrame:
    """Lines of raster sections begin and end ``distance`` further out along their own direction.

    A line is a MOVE_TO and the rows up to the next one inside a RASTER_FILL section. One that is just a MOVE_TO and a
    SCAN_LINE gets its samples padded with zeros on both sides; any other gets a zero-power run-in and run-out, here as
    moved ends. Lines without a length stay, and so do all rows outside raster sections, whatever they are.
    """
    raster = F.col("section_type") == "RASTER_FILL"
    inside = F.coalesce(F.last(F.when(is_("OPS_SECTION_START") & raster, True).when(is_("OPS_SECTION_END") & raster, False), ignorenulls=True).over(by_job().rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    marker = F.coalesce(is_("OPS_SECTION_START", "OPS_SECTION_END") & raster, F.lit(False))
    rows = df.withColumn("__in", inside & ~marker).withColumn("__line", islands((is_("MOVE_TO") & F.col("__in")) | marker, by_job()))
    whole = ordered("job_id", "__line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    move = F.when(is_moving(), F.struct("x", "y"))
    rows = rows.withColumns({"__a": F.first(move, ignorenulls=True).over(whole), "__b": F.last(move, ignorenulls=True).over(whole), "__n": F.count(F.lit(1)).over(whole),
                             "__moves": F.count(move).over(whole), "__head": F.first("cmd").over(whole), "__end": F.last(F.when(is_moving(), F.col("seq")), ignorenulls=True).over(whole)})
    dx, dy = F.col("__b.x") - F.col("__a.x"), F.col("__b.y") - F.col("__a.y")
    rows = rows.withColumn("__len", hypot(dx, dy))
    good = F.col("__in") & (F.col("__head") == "MOVE_TO") & (F.col("__moves") >= 2) & (F.col("__len") >= 1e-9)
    first, last = good & is_("MOVE_TO"), good & (F.col("seq") == F.col("__end"))
    ux, uy = dx / F.col("__len") * distance, dy / F.col("__len") * distance
    pad = F.array_repeat(F.lit(0), F.ceil(F.lit(distance) * F.size("samples") / F.col("__len")).cast("int"))
    out = {
        "x": F.when(first, F.col("x") - ux).when(last, F.col("x") + ux).otherwise(F.col("x")), "y": F.when(first, F.col("y") - uy).when(last, F.col("y") + uy).otherwise(F.col("y")),
        "samples": F.when(last & is_("SCAN_LINE") & (F.col("__n") == 2), F.concat(pad, "samples", pad)).otherwise(F.col("samples")),
    }
    return rows.withColumns(out).select(*df.columns)


def bidirectional_offset(df: DataFrame, offset: float) -> DataFrame:
    """Passes from right to left, a MOVE_TO and the SCAN_LINE that follows but for state rows, move by ``offset`` in X."""
    solid = F.when(is_moving() | is_("OPS_SECTION_START", "OPS_SECTION_END", "LAYER_START", "LAYER_END"), F.struct("cmd", "x"))
    ahead = F.first(solid, ignorenulls=True).over(by_job().rowsBetween(1, Window.unboundedFollowing))
    behind = F.last(solid, ignorenulls=True).over(before(by_job()))
    rows = df.withColumns({"__a": ahead, "__b": behind})
    entry = is_("MOVE_TO") & (F.col("__a.cmd") == "SCAN_LINE") & (F.col("__a.x") < F.col("x"))
    line = is_("SCAN_LINE") & (F.col("__b.cmd") == "MOVE_TO") & (F.col("x") < F.col("__b.x"))
    return rows.withColumn("x", F.when(F.coalesce(entry | line, F.lit(False)), F.col("x") + offset).otherwise(F.col("x"))).select(*df.columns)


def segment_range(ax: Column, ay: Column, bx: Column, by: Column, box: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """The part [t0, t1] of a segment inside a box; t0 > t1 where there is none."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    for a, b, low, high in ((ax, bx, box[0], box[2]), (ay, by, box[1], box[3])):
        d = b - a
        s, e = (F.lit(low) - a) / F.nullif(d, F.lit(0.0)), (F.lit(high) - a) / F.nullif(d, F.lit(0.0))
        out = (a < low) | (a > high)
        lo = F.greatest(lo, F.when(d == 0, F.when(out, F.lit(2.0)).otherwise(F.lit(0.0))).otherwise(F.least(s, e)))
        hi = F.least(hi, F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(s, e)))
    return lo, hi


def clipped_rect(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Straight cuts and scanlines inside a box, samples sliced; a MOVE_TO where the pen was not; other rows as they are.

    Curves must be chords already. ``part`` tells a travel (0) from the cut (1) of the same ``seq``. Z changes evenly
    along a segment. Travels of the job itself go: what remains of the cuts needs its own.
    """
    p = {f"p{c}": F.coalesce(F.last(F.when(is_moving(), F.col(c)), ignorenulls=True).over(before(by_job())), F.lit(0.0)) for c in "xyz"}
    rows = df.withColumns(p)
    cuts = rows.filter(is_moving() & ~is_("MOVE_TO"))
    t0, t1 = segment_range(F.col("px"), F.col("py"), F.col("x"), F.col("y"), box)
    cuts = cuts.withColumns({"t0": t0, "t1": t1}).filter("t0 <= t1")
    at = lambda c, t: F.col(f"p{c}") + F.col(t) * (F.col(c) - F.col(f"p{c}"))
    cuts = cuts.withColumns({f"{n}{c}": at(c, t) for n, t in (("s", "t0"), ("e", "t1")) for c in "xyz"})
    # The pen is where the kept cut before ended, if no travel lies between.
    moves = df.filter(is_("MOVE_TO")).select("job_id", "seq", F.lit(1).alias("lift"))
    line = cuts.select("job_id", "seq", F.lit(0).alias("lift"), "ex", "ey", "ez").unionByName(moves, allowMissingColumns=True)
    w = before(ordered("job_id"))
    line = line.withColumn("pen", F.last(F.when(F.col("lift") == 1, F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("z"))).otherwise(F.struct(F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z")))).over(w))
    cuts = cuts.join(line.filter("lift = 0").select("job_id", "seq", "pen"), ["job_id", "seq"])
    jump = F.coalesce((F.col("pen.x") - F.col("sx")) ** 2 + (F.col("pen.y") - F.col("sy")) ** 2 + (F.col("pen.z") - F.col("sz")) ** 2 > 1e-12, F.lit(True))
    others = [c for c in df.columns if c not in ("job_id", "seq", "cmd", "x", "y", "z", "samples")]
    travel = cuts.filter(jump).select("job_id", "seq", F.lit(0).alias("part"), F.lit("MOVE_TO").alias("cmd"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), F.lit(None).cast("array<int>").alias("samples"), *others)
    body = cuts.select("job_id", "seq", F.lit(1).alias("part"), "cmd", F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z"), sliced(F.col("samples"), F.col("t0"), F.col("t1")).alias("samples"), *others)
    rest = df.filter(~is_moving()).select("job_id", "seq", F.lit(1).alias("part"), "cmd", "x", "y", "z", "samples", *others)
    return travel.unionByName(body).unionByName(rest)


def scan_positions(boxes: DataFrame, pixels_per_mm: float, interval: float, offset: float) -> DataFrame:
    """Scan positions of each image ``(image_id, y_min, y_max, height)`` on one global raster of ``interval``: ``row, y_mm, y_px``."""
    low, high = F.col("y_min") / pixels_per_mm, (F.col("y_max") + 1) / pixels_per_mm
    first = F.ceil((low + offset) / interval) * interval - offset
    n = F.ceil((high - first) / interval - 1e-9).cast("int")
    rows = boxes.withColumn("row", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))).withColumn("y_mm", first + F.col("row") * interval)
    return rows.select("image_id", "row", "y_mm", F.least(F.greatest(F.col("y_mm") * pixels_per_mm, F.lit(0.0)), (F.col("height") - 1).cast("double")).alias("y_px"))


def resampled_rows(pixels: DataFrame, positions: DataFrame) -> DataFrame:
    """Gray levels at scan positions between two image rows, by two equi-joins on (image, row)."""
    want = positions.withColumns({"y0": F.floor("y_px"), "y1": F.ceil("y_px")})
    low = pixels.select("image_id", F.col("y").alias("y0"), "x", F.col("gray").alias("g0"))
    high = pixels.select("image_id", F.col("y").alias("y1"), "x", F.col("gray").alias("g1"))
    rows = want.join(low, ["image_id", "y0"]).join(high, ["image_id", "y1", "x"])
    t = F.col("y_px") - F.col("y0")
    return rows.select("image_id", "row", "x", (F.col("g0") * (F.lit(1.0) - t) + F.col("g1") * t).alias("gray"))


def adaptive_sizes(areas: DataFrame) -> DataFrame:
    """Smallest area of a component that is not noise, of each image's ``areas(image_id, label, area)``.

    2 where all areas exceed 10 and none occurs ten times, or where there is one size only; else one more than the area
    before the largest gap, between 2 and 100. Of equal gaps the first counts.
    """
    bins = areas.groupBy("image_id", "area").agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("area") - F.lag("area").over(Window.partitionBy("image_id").orderBy("area"))
    bins = bins.withColumns({"gap": gap, "below": F.lag("area").over(Window.partitionBy("image_id").orderBy("area"))})
    per = bins.groupBy("image_id").agg(F.bool_and((F.col("area") > 10) & (F.col("n") < 10)).alias("clean"), F.count(F.lit(1)).alias("sizes"), F.max(F.struct("gap", (-F.col("below")).alias("b"))).alias("top"))
    size = F.when(F.col("clean") | (F.col("sizes") <= 1), F.lit(2)).otherwise(F.greatest(F.least(-F.col("top.b") + 1, F.lit(100)), F.lit(2)))
    return per.select("image_id", size.cast("int").alias("min_area"))


def denoised(areas: DataFrame) -> DataFrame:
    """Components that stay: those of at least their image's adaptive size; an image of one component keeps it."""
    sized = areas.join(adaptive_sizes(areas), "image_id").withColumn("only", F.count(F.lit(1)).over(Window.partitionBy("image_id")) == 1)
    return sized.filter((F.col("area") >= F.col("min_area")) | F.col("only")).select("image_id", "label", "area")


def composited(sources: DataFrame, views: DataFrame, width: int, height: int) -> DataFrame:
    """Views of images laid over each other in ``ord``: ``target_id, py, px, v, a`` of the pixels that any view touches.

    ``sources(image_id, y, x, v, a)`` hold premultiplied values; ``views(target_id, ord, image_id, w, h, dst_x, dst_y, scale_x,
    scale_y)``. Target pixels take the nearest source pixel; layers are folded in order, one array for each pixel.
    """
    def span(at, size, scale, most):  # noqa: E306
        lo = F.greatest(F.floor(at), F.lit(0)).cast("int")
        hi = F.least(F.ceil(at + size * scale), F.lit(most)).cast("int")
        return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    cells = views.withColumn("py", F.explode(span(F.col("dst_y"), F.col("h"), F.col("scale_y"), height))).withColumn("px", F.explode(span(F.col("dst_x"), F.col("w"), F.col("scale_x"), width)))
    near = lambda p, at, scale, n: F.greatest(F.least(F.floor((p - at + 0.5) / scale), n - 1), F.lit(0)).cast("int")
    cells = cells.select("target_id", "ord", "image_id", "py", "px", near(F.col("px"), F.col("dst_x"), F.col("scale_x"), F.col("w")).alias("x"), near(F.col("py"), F.col("dst_y"), F.col("scale_y"), F.col("h")).cast("long").alias("y"))
    hit = cells.join(sources, ["image_id", "y", "x"]).filter("a > 0")
    layers = hit.groupBy("target_id", "py", "px").agg(F.sort_array(F.collect_list(F.struct("ord", "v", "a"))).alias("l"))
    over = lambda top, low, a: top + F.floor((low * (F.lit(255) - a) + 127) / 255).cast("int")
    start = F.struct(F.lit(0).alias("v"), F.lit(0).alias("a"))
    fold = F.aggregate("l", start, lambda s, t: F.struct(over(t["v"], s["v"], t["a"]).alias("v"), over(t["a"], s["a"], t["a"]).alias("a")))
    return layers.withColumn("p", fold).select("target_id", "py", "px", "p.v", "p.a")


def classified(effects: DataFrame, stock_bottom: float) -> DataFrame:
    """What each stock's effects add up to: through cuts, rasters, the first escalation, and the sources that take part.

    ``effects(stock_id, seq, source_key, kind, z_from, z_to)``; a null depth reaches the surface, or the bottom. The
    first vector below the surface or volume, by ``seq``, escalates the stock.
    """
    top = F.coalesce(F.col("z_from") >= -1e-6, F.lit(True))
    through = F.coalesce(F.col("z_to") <= stock_bottom + 1e-6, F.lit(True))
    vector = F.col("kind") == "vector"
    what = F.when(vector & ~top, F.concat(F.lit("top-open:"), "source_key")).when(F.col("kind") == "volume", F.concat(F.lit("solid:"), "source_key"))
    return effects.groupBy("stock_id").agg(
        F.count_if(vector & top & through).alias("voids"), F.count_if(F.col("kind") == "raster").alias("rasters"),
        F.min(F.when(what.isNotNull(), F.struct("seq", what.alias("what"))))["what"].alias("escalation"), F.array_join(F.array_sort(F.collect_set("source_key")), ",").alias("provenance"),
    )


def grid_coordinates(verts: DataFrame, origin: tuple[float, float], per_mm: tuple[float, float], size: tuple[int, int]) -> DataFrame:
    """Vertices in grid coordinates: 0 at the grid's origin, 1 at its far corner."""
    u, v = ((F.col(c) - o) * p / max(1, s) for c, o, p, s in zip("xy", origin, per_mm, size))
    return verts.select("v", u.alias("u"), v.alias("w"))


# Queries and their SQL ----------------------------------------------------------------------------------------------


def _pixels(f):
    return lambda spark, sf_dir: rounded(f(table(spark, sf_dir, "pixels")))


def _sweeps(p: DataFrame) -> DataFrame:
    return from_rows(scan_rows(power(p, 0.1, 0.9, 16)), 0.1)


def _flat(df: DataFrame) -> DataFrame:
    """Samples as text, for comparison."""
    return df.select("job_id", "seq", *(["part"] if "part" in df.columns else []), "cmd", "x", "y", F.array_join("samples", ",").alias("samples"))


def _boxes(p: DataFrame) -> DataFrame:
    return p.filter("gray <= 150").groupBy("image_id").agg(F.min("y").alias("y_min"), F.max("y").alias("y_max")).join(p.groupBy("image_id").agg((F.max("y") + 1).alias("height")), "image_id")


def _areas(p: DataFrame) -> DataFrame:
    """Components of the dark pixels with their areas."""
    return components(p.filter("gray <= 110"))


def _composite(p: DataFrame) -> DataFrame:
    low = p.withColumn("alpha", ((F.col("gray") * 7 + F.col("x") * 31) % 4 * 85).cast("int"))
    sources = low.select("image_id", "y", "x", F.floor(F.col("gray") * F.col("alpha") / 255).cast("int").alias("v"), F.col("alpha").alias("a"))
    i = F.col("image_id")
    size = low.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).cast("int").alias("h"))
    views = size.select((i % 2).alias("target_id"), i.alias("ord"), "image_id", "w", "h", (i * 2.5 - 3.0).alias("dst_x"), (i * 1.5).alias("dst_y"), (F.lit(0.5) + i % 3 * 0.75).alias("scale_x"), (F.lit(1.0) + i % 2 * 0.5).alias("scale_y"))
    return composited(sources, views, 96, 96)


def _effects(spark, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    kind = F.element_at(F.array(*map(F.lit, ("vector", "raster", "vector", "volume"))), (F.when(F.col("l_partkey") % 40 == 7, 3).otherwise(F.col("l_linenumber") % 3) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stock_id"), k.alias("seq"), F.concat(F.lit("w"), (F.col("l_partkey") % 9).cast("string")).alias("source_key"), kind.alias("kind"),
                                                   F.when(F.col("l_partkey") % 50 == 1, -1.0).when(F.col("l_linenumber") % 2 == 0, 0.0).alias("z_from"), F.when(F.col("l_linenumber") % 4 != 1, -(F.col("l_partkey") % 8).cast("double")).alias("z_to"))
    return classified(rows, -5.0)


QUERIES = {
    "image_sweeps": _pixels(lambda p: _flat(_sweeps(p))),
    "image_segments": _pixels(lambda p: segmented(scan_rows(power(p, 0.1, 0.9, 16)), 0.1).withColumn("samples", F.array_join("samples", ","))),
    "merge_scanlines": _pixels(lambda p: merged_lines(segmented(scan_rows(power(p, 0.1, 0.9, 16)), 0.1), 0.1).withColumn("samples", F.array_join("samples", ","))),
    "scanline_boxes": _pixels(lambda p: scanline_boxes(_sweeps(p))),
    "container_bytes": _pixels(lambda p: container_bytes(_sweeps(p))),
    "cap_samples": _pixels(lambda p: _flat(capped(_sweeps(p), 0.4))),
    "overscan": _pixels(lambda p: _flat(overscanned(_sweeps(p), 0.25))),
    "bidirectional_offset": _pixels(lambda p: _flat(bidirectional_offset(_sweeps(p), 0.7))),
    "clip_sweeps_to_rect": _pixels(lambda p: _flat(clipped_rect(_sweeps(p), (0.55, 0.3, 2.75, 4.05)))),
    "scan_positions": _pixels(lambda p: scan_positions(_boxes(p), 10.0, 0.25, 0.13)),
    "resample_rows": _pixels(lambda p: resampled_rows(p, scan_positions(_boxes(p), 10.0, 0.75, 0.13))),
    "adaptive_sizes": _pixels(lambda p: adaptive_sizes(_areas(p))),
    "denoise": _pixels(lambda p: denoised(_areas(p))),
    "composite_views": _pixels(_composite),
    "effect_classes": _effects,
    "grid_coordinates": lambda spark, sf_dir: rounded(grid_coordinates(table(spark, sf_dir, "mesh_verts"), (1.5, -2.0), (4.0, 8.0), (200, 160))),
}

_SWEEP = f"""{_POWER}, i0 AS (SELECT image_id, y, min(x) FILTER (power <> 0) AS lo, max(x) FILTER (power <> 0) + 1 AS hi, list(power ORDER BY x) AS s FROM pw GROUP BY image_id, y),
 i1 AS (SELECT *, y % 2 = 1 AS back, s[lo + 1:hi] AS cut FROM i0 WHERE lo IS NOT NULL),
 i2 AS (SELECT image_id AS job_id, y AS line, 1 AS part, 'MOVE_TO' AS cmd, CASE WHEN back THEN hi ELSE lo END * 0.1::DOUBLE AS x, y * 0.1::DOUBLE AS y, NULL::INT[] AS samples FROM i1
  UNION ALL SELECT image_id, y, 2, 'SCAN_LINE', CASE WHEN back THEN lo ELSE hi END * 0.1::DOUBLE, y * 0.1::DOUBLE, CASE WHEN back THEN list_reverse(cut) ELSE cut END FROM i1
  UNION ALL SELECT DISTINCT image_id, -1, 0, 'OPS_SECTION_START', NULL::DOUBLE, NULL::DOUBLE, NULL::INT[] FROM i0 UNION ALL SELECT DISTINCT image_id, 1099511627776, 0, 'OPS_SECTION_END', NULL, NULL, NULL FROM i0),
 sw AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY line, part) - 1 AS seq, cmd, x, y, samples FROM i2)"""
_TXT = "array_to_string(samples, ',') AS samples"
_PAIRS = f"""{_SWEEP}, ab AS (SELECT a.job_id, a.seq AS s, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, b.samples FROM sw a JOIN sw b ON b.job_id = a.job_id AND b.seq = a.seq + 1 WHERE b.cmd = 'SCAN_LINE')"""
_AREAS = f"""{_COMPONENTS},
 bn AS (SELECT image_id, area, count(*) AS n FROM ar GROUP BY ALL), gp AS (SELECT *, lag(area) OVER (PARTITION BY image_id ORDER BY area) AS below FROM bn),
 sz AS (SELECT image_id, CASE WHEN bool_and(area > 10 AND n < 10) OR count(*) <= 1 THEN 2 ELSE greatest(2, least(100, arg_max(below, (area - below, -below)) FILTER (below IS NOT NULL) + 1)) END::INT AS min_area FROM gp GROUP BY image_id)"""
_POS = """, bx AS (SELECT image_id, min(y) FILTER (gray <= 150) AS y_min, max(y) FILTER (gray <= 150) AS y_max, max(y) + 1 AS height FROM pixels GROUP BY image_id),
 ps AS (SELECT image_id, height, ceil((y_min / 10.0::DOUBLE + 0.13) / {i}) * {i} - 0.13 AS first, (y_max + 1) / 10.0::DOUBLE AS high FROM bx WHERE y_min IS NOT NULL),
 po AS (SELECT image_id, r::INT AS row, first + r * {i} AS y_mm, least(greatest((first + r * {i}) * 10, 0), height - 1)::DOUBLE AS y_px FROM (SELECT *, unnest(range(greatest(ceil((high - first) / {i} - 1e-9), 0)::BIGINT)) AS r FROM ps))"""
ORACLE_SQL = {
    "image_sweeps": f"{_SWEEP} SELECT job_id, seq, cmd, round(x, 6) AS x, round(y, 6) AS y, {_TXT} FROM sw",
    "image_segments": f"{_RUNS} SELECT r.image_id AS job_id, r.y, round(lo * 0.1, 6)::DOUBLE AS x0, round(hi * 0.1, 6)::DOUBLE AS x1, string_agg(power, ',' ORDER BY x) AS samples FROM runs r JOIN pw ON pw.image_id = r.image_id AND pw.y = r.y AND x >= lo AND x < hi GROUP BY r.image_id, r.y, lo, hi",
    "merge_scanlines": f"""{_RUNS}, g AS (SELECT *, coalesce(lo - lag(hi) OVER w > 1, true) AS new FROM runs WINDOW w AS (PARTITION BY image_id, y ORDER BY lo)),
 k AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, y ORDER BY lo ROWS UNBOUNDED PRECEDING) AS i FROM g), m AS (SELECT image_id, y, i, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM k GROUP BY ALL)
 SELECT m.image_id AS job_id, m.y, round(lo * 0.1, 6)::DOUBLE AS x0, round(hi * 0.1, 6)::DOUBLE AS x1, n, string_agg(power, ',' ORDER BY x) AS samples FROM m JOIN pw ON pw.image_id = m.image_id AND pw.y = m.y AND x >= lo AND x < hi GROUP BY m.image_id, m.y, lo, hi, n""",
    "scanline_boxes": f"""{_PAIRS} SELECT job_id, round(min(least(ax, bx)), 6) AS min_x, round(min(least(ay, by_)), 6) AS min_y, round(max(greatest(ax, bx)) - min(least(ax, bx)), 6) AS width,
 round(max(greatest(ay, by_)) - min(least(ay, by_)), 6) AS height FROM ab GROUP BY job_id""",
    "container_bytes": f"{_SWEEP} SELECT job_id, (count(*) * {COMMAND_BYTES} + coalesce(sum(len(samples)), 0))::BIGINT AS bytes FROM sw GROUP BY job_id",
    "cap_samples": f"{_SWEEP} SELECT job_id, seq, cmd, round(x, 6) AS x, round(y, 6) AS y, array_to_string(list_transform(samples, lambda v: least(v, 102)), ',') AS samples FROM sw",
    "overscan": f"""{_PAIRS}, d AS (SELECT *, CASE WHEN bx > ax THEN 0.25 ELSE -0.25 END AS u, list_transform(range(ceil(0.25 * len(samples) / abs(bx - ax))::BIGINT), lambda i: 0) AS pad FROM ab)
 SELECT sw.job_id, seq, cmd, round(CASE WHEN p.s IS NOT NULL THEN sw.x - p.u WHEN q.s IS NOT NULL THEN sw.x + q.u ELSE sw.x END, 6) AS x, round(sw.y, 6) AS y,
 array_to_string(CASE WHEN q.s IS NOT NULL THEN q.pad || sw.samples || q.pad ELSE sw.samples END, ',') AS samples
 FROM sw LEFT JOIN d p ON p.job_id = sw.job_id AND p.s = sw.seq LEFT JOIN d q ON q.job_id = sw.job_id AND q.s + 1 = sw.seq""",
    "bidirectional_offset": f"""{_PAIRS} SELECT sw.job_id, seq, cmd, round(CASE WHEN ab.bx < ab.ax THEN sw.x + 0.7 ELSE sw.x END, 6) AS x, round(sw.y, 6) AS y, array_to_string(sw.samples, ',') AS samples
 FROM sw LEFT JOIN ab ON ab.job_id = sw.job_id AND sw.seq BETWEEN ab.s AND ab.s + 1""",
    "clip_sweeps_to_rect": f"""{_PAIRS}, c AS (SELECT job_id, s + 1 AS seq, ay, greatest(0, least((0.55 - ax) / (bx - ax), (2.75 - ax) / (bx - ax))) AS t0, least(1, greatest((0.55 - ax) / (bx - ax), (2.75 - ax) / (bx - ax))) AS t1, ax, bx, samples
  FROM ab WHERE ay BETWEEN 0.3 AND 4.05), k AS (SELECT * FROM c WHERE t0 <= t1)
 SELECT job_id, seq, 0 AS part, 'MOVE_TO' AS cmd, round(ax + t0 * (bx - ax), 6) AS x, round(ay, 6) AS y, NULL AS samples FROM k
 UNION ALL SELECT job_id, seq, 1, 'SCAN_LINE', round(ax + t1 * (bx - ax), 6), round(ay, 6), array_to_string(samples[floor(len(samples) * t0)::INT + 1:floor(len(samples) * t1)::INT], ',') FROM k
 UNION ALL SELECT job_id, seq, 1, cmd, NULL, NULL, NULL FROM sw WHERE cmd LIKE 'OPS%'""",
    "scan_positions": f"{_POWER}{_POS.format(i='0.25::DOUBLE')} SELECT image_id, row, round(y_mm, 6) AS y_mm, round(y_px, 6) AS y_px FROM po",
    "resample_rows": f"""{_POWER}{_POS.format(i='0.75::DOUBLE')} SELECT po.image_id, po.row, a.x, round(a.gray * (1 - (y_px - floor(y_px))) + b.gray * (y_px - floor(y_px)), 6) AS gray
 FROM po JOIN pixels a ON a.image_id = po.image_id AND a.y = floor(y_px) JOIN pixels b ON b.image_id = po.image_id AND b.y = ceil(y_px) AND b.x = a.x""",
    "adaptive_sizes": f"{_AREAS} SELECT image_id, min_area FROM sz",
    "denoise": f"{_AREAS} SELECT image_id, label, area FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS c FROM ar) JOIN sz USING (image_id) WHERE area >= min_area OR c = 1",
    "composite_views": f"""{_POWER.replace('WITH', 'WITH RECURSIVE', 1)}, so AS MATERIALIZED (SELECT image_id, y, x, gray * a // 255 AS v, a FROM (SELECT image_id, y, x, gray, (gray * 7 + x * 31) % 4 * 85 AS a FROM pixels)),
 vw AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h, image_id % 2 AS target_id, (image_id * 2.5 - 3.0)::DOUBLE AS dx, (image_id * 1.5)::DOUBLE AS dy, (0.5 + image_id % 3 * 0.75)::DOUBLE AS sx, (1.0 + image_id % 2 * 0.5)::DOUBLE AS sy FROM so GROUP BY image_id),
 ce AS (SELECT target_id, image_id, px, py, greatest(least(floor((px - dx + 0.5) / sx), w - 1), 0)::BIGINT AS x, greatest(least(floor((py - dy + 0.5) / sy), h - 1), 0)::BIGINT AS y FROM vw, range(96) a(px), range(96) b(py)
  WHERE px >= floor(dx) AND px < ceil(dx + w * sx) AND py >= floor(dy) AND py < ceil(dy + h * sy)),
 la AS (SELECT ce.*, v, a, row_number() OVER (PARTITION BY target_id, py, px ORDER BY ce.image_id) AS i, count(*) OVER (PARTITION BY target_id, py, px) AS n FROM ce JOIN so ON so.image_id = ce.image_id AND so.x = ce.x AND so.y = ce.y WHERE a > 0),
 fo AS (SELECT target_id, py, px, i, n, v::INT AS v, a::INT AS a FROM la WHERE i = 1 UNION ALL
  SELECT la.target_id, la.py, la.px, la.i, la.n, (la.v + (fo.v * (255 - la.a) + 127) // 255)::INT, (la.a + (fo.a * (255 - la.a) + 127) // 255)::INT FROM fo JOIN la ON la.target_id = fo.target_id AND la.py = fo.py AND la.px = fo.px AND la.i = fo.i + 1)
 SELECT target_id, py, px, v, a FROM fo WHERE i = n""",
    "effect_classes": """WITH e AS (SELECT l_suppkey AS stock_id, l_orderkey * 8 + l_linenumber AS seq, 'w' || (l_partkey % 9)::VARCHAR AS source_key,
 CASE WHEN l_partkey % 40 = 7 THEN 'volume' WHEN l_linenumber % 3 = 1 THEN 'raster' ELSE 'vector' END AS kind, CASE WHEN l_partkey % 50 = 1 THEN -1.0 WHEN l_linenumber % 2 = 0 THEN 0.0 END AS zf,
 CASE WHEN l_linenumber % 4 <> 1 THEN -(l_partkey % 8) END AS zt FROM lineitem),
 f AS (SELECT *, coalesce(zf >= -1e-6, true) AS top, coalesce(zt <= -5 + 1e-6, true) AS thr, CASE WHEN kind = 'vector' AND NOT coalesce(zf >= -1e-6, true) THEN 'top-open:' || source_key WHEN kind = 'volume' THEN 'solid:' || source_key END AS w FROM e)
 SELECT stock_id, count(*) FILTER (kind = 'vector' AND top AND thr) AS voids, count(*) FILTER (kind = 'raster') AS rasters, arg_min(w, seq) FILTER (w IS NOT NULL) AS escalation, string_agg(DISTINCT source_key, ',' ORDER BY source_key) AS provenance FROM f GROUP BY stock_id""",
    "grid_coordinates": f"{cte('mesh_verts')} SELECT v, round((x - 1.5) * 4 / 200, 6)::DOUBLE AS u, round((y + 2) * 8 / 160, 6)::DOUBLE AS w FROM mesh_verts",
}
