"""Rasters as pixel tables ``(image_id, y, x, gray, a)`` and row arrays: levels, thresholds, dither, runs, scanlines.

Projections stay on pixels; runs and scanlines work on one array per row, so an image of any size is many small rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geometry import hypot
from pathloom.functions.loops import component_labels, saved
from pathloom.operators.commands import rounded
from pathloom.sources.derive import cte, table

#: The 4 x 4 ordered-dither matrix by rows.
BAYER = ((0, 8, 2, 10), (12, 4, 14, 6), (3, 11, 1, 9), (15, 7, 13, 5))


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5)


def to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def from_linear(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def srgb(pixels: DataFrame) -> DataFrame:
    """Linear light of each gray level, and back again."""
    line = to_linear(F.col("gray") / 255.0)
    return pixels.select("image_id", "y", "x", line.alias("linear"), half_up(from_linear(line) * 255.0).alias("back"))


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "gray").agg(F.count(F.lit(1)).alias("n"))


def auto_levels(pixels: DataFrame, clip: float) -> DataFrame:
    """Black and white point of each image from the tails of its histogram; at least two levels apart."""
    up = Window.partitionBy("image_id").orderBy("gray")
    down = Window.partitionBy("image_id").orderBy(F.desc("gray"))
    rows = histogram(pixels).select("*", F.sum("n").over(up).alias("below"), F.sum("n").over(down).alias("above"), F.sum("n").over(Window.partitionBy("image_id")).alias("total"))
    lower = F.ceil((F.col("total").cast("float") * F.lit(clip).cast("float") / F.lit(100.0).cast("float")).cast("float"))
    upper = F.floor((F.col("total").cast("float") * F.lit(100.0 - clip).cast("float") / F.lit(100.0).cast("float")).cast("float"))
    black = F.min(F.when(F.col("below") >= lower, F.col("gray")))
    white = F.max(F.when(F.col("above") >= F.col("total") - upper, F.col("gray")))
    points = rows.groupBy("image_id").agg(black.alias("b"), white.alias("w")).select("image_id", F.least("b", F.lit(253)).alias("black"), "w")
    return points.select("image_id", "black", F.greatest("w", F.col("black") + 2).alias("white"))


def stretched(pixels: DataFrame, levels: DataFrame) -> DataFrame:
    """Gray levels spread between the image's points."""
    rows = pixels.join(levels, "image_id")
    v = (F.least(F.greatest(F.col("gray"), F.col("black")), F.col("white")) - F.col("black")) / (F.col("white") - F.col("black")) * 255.0
    return rows.select("image_id", "y", "x", half_up(v).alias("gray"), "a")


def otsu(pixels: DataFrame) -> DataFrame:
    """Threshold of the largest between-class variance, the smallest of equal ones."""
    up = Window.partitionBy("image_id").orderBy("gray")
    whole = Window.partitionBy("image_id")
    rows = histogram(pixels).select("*", F.sum("n").over(up).alias("w"), F.sum(F.col("gray") * F.col("n")).over(up).alias("s"), F.sum("n").over(whole).alias("total"), F.sum(F.col("gray") * F.col("n")).over(whole).alias("all"))
    rest = F.col("total") - F.col("w")
    gap = F.col("s") / F.col("w") - F.try_divide(F.col("all") - F.col("s"), rest)
    spread = F.col("w").cast("double") * rest.cast("double") * gap * gap
    best = rows.filter(rest > 0).withColumn("v", spread).groupBy("image_id").agg(F.max(F.struct("v", (-F.col("gray")).alias("g"))).alias("s"))
    return best.select("image_id", F.when(F.col("s.v") > 0, -F.col("s.g")).otherwise(0).alias("threshold"))


def binary(pixels: DataFrame, thresholds: DataFrame, invert: bool = False) -> DataFrame:
    ink = F.col("gray") > F.col("threshold") if invert else F.col("gray") <= F.col("threshold")
    return pixels.join(thresholds, "image_id").select("image_id", "y", "x", ink.cast("int").alias("ink"))


def power(pixels: DataFrame, low: float, high: float, levels: int) -> DataFrame:
    """Power bytes: darker is stronger, transparent is 0, quantised to ``levels``. Columns besides those of pixels stay."""
    pv = half_up((F.lit(low) + (F.lit(1.0) - F.col("gray") / 255.0) * (high - low)) * 255.0)
    pv = F.when(F.col("a") == 0, F.lit(0)).otherwise(pv)
    more = [c for c in pixels.columns if c not in ("image_id", "y", "x", "gray", "a")]
    return pixels.select("image_id", "y", "x", *more, half_up(half_up(pv * (levels - 1) / 255.0) * 255.0 / (levels - 1)).cast("int").alias("power"))


def bayer(pixels: DataFrame, cell: int = 1) -> DataFrame:
    """Ordered dither: ink where the level is not above the threshold of its place."""
    place = F.pmod(F.floor(F.col("y") / cell), F.lit(4)) * 4 + F.pmod(F.floor(F.col("x") / cell), F.lit(4))
    matrix = F.array(*[F.lit(float(v)) for row in BAYER for v in row])
    return pixels.select("image_id", "y", "x", (F.col("gray") <= F.get(matrix, place.cast("int")) * (255.0 / 16)).cast("int").alias("ink"))


@lru_cache
def spot_levels(samples: int = 256) -> tuple[float, ...]:
    """For each gray level the spot value above which a pixel of that level is inked.

    The share of a cell below a spot value, sampled on a grid of ``samples`` each way, is the brightness up to which it inks.
    """
    at = np.cos(2 * np.pi * (np.arange(samples) + 0.5) / samples)
    values = np.sort((at[:, None] + at[None, :]).ravel() / 4 + 0.5)
    least = [math.floor(g / 255 * len(values) - 0.5) + 1 for g in range(256)]  # the first rank whose share exceeds the level
    return tuple(-1.0 if k < 1 else 2.0 if k > len(values) else float(values[k - 1]) for k in least)


def halftone(pixels: DataFrame, cell: float, degrees: float, per_mm_x: float, per_mm_y: float, invert: bool = False) -> DataFrame:
    """Round dots on a lattice of ``cell`` mm turned by an angle; darker pixels are inked further from a dot's centre."""
    c, s = math.cos(math.radians(degrees)) / cell, math.sin(math.radians(degrees)) / cell
    x, y = (F.col("x") + 0.5) / per_mm_x, (F.col("y") + 0.5) / per_mm_y
    u, v = x * c + y * s, y * c - x * s
    spot = (F.cos(u * (2 * math.pi)) + F.cos(v * (2 * math.pi))) / 4 + 0.5
    ink = spot > F.get(F.array(*map(F.lit, spot_levels())), F.col("gray").cast("int"))
    return pixels.select("image_id", "y", "x", (~ink if invert else ink).cast("int").alias("ink"))


def newsprint_ranks(size: int = 8) -> list[int]:
    """Order in which the pixels of a screen cell darken, dots on a lattice at 45 degrees; equal ones by rows."""
    at = (np.arange(size) + 0.5) / size
    u, v = at[None, :], at[:, None]
    spot = np.round((np.cos(2 * np.pi * (u + v)) + np.cos(2 * np.pi * (u - v))) / 4 + 0.5, 12).ravel()
    ranks = np.empty(size * size, dtype=int)
    ranks[np.argsort(-spot, kind="stable")] = np.arange(size * size)
    return ranks.tolist()


def newsprint(pixels: DataFrame, cell: int, per_mm_x: float, per_mm_y: float, invert: bool = False) -> DataFrame:
    """Clustered dots by an 8 x 8 matrix of ranks, each entry ``cell`` pixels wide and as high in mm."""
    tall = max(1, int(cell * per_mm_y / per_mm_x + 0.5))
    place = F.pmod(F.floor(F.col("y") / tall), F.lit(8)) * 8 + F.pmod(F.floor(F.col("x") / cell), F.lit(8))
    levels = F.array(*[F.lit(255.0 * (1.0 - (r + 0.5) / 64)) for r in newsprint_ranks()])
    ink = F.col("gray") < F.get(levels, place.cast("int"))
    return pixels.select("image_id", "y", "x", (~ink if invert else ink).cast("int").alias("ink"))


def gray_from_rgba(pixels: DataFrame) -> DataFrame:
    """Gray levels of premultiplied colours ``(r, g, b, a)``, blended over white in linear light."""
    share = F.col("a") / 255.0
    def light(c):  # noqa: E306
        v = F.floor(F.least(F.greatest(F.col(c) / F.greatest(share, F.lit(1e-6)), F.lit(0.0)), F.lit(255.0))) / 255.0
        return F.lit(1.0) - (F.lit(1.0) - to_linear(v)) * share
    line = light("r") * 0.2989 + light("g") * 0.5870 + light("b") * 0.1140
    return pixels.select("image_id", "y", "x", half_up(from_linear(F.least(F.greatest(line, F.lit(0.0)), F.lit(1.0))) * 255.0).alias("gray"), share.alias("alpha"))


def transparent_by_brightness(pixels: DataFrame, threshold: int) -> DataFrame:
    light = F.shiftright(F.col("gray") * 77 + F.col("gray") * 150 + F.col("gray") * 29, 8)
    return pixels.select("image_id", "y", "x", F.when(light >= threshold, 0).otherwise(F.col("a")).alias("a"))


def content_box(pixels: DataFrame, level: int) -> DataFrame:
    """Box of the pixels at or below a level that are not transparent."""
    ink = pixels.filter((F.col("gray") <= level) & (F.col("a") > 0))
    return ink.groupBy("image_id").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))], F.count(F.lit(1)).alias("n"))


def scan_rows(powers: DataFrame) -> DataFrame:
    """One array of samples per image row."""
    rows = powers.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", "power"))).alias("s"))
    return rows.select("image_id", "y", F.transform("s", lambda p: p["power"]).alias("samples"))


def runs(rows: DataFrame) -> DataFrame:
    """Non-zero runs of each row: half-open index ranges."""
    at = F.posexplode("samples").alias("i", "v")
    ink = rows.select("image_id", "y", at).filter("v <> 0")
    w = Window.partitionBy("image_id", "y").orderBy("i")
    return ink.withColumn("g", F.col("i") - F.row_number().over(w)).groupBy("image_id", "y", "g").agg(F.min("i").alias("lo"), (F.max("i") + 1).alias("hi"), F.sum("v").alias("total")).drop("g")


def trimmed(rows: DataFrame, n: int) -> DataFrame:
    """Samples with ``n`` zeroed at both ends of every run: those that have a zero or an end within ``n`` places."""
    size = F.size("samples")
    def near(i):  # noqa: E306
        around = F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda o: F.coalesce(F.get("samples", i + o), F.lit(0)))
        return F.exists(around, lambda v: v == 0)
    return rows.select("image_id", "y", F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(near(i), 0).otherwise(F.get("samples", i))).alias("samples"))


def zero_runs(rows: DataFrame) -> DataFrame:
    """Runs of zeros of each row between its first and last non-zero sample: half-open index ranges."""
    at = rows.select("image_id", "y", F.posexplode("samples").alias("i", "v"))
    ink = at.filter("v <> 0").withColumn("next", F.lead("i").over(Window.partitionBy("image_id", "y").orderBy("i")))
    return ink.filter("next > i + 1").select("image_id", "y", (F.col("i") + 1).alias("lo"), F.col("next").alias("hi"))


def long_runs(rows: DataFrame, least: int) -> DataFrame:
    """Samples without the runs shorter than ``least``: a sample stays if ``least`` non-zero ones in a row hold it."""
    def held(i):  # noqa: E306
        def whole(o):  # noqa: E306
            return F.forall(F.sequence(F.lit(0), F.lit(least - 1)), lambda k: F.coalesce(F.get("samples", i + o + k), F.lit(0)) != 0)
        return F.exists(F.sequence(F.lit(1 - least), F.lit(0)), whole)
    return rows.select("image_id", "y", F.transform(F.sequence(F.lit(0), F.size("samples") - 1), lambda i: F.when(held(i), F.get("samples", i)).otherwise(0)).alias("samples"))


def downsampled(rows: DataFrame, n: int) -> DataFrame:
    """``n`` samples of each row at equal steps from its first to its last one."""
    step = (F.size("samples") - 1) / F.lit(float(n - 1))
    return rows.select("image_id", "y", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("samples", F.floor(i * step).cast("int"))).alias("samples"))


def scan_lines(rows: DataFrame, pitch: float) -> DataFrame:
    """Serpentine scanline commands over the content of each row: a travel and a line for every row with ink."""
    spans = runs(rows).groupBy("image_id", "y").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"))
    back = F.col("y") % 2 == 1
    x0, x1 = F.when(back, F.col("hi")).otherwise(F.col("lo")) * pitch, F.when(back, F.col("lo")).otherwise(F.col("hi")) * pitch
    row = lambda i, c, x, t: F.struct(F.lit(i).alias("part"), F.lit(c).alias("cmd"), x.alias("x"), (F.col("y") * pitch).alias("line_y"), t.alias("total"))
    return spans.select("image_id", "y", F.inline(F.array(row(0, "MOVE_TO", x0, F.lit(None).cast("long")), row(1, "SCAN_LINE", x1, F.col("total"))))).drop("y_")


def depth_passes(pixels: DataFrame, passes: int) -> DataFrame:
    """Rows of pixels burned in each pass: a pixel takes part in as many passes as its darkness asks for."""
    level = F.ceil((F.lit(1.0) - F.col("gray") / 255.0) * passes).cast("int")
    deep = pixels.withColumn("level", level).filter("level > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("level"))))
    return deep.groupBy("image_id", "pass", "y").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def components(ink: DataFrame) -> DataFrame:
    """8-connected components of inked pixels ``(image_id, y, x)`` with their areas.

    Rows become runs first; runs of neighbouring rows that touch are edges, and labels are the smallest run numbers.
    """
    w = Window.partitionBy("image_id", "y").orderBy("x")
    line = ink.withColumn("g", F.col("x") - F.row_number().over(w)).groupBy("image_id", "y", "g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    line = saved(line.select("image_id", "y", "lo", "hi", (F.shiftleft(F.col("y").cast("long"), 32) + F.col("lo")).alias("run")))
    up = line.select("image_id", (F.col("y") + 1).alias("y"), F.col("lo").alias("ulo"), F.col("hi").alias("uhi"), F.col("run").alias("urun"))
    touch = line.join(up, ["image_id", "y"]).filter((F.col("lo") <= F.col("uhi") + 1) & (F.col("ulo") <= F.col("hi") + 1))
    labels = component_labels(line.select("image_id", F.col("run").alias("node")), touch.select("image_id", F.col("run").alias("a"), F.col("urun").alias("b")))
    sizes = line.join(labels.withColumnRenamed("node", "run"), ["image_id", "run"]).select("image_id", "label", (F.col("hi") - F.col("lo") + 1).alias("n"))
    return sizes.groupBy("image_id", "label").agg(F.sum("n").alias("area"))


def fluence(rows: DataFrame, cell: int, peak: float) -> DataFrame:
    """Largest power in each square of ``cell`` samples, as a share of ``peak``: ``max`` is combined before the shuffle."""
    at = rows.select("image_id", "y", F.posexplode("samples").alias("i", "v"))
    square = at.select("image_id", F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("i") / cell).alias("cx"), "v")
    return square.groupBy("image_id", "cy", "cx").agg((F.max("v") / 255.0 * peak).alias("fluence"))


def burn_surface(rows: DataFrame, placements: DataFrame) -> DataFrame:
    """Largest power per cell of each stock under all rasters placed on it: ``stock_id, px, py, power``."""
    at = rows.select("image_id", "y", F.posexplode("samples").alias("x", "v")).filter("v > 0").join(placements, F.col("image_id") == F.col("source_key"))
    spread = at.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("sx") - 1))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("sy") - 1)))
    cells = spread.select("stock_id", (F.col("x") * F.col("sx") + F.col("ix") + F.col("tx")).alias("px"), (F.col("y") * F.col("sy") + F.col("iy") + F.col("ty")).alias("py"), "v")
    return cells.groupBy("stock_id", "px", "py").agg(F.max("v").alias("power"))


def edge_ramp(ink: DataFrame, length: float, per_mm_x: float, per_mm_y: float) -> DataFrame:
    """Distance of every inked pixel to the edge of the ink in both directions, as a share of ``length`` (mm), at most 1.

    The nearest pixel without ink by its centre counts, pixels outside the image included; the part of the way inside
    that pixel is left out, and of equally near ones the smaller distance counts. Columns first, by windows: the nearest
    gap above and below; then rows, by a window of the columns within reach only, as farther ones give 1: no row is made for
    a pixel and a column beside it.
    """
    sx, sy = 1.0 / per_mm_x, 1.0 / per_mm_y
    reach = int(length * per_mm_x) + 2
    size = ink.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    up = Window.partitionBy("image_id", "x").orderBy("y")
    gap = F.when(F.col("ink") == 0, F.col("y"))
    above = F.coalesce(F.last(gap, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    down = Window.partitionBy("image_id", "x").orderBy(F.desc("y"))  # a frame that ends with the column would be read anew for every pixel
    below = F.coalesce(F.last(gap, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)), F.col("h"))
    rows = ink.join(size, "image_id").withColumn("dy", F.least(F.col("y") - above, below - F.col("y")))
    beside = F.collect_list(F.struct("x", "dy")).over(Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-reach, reach))
    rows = rows.select("image_id", "y", "x", "w", "ink", beside.alias("l")).filter("ink = 1")
    half = lambda d, s: F.when(d == 0, F.lit(float("inf"))).otherwise(F.lit(s / 2) / d)

    def edge(at: Column, up: Column) -> Column:
        dx, dy = F.abs(at - F.col("x")) * sx, up * sy
        away = hypot(dx, dy)
        return F.struct(F.round(away, 9).alias("d"), (away * (F.lit(1.0) - F.least(half(dx, sx), half(dy, sy), F.lit(1.0)))).alias("e"))

    missing = F.array_except(F.sequence(F.greatest(F.col("x") - reach, F.lit(-1)), F.least(F.col("x") + reach, F.col("w"))), F.transform("l", lambda p: p["x"]))
    every = F.concat(F.transform("l", lambda p: edge(p["x"], p["dy"])), F.transform(missing, lambda at: edge(at, F.lit(0))))
    best = rows.select("image_id", "y", "x", F.array_min(every).alias("s"))
    return best.select("image_id", "y", "x", F.least(F.col("s.e") / length, F.lit(1.0)).alias("ramp"))


# Queries and their SQL ----------------------------------------------------------------------------------------------


def _q(f, digits=6):
    return lambda spark, sf_dir: rounded(f(table(spark, sf_dir, "pixels")), digits=digits)


def _placements(df: DataFrame) -> DataFrame:
    one = df.select("image_id").distinct()
    i = F.col("image_id")
    return one.select((i % 3).alias("stock_id"), i.alias("source_key"), (i % 2 + 1).alias("sx"), (i % 2 + 1).alias("sy"), (i * 5).alias("tx"), (i * 3).alias("ty"))


def _rows(p: DataFrame) -> DataFrame:
    return scan_rows(power(p, 0.1, 0.9, 16))


def _rgba(p: DataFrame) -> DataFrame:
    a = (F.col("gray") * 5 + F.col("x") * 51) % 256
    return p.select("image_id", "y", "x", *[F.floor((F.col("gray") * k + F.col("y")) % 256 * a / 255).alias(c) for c, k in (("r", 1), ("g", 3), ("b", 7))], a.alias("a"))


_ink = lambda p: p.filter("gray <= 110").select("image_id", "y", "x")

QUERIES = {
    "srgb": _q(srgb),
    "auto_levels": _q(lambda p: auto_levels(p, 2.0)),
    "stretch_levels": _q(lambda p: stretched(p, auto_levels(p, 2.0))),
    "otsu_threshold": _q(otsu),
    "binary_image": _q(lambda p: binary(p, otsu(p))),
    "pixel_power": _q(lambda p: power(p, 0.1, 0.9, 16)),
    "bayer_dither": _q(lambda p: bayer(p, 2)),
    "halftone_dither": _q(lambda p: halftone(p, 0.7, 30.0, 10.0, 8.0)),
    "newsprint_dither": _q(lambda p: newsprint(p, 2, 10.0, 16.0)),
    "gray_from_rgba": _q(lambda p: gray_from_rgba(_rgba(p))),
    "transparent_bright": _q(lambda p: transparent_by_brightness(p, 160)),
    "content_box": _q(lambda p: content_box(p, 90)),
    "sample_runs": _q(lambda p: runs(_rows(p))),
    "trim_runs": _q(lambda p: trimmed(_rows(p), 1).select("image_id", "y", F.array_join("samples", ",").alias("samples"))),
    "zero_runs": _q(lambda p: zero_runs(_rows(p))),
    "long_runs": _q(lambda p: long_runs(_rows(p), 3).select("image_id", "y", F.array_join("samples", ",").alias("samples"))),
    "downsample_rows": _q(lambda p: downsampled(_rows(p), 17).select("image_id", "y", F.array_join("samples", ",").alias("samples"))),
    "scan_lines": _q(lambda p: scan_lines(_rows(p), 0.1)),
    "depth_passes": _q(lambda p: depth_passes(p, 4)),
    "image_components": _q(lambda p: components(_ink(p))),
    "fluence_map": _q(lambda p: fluence(_rows(p), 4, 12.5)),
    "burn_surface": _q(lambda p: burn_surface(_rows(p), _placements(p))),
    "edge_ramp": _q(lambda p: edge_ramp(p.select("image_id", "y", "x", (F.col("gray") <= 150).cast("int").alias("ink")), 0.45, 10.0, 8.0)),
}
_P = cte("pixels")
_H = f"{_P}, h AS (SELECT image_id, gray, count(*) AS n FROM pixels GROUP BY ALL)"
_LEVELS = f"""{_H}, c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY gray) AS below, sum(n) OVER (PARTITION BY image_id ORDER BY gray DESC) AS above, sum(n) OVER (PARTITION BY image_id) AS total FROM h),
 l0 AS (SELECT image_id, least(min(gray) FILTER (below >= ceil(total::FLOAT * 2::FLOAT / 100::FLOAT)), 253) AS black, max(gray) FILTER (above >= total - floor(total::FLOAT * 98::FLOAT / 100::FLOAT)) AS w FROM c GROUP BY image_id),
 levels AS (SELECT image_id, black, greatest(w, black + 2) AS white FROM l0)"""
_OTSU = f"""{_H}, c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY gray) AS w, sum(gray * n) OVER (PARTITION BY image_id ORDER BY gray) AS s, sum(n) OVER (PARTITION BY image_id) AS total, sum(gray * n) OVER (PARTITION BY image_id) AS every FROM h),
 v AS (SELECT image_id, gray, w::DOUBLE * (total - w)::DOUBLE * (s::DOUBLE / w - (every - s)::DOUBLE / (total - w)) ** 2 AS v FROM c WHERE total > w),
 o AS (SELECT image_id, gray AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, gray) AS i FROM v) WHERE i = 1)"""
_POWER = f"""{_P}, pw AS (SELECT image_id, y, x, floor(floor(CASE WHEN a = 0 THEN 0 ELSE floor((0.1 + (1 - gray / 255.0) * 0.8) * 255 + 0.5) END * 15 / 255.0 + 0.5) * 255.0 / 15 + 0.5)::INT AS power FROM pixels)"""
_RUNS = f"""{_POWER}, i AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM pw WHERE power <> 0),
 runs AS (SELECT image_id, y, min(x) AS lo, max(x) + 1 AS hi, sum(power)::BIGINT AS total FROM i GROUP BY image_id, y, g)"""
_COMPONENTS = f"""{_P.replace('WITH', 'WITH RECURSIVE', 1)}, k AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM pixels WHERE gray <= 110),
 l AS (SELECT image_id, y, min(x) AS lo, max(x) AS hi, y * 4294967296 + min(x) AS run FROM k GROUP BY image_id, y, g),
 t AS (SELECT a.image_id, a.run AS u, b.run AS v FROM l a JOIN l b ON a.image_id = b.image_id AND abs(a.y - b.y) = 1 AND a.lo <= b.hi + 1 AND b.lo <= a.hi + 1),
 r AS (SELECT image_id, run AS node, run AS label FROM l UNION SELECT t.image_id, t.v, r.label FROM r JOIN t ON t.image_id = r.image_id AND t.u = r.node AND r.label < t.v),
 m AS (SELECT image_id, node, min(label) AS label FROM r GROUP BY ALL),
 ar AS (SELECT m.image_id, label, sum(hi - lo + 1)::BIGINT AS area FROM m JOIN l ON l.image_id = m.image_id AND l.run = m.node GROUP BY ALL)"""
ORACLE_SQL = {
    "srgb": f"""{_P}, l AS (SELECT *, CASE WHEN gray / 255.0 <= 0.04045 THEN gray / 255.0 / 12.92 ELSE ((gray / 255.0 + 0.055) / 1.055) ** 2.4 END AS v FROM pixels)
 SELECT image_id, y, x, round(v::DOUBLE, 6) AS linear, floor(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE v ** (1 / 2.4) * 1.055 - 0.055 END * 255 + 0.5)::BIGINT AS back FROM l""",
    "auto_levels": f"{_LEVELS} SELECT * FROM levels",
    "stretch_levels": f"{_LEVELS} SELECT image_id, y, x, floor((least(greatest(gray, black), white) - black) / (white - black) * 255.0 + 0.5)::BIGINT AS gray, a FROM pixels JOIN levels USING (image_id)",
    "otsu_threshold": f"{_OTSU} SELECT * FROM o",
    "binary_image": f"{_OTSU} SELECT image_id, y, x, (gray <= threshold)::INT AS ink FROM pixels JOIN o USING (image_id)",
    "pixel_power": f"{_POWER} SELECT * FROM pw",
    "bayer_dither": f"""{_P} SELECT image_id, y, x, (gray <= [{', '.join(str(v) for r in BAYER for v in r)}][(y // 2 % 4 * 4 + x // 2 % 4 + 1)::INT] * 255.0 / 16)::INT AS ink FROM pixels""",
    "halftone_dither": f"""{_P} SELECT image_id, y, x, ((cos(2 * pi() * ((x + 0.5) / 10.0 * cos(radians(30)) + (y + 0.5) / 8.0 * sin(radians(30))) / 0.7) + cos(2 * pi() * ((y + 0.5) / 8.0 * cos(radians(30)) - (x + 0.5) / 10.0 * sin(radians(30))) / 0.7)) / 4 + 0.5
 > list_extract([{', '.join(f'{v!r}::DOUBLE' for v in spot_levels())}], gray + 1))::INT AS ink FROM pixels""",
    "newsprint_dither": f"{_P} SELECT image_id, y, x, (gray < 255.0 * (1 - ([{', '.join(map(str, newsprint_ranks()))}][(y // 3 % 8 * 8 + x // 2 % 8 + 1)::INT] + 0.5) / 64))::INT AS ink FROM pixels",
    "gray_from_rgba": f"""{_P}, c AS (SELECT image_id, y, x, (gray * 5 + x * 51) % 256 AS a, gray, unnest([1, 3, 7]) AS k FROM pixels),
 v AS (SELECT *, floor(least(greatest(floor((gray * k + y) % 256 * a / 255) / greatest(a / 255, 1e-6), 0), 255)) / 255 AS v FROM c),
 l AS (SELECT *, 1 - (1 - CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE ((v + 0.055) / 1.055) ** 2.4 END) * (a / 255) AS l FROM v),
 s AS (SELECT image_id, y, x, a, sum(l * CASE k WHEN 1 THEN 0.2989 WHEN 3 THEN 0.587 ELSE 0.114 END) AS l FROM l GROUP BY ALL)
 SELECT image_id, y, x, floor(CASE WHEN l <= 0.0031308 THEN l * 12.92 ELSE l ** (1 / 2.4) * 1.055 - 0.055 END * 255 + 0.5)::BIGINT AS gray, round(a / 255, 6)::DOUBLE AS alpha FROM s""",
    "transparent_bright": f"{_P} SELECT image_id, y, x, CASE WHEN (gray * 256) >> 8 >= 160 THEN 0 ELSE a END AS a FROM pixels",
    "content_box": f"{_P} SELECT image_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS n FROM pixels WHERE gray <= 90 AND a > 0 GROUP BY image_id",
    "sample_runs": f"{_RUNS} SELECT image_id, y, lo, hi, total FROM runs",
    "trim_runs": f"""{_POWER}, t AS (SELECT image_id, y, x, CASE WHEN least(coalesce(lag(power) OVER w, 0), power, coalesce(lead(power) OVER w, 0)) = 0 THEN 0 ELSE power END AS p FROM pw WINDOW w AS (PARTITION BY image_id, y ORDER BY x))
 SELECT image_id, y, string_agg(p, ',' ORDER BY x) AS samples FROM t GROUP BY image_id, y""",
    "zero_runs": f"{_RUNS}, n AS (SELECT *, lead(lo) OVER (PARTITION BY image_id, y ORDER BY lo) AS nx FROM runs) SELECT image_id, y, hi AS lo, nx AS hi FROM n WHERE nx IS NOT NULL",
    "long_runs": f"""{_RUNS} SELECT pw.image_id, pw.y, string_agg(CASE WHEN hi - lo >= 3 THEN power ELSE 0 END, ',' ORDER BY x) AS samples FROM pw LEFT JOIN runs r ON r.image_id = pw.image_id AND r.y = pw.y AND x >= lo AND x < hi GROUP BY pw.image_id, pw.y""",
    "downsample_rows": f"""{_POWER}, r AS (SELECT image_id, y, list(power ORDER BY x) AS s FROM pw GROUP BY image_id, y)
 SELECT image_id, y, array_to_string([s[(floor(i * ((len(s) - 1) / 16.0)) + 1)::INT] FOR i IN range(17)], ',') AS samples FROM r""",
    "scan_lines": f"""{_RUNS}, s AS (SELECT image_id, y, min(lo) AS lo, max(hi) AS hi, sum(total)::BIGINT AS total FROM runs GROUP BY image_id, y)
 SELECT image_id, y, part, CASE part WHEN 0 THEN 'MOVE_TO' ELSE 'SCAN_LINE' END AS cmd, round(CASE WHEN (y % 2 = 1) = (part = 0) THEN hi ELSE lo END * 0.1::DOUBLE, 6) AS x, round(y * 0.1::DOUBLE, 6) AS line_y,
 CASE part WHEN 1 THEN total END AS total FROM s, (VALUES (0), (1)) AS t(part)""",
    "depth_passes": f"""{_P}, l AS (SELECT *, ceil((1 - gray / 255.0) * 4)::INT AS level FROM pixels), d AS (SELECT *, unnest(range(1, level + 1))::INT AS pass FROM l WHERE level > 0)
 SELECT image_id, pass, y, count(*) AS n, min(x) AS lo, max(x) AS hi FROM d GROUP BY ALL""",
    "image_components": f"{_COMPONENTS} SELECT * FROM ar",
    "fluence_map": f"{_POWER} SELECT image_id, y // 4 AS cy, (x // 4)::BIGINT AS cx, round(max(power) / 255.0 * 12.5, 6)::DOUBLE AS fluence FROM pw GROUP BY ALL",
    "burn_surface": f"""{_POWER}, pl AS (SELECT DISTINCT image_id, image_id % 3 AS stock_id, image_id % 2 + 1 AS k, image_id * 5 AS tx, image_id * 3 AS ty FROM pixels)
 SELECT stock_id, x * k + i.i + tx AS px, y * k + j.j + ty AS py, max(power) AS power FROM pw JOIN pl USING (image_id), range(2) i(i), range(2) j(j) WHERE power > 0 AND i.i < k AND j.j < k GROUP BY ALL""",
    "edge_ramp": f"""{_P}, g AS MATERIALIZED (SELECT image_id, y, x, gray <= 150 AS ink FROM pixels), sz AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM g GROUP BY image_id),
 nb AS (SELECT a.image_id, a.y, a.x, abs(dx) * 0.1::DOUBLE AS px, abs(dy) * 0.125::DOUBLE AS py FROM g a JOIN sz ON sz.image_id = a.image_id, range(-7, 8) i(dx), range(-6, 7) j(dy)
  WHERE a.ink AND a.x + dx BETWEEN -1 AND w AND a.y + dy BETWEEN -1 AND h AND NOT EXISTS (SELECT 1 FROM g b WHERE b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.ink)),
 di AS (SELECT *, sqrt(px * px + py * py) AS d, sqrt(px * px + py * py) * (1 - least(CASE WHEN px = 0 THEN 1 ELSE 0.05 / px END, CASE WHEN py = 0 THEN 1 ELSE 0.0625 / py END, 1)) AS e FROM nb),
 ed AS (SELECT image_id, y, x, arg_min(e, (round(d, 9), e)) AS e FROM di GROUP BY ALL)
 SELECT g.image_id, g.y, g.x, round(least(coalesce(e, 9) / 0.45, 1), 6)::DOUBLE AS ramp FROM g LEFT JOIN ed ON ed.image_id = g.image_id AND ed.y = g.y AND ed.x = g.x WHERE ink""",
}
