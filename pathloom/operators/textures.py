"""Scanline commands on pixel grids, and rasters placed on stock by any affine map."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.windows import before
from pathloom.operators.commands import by_job, is_, rounded
from pathloom.operators.raster import _POWER, power, scan_rows
from pathloom.operators.sweeps import _SWEEP, _sweeps, from_rows
from pathloom.operators.transforms import fluence_at
from pathloom.sources.derive import cte, table


def to_texture(df: DataFrame, width: int, height: int, per_mm: tuple[float, float], origin: tuple[float, float] = (0.0, 0.0), radius: int = 0) -> DataFrame:
    """Pixels that the scanlines of a job burn: ``job_id, px, py, power``, the largest power of each; row 0 is the top.

    ``df`` has ``samples``; only MOVE_TO and SCAN_LINE say where the head is. A level line covers the pixels whose middle a
    sample sweeps, widened by ``radius``; others go in whole steps from sample to sample, each step a square of
    2 ``radius`` + 1 pixels. Steps are closed formulas, so a line is two explodes, and maxima are combined before the shuffle.
    """
    (ox, oy), (kx, ky), r = origin, per_mm, max(0, radius)
    rows = df.filter(is_("MOVE_TO", "SCAN_LINE"))
    w = before(by_job())
    rows = rows.withColumns({f"p{c}": F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)) for c in "xy"}).filter(is_("SCAN_LINE") & (F.size("samples") > 0))
    n = F.size("samples")
    at = rows.select("job_id", "samples", ((F.col("px") - ox) * kx).alias("sx"), (height - (F.col("py") - oy) * ky).alias("sy"), (((F.col("x") - ox) * kx - (F.col("px") - ox) * kx) / n).alias("dx"), ((height - (F.col("y") - oy) * ky - (height - (F.col("py") - oy) * ky)) / n).alias("dy"))
    burnt = at.select("*", F.posexplode("samples").alias("i", "v")).filter("v > 0").drop("samples")
    level = burnt.filter("dy = 0 and dx <> 0").withColumn("iy", F.round("sy").cast("long")).filter(F.col("iy").between(0, height - 1))
    a, b = F.col("sx") + F.col("i") * F.col("dx"), F.col("sx") + (F.col("i") + 1) * F.col("dx")
    lo, hi = F.ceil(F.least(a, b) - (r + 0.5)), F.floor(F.greatest(a, b) + (r - 0.5))
    level = level.select("job_id", "v", "iy", F.greatest(lo, F.lit(0)).alias("x0"), F.least(hi, F.lit(width - 1)).alias("x1")).filter("x0 <= x1")
    level = level.select("job_id", "v", "iy", F.explode(F.sequence("x0", "x1")).alias("px"))
    level = level.select("job_id", "v", "px", F.explode(F.sequence(F.greatest(F.col("iy") - r, F.lit(0).cast("long")), F.least(F.col("iy") + r, F.lit(height - 1).cast("long")))).alias("py"))
    end = lambda s, d, k: F.round(F.col(s) + (F.col("i") + k) * F.col(d)).cast("long")
    slant = burnt.filter("dy <> 0").select("job_id", "v", end("sx", "dx", 0).alias("x0"), end("sy", "dy", 0).alias("y0"), end("sx", "dx", 1).alias("x1"), end("sy", "dy", 1).alias("y1"))
    wide, tall = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    slant = slant.withColumns({"a": wide, "b": tall, "n": F.greatest(wide, tall)}).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    step = lambda m: F.when(F.col("n") == 0, F.lit(0)).otherwise(F.floor((2 * F.col("k") * F.col(m) + F.col("n")) / F.nullif(2 * F.col("n"), F.lit(0))))
    slant = slant.select("job_id", "v", (F.col("x0") + F.signum(F.col("x1") - F.col("x0")).cast("long") * step("a")).alias("cx"), (F.col("y0") + F.signum(F.col("y1") - F.col("y0")).cast("long") * step("b")).alias("cy"))
    span = lambda c, most: F.sequence(F.greatest(F.col(c) - r, F.lit(0).cast("long")), F.least(F.col(c) + r, F.lit(most - 1).cast("long")))
    slant = slant.filter(F.col("cx").between(-r, width - 1 + r) & F.col("cy").between(-r, height - 1 + r))
    slant = slant.select("job_id", "v", "cy", F.explode(span("cx", width)).alias("px")).select("job_id", "v", "px", F.explode(span("cy", height)).alias("py"))
    return level.unionByName(slant).groupBy("job_id", "px", "py").agg(F.max("v").alias("power"))


def fluence_map(df: DataFrame, size_mm: tuple[float, float], per_mm: float, watts: float, spot: tuple[float, float], speed: float) -> DataFrame:
    """Energy per area that the scanlines of a job leave: ``job_id, px, py, fluence``, row 0 at the bottom; unburnt pixels are left out."""
    width, height = (max(1, math.ceil(v * per_mm)) for v in size_mm)
    burnt = to_texture(df, width, height, (per_mm, per_mm))
    return burnt.select("job_id", "px", (height - 1 - F.col("py")).alias("py"), fluence_at(F.col("power") / 255.0, watts, *spot, speed).alias("fluence"))


def depth_commands(pixels: DataFrame, passes: int, pitch: float, step: float) -> DataFrame:
    """Gray levels as passes of full power, one below the other: ``job_id, pass, seq, cmd, x, y, z, samples, section_type``.

    A pixel burns in as many passes as its darkness asks for; pass p lies ``step`` times p - 1 lower. Each pass is a raster
    section of its own, its rows from content to content; every image has all passes, those without ink only their markers.
    """
    level = F.ceil((F.lit(1.0) - F.col("gray") / 255.0) * passes)
    deep = pixels.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    burnt = deep.select((F.col("image_id") * passes + F.col("pass")).alias("image_id"), "y", "x", F.when(level > F.col("pass"), 255).otherwise(0).alias("power"))
    rows = from_rows(scan_rows(burnt), pitch)
    number = F.pmod(F.col("job_id"), F.lit(passes))
    return rows.select(F.floor(F.col("job_id") / passes).alias("job_id"), (number + 1).cast("int").alias("pass"), "seq", "cmd", "x", "y", (F.col("z") - number * step).alias("z"), "samples", "section_type")


def placed_surface(rasters: DataFrame, grids: DataFrame, placements: DataFrame, stocks: DataFrame) -> DataFrame:
    """Largest value of all rasters on each cell of their stock: ``stock_id, cx, cy, value``, cells under none are left out.

    ``rasters`` are ``source_key, px, py, v`` on grids ``source_key, ox, oy, kx, ky, w, h``; ``placements`` are matrices (a b tx;
    c d ty) ``stock_id, source_key, ..``; ``stocks`` are grids ``stock_id, gx, gy, k, gw, gh``. A cell takes the sample under its
    middle. Only cells whose middle lies in the placed rectangle are made: per row of cells, the span that both pairs of
    its sides leave. Placements that cannot be inverted are left out. Cells meet samples in an equi-join, and maxima are
    combined before the shuffle.
    """
    det = F.col("a") * F.col("d") - F.col("b") * F.col("c")
    p = placements.filter(F.abs(det) > 1e-12).join(grids, "source_key").join(stocks, "stock_id").withColumn("__id", F.monotonically_increasing_id())
    inv = {"ia": F.col("d") / det, "ib": -F.col("b") / det, "ic": -F.col("c") / det, "id": F.col("a") / det}
    p = p.withColumns(inv).withColumns({"lw": F.col("w") / F.col("kx"), "lh": F.col("h") / F.col("ky")})
    ys = [F.col("c") * x + F.col("d") * y + F.col("ty") for x in (F.col("ox"), F.col("ox") + F.col("lw")) for y in (F.col("oy"), F.col("oy") + F.col("lh"))]
    row = lambda v: F.floor((v - F.col("gy")) * F.col("k"))
    lines = p.withColumn("cy", F.explode(F.filter(F.sequence(F.greatest(row(F.least(*ys)), F.lit(0).cast("long")), F.greatest(F.least(row(F.greatest(*ys)), F.col("gh").cast("long") - 1), F.lit(0).cast("long"))), lambda v: v < F.col("gh"))))
    y = F.col("gy") + (F.col("cy") + 0.5) / F.col("k")
    lines = lines.withColumns({"wy": y, "fx": F.col("ib") * (y - F.col("ty")) - F.col("ia") * F.col("tx"), "fy": F.col("id") * (y - F.col("ty")) - F.col("ic") * F.col("tx")})

    def side(slope: str, base: str, lo: str, size: str):  # where lo <= slope * x + base < lo + size
        s, edge = F.col(slope), [(F.col(lo) - F.col(base)), (F.col(lo) + F.col(size) - F.col(base))]
        flat = F.abs(s) < 1e-12
        inside = (edge[0] <= 0) & (edge[1] > 0)
        safe = F.nullif(s, F.lit(0.0))
        ends = [e / safe for e in edge]
        return F.when(flat, F.when(inside, F.lit(-1e18)).otherwise(F.lit(1e18))).otherwise(F.least(*ends)), F.when(flat, F.when(inside, F.lit(1e18)).otherwise(F.lit(-1e18))).otherwise(F.greatest(*ends))

    (a0, a1), (b0, b1) = side("ia", "fx", "ox", "lw"), side("ic", "fy", "oy", "lh")
    column = lambda x: (x - F.col("gx")) * F.col("k") - 0.5
    x0, x1 = F.greatest(F.ceil(column(F.greatest(a0, b0)) - 1e-6), F.lit(0).cast("long")), F.least(F.floor(column(F.least(a1, b1)) + 1e-6), F.col("gw").cast("long") - 1)
    cells = lines.withColumns({"__x0": x0, "__x1": x1}).filter("__x0 <= __x1").withColumn("cx", F.explode(F.sequence("__x0", "__x1")))
    wx = F.col("gx") + (F.col("cx") + 0.5) / F.col("k")
    local = {"px": F.floor((F.col("ia") * wx + F.col("fx") - F.col("ox")) * F.col("kx")), "py": F.floor((F.col("ic") * wx + F.col("fy") - F.col("oy")) * F.col("ky"))}
    probes = cells.withColumns(local).select("stock_id", "cx", "cy", "source_key", "px", "py")
    return probes.join(rasters, ["source_key", "px", "py"]).groupBy("stock_id", "cx", "cy").agg(F.max("v").alias("value"))


# Queries and their SQL ----------------------------------------------------------------------------------------------


def _slanted(p: DataFrame) -> DataFrame:
    """Sweeps of images, those of odd images on a slope."""
    return _sweeps(p).withColumn("y", F.when(F.col("job_id") % 2 == 1, F.col("y") + F.col("x") * 0.3717).otherwise(F.col("y")))


def _surface(spark, sf_dir: str) -> DataFrame:
    rows = scan_rows(power(table(spark, sf_dir, "pixels"), 0.1, 0.9, 16))
    rasters = rows.select(F.col("image_id").alias("source_key"), F.col("y").cast("long").alias("py"), F.posexplode("samples").alias("px", "v")).withColumn("px", F.col("px").cast("long"))
    k = F.col("source_key")
    size = rasters.groupBy("source_key").agg((F.max("px") + 1).alias("w"), (F.max("py") + 1).alias("h"))
    grids = size.select("source_key", F.lit(0.5).alias("ox"), F.lit(-0.25).alias("oy"), F.lit(8.0).alias("kx"), F.lit(4.0).alias("ky"), "w", "h")
    turn = {"a": F.cos(k * 0.7) * (1 + k % 3 * 0.5), "b": -F.sin(k * 0.7) * (1 + k % 2 * 0.25), "c": F.sin(k * 0.7) * (1 + k % 3 * 0.5), "d": F.cos(k * 0.7) * (1 + k % 2 * 0.25)}
    placements = size.select((k % 3).alias("stock_id"), "source_key", *[v.alias(n) for n, v in turn.items()], (k % 7 * 2.125 + 3.0).alias("tx"), (k % 5 * 1.5 + 2.0).alias("ty"))
    stocks = placements.select("stock_id").distinct().select("stock_id", F.lit(-1.0).alias("gx"), F.lit(-2.0).alias("gy"), F.lit(5.0).alias("k"), F.lit(120).alias("gw"), F.lit(90).alias("gh"))
    return rounded(placed_surface(rasters, grids, placements, stocks))


QUERIES = {
    "commands_to_texture": lambda spark, sf_dir: to_texture(_slanted(table(spark, sf_dir, "pixels")), 60, 300, (8.0, 8.0), (-0.5, -0.25), 1),
    "fluence_maps": lambda spark, sf_dir: rounded(fluence_map(_sweeps(table(spark, sf_dir, "pixels")), (6.5, 25.0), 6.0, 40.0, (0.1, 0.2), 50.0)),
    "depth_commands": lambda spark, sf_dir: rounded(depth_commands(table(spark, sf_dir, "pixels"), 4, 0.1, 0.25).withColumn("samples", F.array_join("samples", ","))),
    "placed_surface": _surface,
}
_LINES = """{sweep}, sl AS (SELECT job_id, seq, cmd, x, {y} AS y, samples FROM sw), ab AS (SELECT a.job_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, b.samples, len(b.samples) AS n FROM sl a JOIN sl b ON b.job_id = a.job_id AND b.seq = a.seq + 1 WHERE b.cmd = 'SCAN_LINE'),
 li AS (SELECT job_id, samples, (ax - {ox}) * {k} AS sx, {h} - (ay - {oy}) * {k} AS sy, ((bx - {ox}) * {k} - (ax - {ox}) * {k}) / n AS dx, ({h} - (by_ - {oy}) * {k} - ({h} - (ay - {oy}) * {k})) / n AS dy FROM ab),
 sa AS (SELECT job_id, sx, sy, dx, dy, unnest(samples) AS v, generate_subscripts(samples, 1) - 1 AS i FROM li),
 le AS (SELECT job_id, v, round(sy)::BIGINT AS iy, greatest(ceil(least(sx + i * dx, sx + (i + 1) * dx) - ({r} + 0.5)), 0)::BIGINT AS x0, least(floor(greatest(sx + i * dx, sx + (i + 1) * dx) + ({r} - 0.5)), {w} - 1)::BIGINT AS x1 FROM sa WHERE v > 0 AND dy = 0 AND dx <> 0),
 lx AS (SELECT job_id, v, iy, unnest(range(x0, x1 + 1)) AS px FROM le WHERE x0 <= x1 AND iy BETWEEN 0 AND {h} - 1),
 ly AS (SELECT job_id, v, px, unnest(range(greatest(iy - {r}, 0), least(iy + {r}, {h} - 1) + 1)) AS py FROM lx),
 st AS (SELECT job_id, v, round(sx + i * dx)::BIGINT AS x0, round(sy + i * dy)::BIGINT AS y0, round(sx + (i + 1) * dx)::BIGINT AS x1, round(sy + (i + 1) * dy)::BIGINT AS y1 FROM sa WHERE v > 0 AND dy <> 0),
 sn AS (SELECT *, abs(x1 - x0) AS a, abs(y1 - y0) AS b, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM st), sk AS (SELECT *, unnest(range(n + 1)) AS k FROM sn),
 sc AS (SELECT job_id, v, x0 + sign(x1 - x0)::BIGINT * CASE WHEN n = 0 THEN 0 ELSE (2 * k * a + n) // (2 * n) END AS cx, y0 + sign(y1 - y0)::BIGINT * CASE WHEN n = 0 THEN 0 ELSE (2 * k * b + n) // (2 * n) END AS cy FROM sk),
 sx_ AS (SELECT job_id, v, cx + ix AS px, cy + iy AS py FROM sc, range(-{r}, {r} + 1) p(ix), range(-{r}, {r} + 1) q(iy)),
 te AS (SELECT job_id, px, py, max(v) AS power FROM (SELECT job_id, px, py, v FROM ly UNION ALL SELECT job_id, px, py, v FROM sx_ WHERE px BETWEEN 0 AND {w} - 1 AND py BETWEEN 0 AND {h} - 1) GROUP BY ALL)"""
_DEPTH = f"""{cte('pixels')}, pw AS (SELECT image_id * 4 + p AS image_id, y, x, CASE WHEN ceil((1 - gray / 255.0::DOUBLE) * 4) > p THEN 255 ELSE 0 END AS power FROM pixels, range(4) r(p))""" + _SWEEP.removeprefix(_POWER)
ORACLE_SQL = {
    "depth_commands": f"""{_DEPTH} SELECT (job_id - job_id % 4) // 4 AS job_id, (job_id % 4 + 1)::INT AS pass, seq, cmd, round(x, 6) AS x, round(y, 6) AS y, CASE WHEN cmd NOT LIKE 'OPS%' THEN round(0 - job_id % 4 * 0.25::DOUBLE, 6) END AS z,
 array_to_string(samples, ',') AS samples, CASE WHEN cmd LIKE 'OPS%' THEN 'RASTER_FILL' END AS section_type FROM sw""",
    "commands_to_texture": _LINES.format(sweep=_SWEEP, y="CASE WHEN job_id % 2 = 1 THEN y + x * 0.3717::DOUBLE ELSE y END", ox="-0.5::DOUBLE", oy="-0.25::DOUBLE", k=8, h=300, w=60, r=1) + " SELECT * FROM te",
    "fluence_maps": _LINES.format(sweep=_SWEEP, y="y", ox="0", oy="0", k=6, h=150, w=39, r=0) + " SELECT job_id, px, 149 - py AS py, round(power / 255.0::DOUBLE * 40 * (0.2 / 50) / (0.1 * 0.2 / 100), 6)::DOUBLE AS fluence FROM te",
    "placed_surface": f"""{_POWER}, gr AS (SELECT image_id AS k, max(x) + 1 AS w, max(y) + 1 AS h FROM pw GROUP BY image_id),
 pl AS (SELECT k, w, h, k % 3 AS stock_id, cos(k * 0.7) * (1 + k % 3 * 0.5) AS a, -sin(k * 0.7) * (1 + k % 2 * 0.25) AS b, sin(k * 0.7) * (1 + k % 3 * 0.5) AS c, cos(k * 0.7) * (1 + k % 2 * 0.25) AS d, (k % 7 * 2.125 + 3)::DOUBLE AS tx, (k % 5 * 1.5 + 2)::DOUBLE AS ty FROM gr),
 ce AS (SELECT pl.*, cx, cy, -1 + (cx + 0.5::DOUBLE) / 5 - tx AS dx, -2 + (cy + 0.5::DOUBLE) / 5 - ty AS dy, a * d - b * c AS det FROM pl, range(120) x(cx), range(90) y(cy)),
 lo AS (SELECT *, floor(((d * dx - b * dy) / det - 0.5) * 8) AS px, floor(((a * dy - c * dx) / det + 0.25) * 4) AS py FROM ce)
 SELECT stock_id, cx, cy, max(power)::DOUBLE AS value FROM lo JOIN pw ON pw.image_id = lo.k AND pw.x = lo.px AND pw.y = lo.py GROUP BY ALL""",
}
