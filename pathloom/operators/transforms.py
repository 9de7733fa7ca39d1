"""Commands to commands: matrices, curves to chords, passes, links, corrections, user-defined transformers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geometry import TAU, bezier_at, bezier_chords, bezier_length, bezier_steps, hypot
from pathloom.functions.windows import before, ffill, ordered, so_far
from pathloom.operators import commands as ops
from pathloom.operators.commands import by_job, is_, is_moving, rounded
from pathloom.operators.rings import edges
from pathloom.sources.derive import cte, table

BASE = ("job_id", "seq", "cmd", "x", "y", "z", "ci", "cj", "cw", "val", "sval", "section_type")


def linearized(df: DataFrame, resolution: float, tolerance: float = 0.01) -> DataFrame:
    """Arcs as chords of at most ``resolution``, two at least; radius and height change evenly on the way. Curves, where the
    table has control points, as chords of even steps that stay within ``tolerance``.

    New rows keep their command's ``seq`` and are told apart by ``part``; ``renumbered`` gives them a dense order.
    """
    rows = ops.with_previous(df).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("px", "py", "pz")})
    cx, cy = F.col("px") + F.col("ci"), F.col("py") + F.col("cj")
    a0, a1 = F.atan2(-F.col("cj"), -F.col("ci")), F.atan2(F.col("y") - cy, F.col("x") - cx)
    gap = F.when(F.col("cw"), a0 - a1).otherwise(a1 - a0)
    gap = F.when(gap <= -math.pi, gap + TAU).when(gap > math.pi, gap - TAU).otherwise(gap)
    sweep = F.when(F.abs(gap) < 1e-9, F.lit(TAU)).when(gap < 1e-9, gap + TAU).otherwise(gap)
    r0, r1 = hypot(F.col("ci"), F.col("cj")), hypot(F.col("x") - cx, F.col("y") - cy)
    rows = rows.withColumns({"__cx": cx, "__cy": cy, "__a0": a0, "__sweep": sweep, "__r0": r0, "__r1": r1})
    n = F.greatest(F.ceil(F.col("__sweep") * (F.col("__r0") + F.col("__r1")) / 2 / resolution), F.lit(2))
    parts = F.when(is_("ARC_TO") & (F.col("__r0") >= 1e-9), n)
    curves = {c: tuple(F.col(f"{p}{c}") for p in ("p", "c1", "c2", "")) for c in "xyz"} if ops.has_curves(df) else {}
    if curves:
        parts = parts.when(is_("BEZIER_TO"), bezier_chords(tolerance, *curves.values()))
    rows = rows.withColumn("__n", parts.otherwise(F.lit(1)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    t = F.col("part") / F.col("__n")
    angle = F.col("__a0") + F.when(F.col("cw"), -t * F.col("__sweep")).otherwise(t * F.col("__sweep"))
    radius = F.col("__r0") + t * (F.col("__r1") - F.col("__r0"))
    inner = F.col("part") < F.col("__n")
    arc = {"x": F.col("__cx") + radius * F.cos(angle), "y": F.col("__cy") + radius * F.sin(angle), "z": F.col("pz") + t * (F.col("z") - F.col("pz"))}
    on = {c: F.when(is_("BEZIER_TO"), bezier_at(*curves[c], t)).otherwise(arc[c]) if curves else arc[c] for c in "xyz"}
    gone = is_("ARC_TO", "BEZIER_TO") if curves else is_("ARC_TO")
    out = {
        **{c: F.when(inner, on[c]).otherwise(F.col(c)) for c in "xyz"}, "cmd": F.when(gone, "LINE_TO").otherwise(F.col("cmd")),
        "ci": F.lit(None).cast("double"), "cj": F.lit(None).cast("double"), "cw": F.lit(None).cast("boolean"),
    }
    return rows.withColumns(out).select(*BASE, "part")


def renumbered(df: DataFrame, *order: str) -> DataFrame:
    """A dense ``seq`` in the order of the given columns."""
    return df.withColumn("seq", (F.row_number().over(Window.partitionBy("job_id").orderBy(*order)) - 1).cast("long"))


def affine(df: DataFrame, a: float, b: float, c: float, d: float, tx: float, ty: float, resolution: float = 1.0) -> DataFrame:
    """Points under the matrix (a b tx; c d ty). Centre offsets turn with it and arcs change sides when it mirrors;
    where it stretches unevenly, arcs become chords first."""
    even = abs(math.hypot(a, c) - math.hypot(b, d)) < 1e-9 and abs(a * b + c * d) < 1e-9
    rows = df.select(*BASE) if even else renumbered(linearized(df, resolution), "seq", "part").select(*BASE)
    turn = lambda p, q: (F.col(p) * a + F.col(q) * b, F.col(p) * c + F.col(q) * d)
    (x, y), (ci, cj) = turn("x", "y"), turn("ci", "cj")
    return rows.withColumns({"x": x + tx, "y": y + ty, "ci": ci, "cj": cj, "cw": ~F.col("cw") if a * d - b * c < 0 else F.col("cw")})


def scaled(df: DataFrame, sx: float, sy: float, about: tuple[float, float] = (0.0, 0.0), resolution: float = 1.0) -> DataFrame:
    """Points scaled about a point; uneven scales make chords of arcs."""
    return affine(df, sx, 0.0, 0.0, sy, about[0] * (1 - sx), about[1] * (1 - sy), resolution)


def rotated(df: DataFrame, degrees: float, about: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Points turned about a point, counter-clockwise."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return affine(df, c, -s, s, c, about[0] - c * about[0] + s * about[1], about[1] - s * about[0] - c * about[1])


def cap_power(df: DataFrame, most: float) -> DataFrame:
    return df.withColumn("val", F.when(is_("SET_POWER"), F.least("val", F.lit(most))).otherwise(F.col("val")))


def multipass(df: DataFrame, passes: int, step: float) -> DataFrame:
    """The job again ``passes`` times, each pass lower by ``step``."""
    rows = df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("z", F.col("z") - F.col("pass") * abs(step))
    return renumbered(rows, "pass", "seq")


def flipped(df: DataFrame) -> DataFrame:
    """The job backwards: a travel to the last end, then each moving command to the end before it; other rows keep their
    place between the moves, in reverse order. Arcs turn round, and so do samples and control points, where the table has them.
    The axes of ``extra_axes`` belong to a move's end, so they go to the move that ends there now."""
    more = [c for c in ("samples", *ops.CONTROLS, "extra_axes") if c in df.columns]
    keep = ["job_id", "seq", "cmd", "x", "y", "z", "ci", "cj", "cw", "val", "sval", "section_type", *more]
    rows = ops.with_previous(df)
    if "extra_axes" in more:
        rows = rows.withColumn("__axes", F.last(F.when(is_moving(), F.struct("extra_axes")), ignorenulls=True).over(before(by_job()))["extra_axes"])
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq"))).cast("long"))
    last = F.col("seq") == F.min(F.when(is_moving(), F.col("seq"))).over(Window.partitionBy("job_id"))
    moved = rows.filter(is_moving()).filter("px is not null").select("job_id", "seq", "cmd", *[(F.col("px") + F.col("ci") - F.col("x")).alias("ci2"), (F.col("py") + F.col("cj") - F.col("y")).alias("cj2")], "px", "py", "pz", "cw", *keep[9:], *(["__axes"] if "extra_axes" in more else []))
    swapped = {"samples": F.reverse("samples") if "samples" in more else None, **{c: F.col(f"c{3 - int(c[1])}{c[2]}") for c in ops.CONTROLS}, "extra_axes": F.col("__axes")}
    moved = moved.select("job_id", "seq", "cmd", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), F.col("ci2").alias("ci"), F.col("cj2").alias("cj"), (~F.col("cw")).alias("cw"), *[swapped[c].alias(c) if c in more else F.col(c) for c in keep[9:]])
    null = {k: F.lit(None).cast(df.schema[k].dataType) for k in ("ci", "cj", "cw", "val", "sval", "section_type", *[c for c in more if c != "extra_axes"])}
    head = rows.withColumn("__last", last).filter("__last").withColumns({"seq": F.lit(0).cast("long"), "cmd": F.lit("MOVE_TO"), **null})
    rest = rows.filter(~is_moving())
    return head.select(*keep).unionByName(moved.select(*keep)).unionByName(rest.select(*keep))


def linked(df: DataFrame, safe_z: float) -> DataFrame:
    """Subpaths as passes that are linked by a lift, a travel and a plunge, where these move at all; all rows and columns stay."""
    rows = ops.with_subpaths(df)
    moves = rows.filter(is_moving())
    passes = moves.groupBy("job_id", "subpath").agg(F.min_by(F.struct("x", "y", "z"), "seq").alias("entry"), F.max_by(F.struct("x", "y", "z"), "seq").alias("exit"), F.min("seq").alias("at"))
    w = Window.partitionBy("job_id").orderBy("subpath")
    gaps = passes.withColumn("from", F.lag("exit").over(w)).filter("from is not null")
    row = lambda i, x, y, z: F.struct(F.lit(i).alias("step"), x.alias("x"), y.alias("y"), z.alias("z"))
    away = hypot(F.col("entry.x") - F.col("from.x"), F.col("entry.y") - F.col("from.y")) > 1e-12
    links = F.array_compact(F.array(
        row(0, F.col("from.x"), F.col("from.y"), F.lit(safe_z)), F.when(away, row(1, F.col("entry.x"), F.col("entry.y"), F.lit(safe_z))),
        F.when(F.abs(F.col("entry.z") - safe_z) > 1e-12, row(2, F.col("entry.x"), F.col("entry.y"), F.col("entry.z"))),
    ))
    added = gaps.select("job_id", F.inline(links), F.lit("MOVE_TO").alias("cmd"), F.col("at").alias("seq"))
    both = df.withColumn("step", F.lit(9)).unionByName(added, allowMissingColumns=True)
    return renumbered(both, "seq", "step").select(*df.columns)


def concatenated(*parts: DataFrame) -> DataFrame:
    """Containers one after the other."""
    rows = None
    for i, p in enumerate(parts):
        ranked = p.withColumn("__part", F.lit(i))
        rows = ranked if rows is None else rows.unionByName(ranked)
    return renumbered(rows, "__part", "seq").drop("__part")


def corrected(df: DataFrame, heights: DataFrame, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int) -> DataFrame:
    """Heights of a grid ``(i, j, h)`` added to Z, between grid points bilinear, beyond the grid those of its rim."""
    fx = F.least(F.greatest((F.col("x") - x0) / dx, F.lit(0.0)), F.lit(float(nx - 1)))
    fy = F.least(F.greatest((F.col("y") - y0) / dy, F.lit(0.0)), F.lit(float(ny - 1)))
    rows = df.filter(is_moving()).withColumns({"fx": fx, "fy": fy, "i": F.floor(fx), "j": F.floor(fy)})
    at = lambda name, di, dj: heights.select(F.col("i").alias(f"{name}i"), F.col("j").alias(f"{name}j"), F.col("h").alias(name))
    for name, di, dj in (("h00", 0, 0), ("h10", 1, 0), ("h01", 0, 1), ("h11", 1, 1)):
        on = (F.least(F.col("i") + di, F.lit(nx - 1)) == F.col(f"{name}i")) & (F.least(F.col("j") + dj, F.lit(ny - 1)) == F.col(f"{name}j"))
        rows = rows.join(at(name, di, dj), on)
    tx, ty = F.col("fx") - F.col("i"), F.col("fy") - F.col("j")
    low, high = F.col("h00") * (F.lit(1.0) - tx) + F.col("h10") * tx, F.col("h01") * (F.lit(1.0) - tx) + F.col("h11") * tx
    return rows.select("job_id", "seq", "x", "y", (F.col("z") + low * (F.lit(1.0) - ty) + high * ty).alias("z"))


def grid_split(df: DataFrame, x0: float, y0: float, dx: float, dy: float, nx: int, ny: int) -> DataFrame:
    """Straight cuts divided where they cross grid lines: a row for each piece's end."""
    rows = ops.with_previous(df).filter(is_("LINE_TO") & F.col("px").isNotNull())
    def cuts(a, b, origin, step, n):  # noqa: E306
        lo, hi = F.least(a, b), F.greatest(a, b)
        first = F.greatest(F.ceil((lo - origin) / step), F.lit(0)).cast("int")
        last = F.least(F.floor((hi - origin) / step), F.lit(n - 1)).cast("int")
        line = F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda k: (k * step + origin - a) / F.nullif(b - a, F.lit(0.0)))
        return F.when(F.abs(b - a) < 1e-9, F.array().cast("array<double>")).otherwise(line)
    ts = F.array_union(cuts(F.col("px"), F.col("x"), x0, dx, nx), cuts(F.col("py"), F.col("y"), y0, dy, ny))
    ts = F.array_sort(F.array_distinct(F.transform(F.filter(ts, lambda t: (t > 1e-9) & (t < 1 - 1e-9)), lambda t: F.round(t, 9))))
    out = rows.withColumn("t", F.explode(F.concat(ts, F.array(F.lit(1.0)))))
    return out.select("job_id", "seq", "t", *[(F.col(f"p{c}") + F.col("t") * (F.col(c) - F.col(f"p{c}"))).alias(c) for c in "xyz"])


def on_cylinder(df: DataFrame, diameter: float) -> DataFrame:
    """Ends of moves wrapped around a cylinder along X: Y is the length along its surface."""
    angle = F.col("y") / (diameter / 2)
    return df.filter(is_moving()).select("job_id", "seq", "x", (F.sin(angle) * (diameter / 2)).alias("y"), (F.cos(angle) * (diameter / 2)).alias("z"))


def engagement(df: DataFrame, radius: float) -> DataFrame:
    """Engaged angle, area and depth of a disc whose centre is ``x - y`` from a boundary."""
    d = F.col("x") - F.col("y")
    angle = F.lit(2 * math.pi) - F.lit(2.0) * F.acos(F.least(F.greatest(d / radius, F.lit(-1.0)), F.lit(1.0)))
    return df.filter(is_moving()).select(
        "job_id", "seq", angle.alias("angle"), (F.lit(radius * radius / 2) * (angle - F.sin(angle))).alias("area"),
        F.when(F.abs(d) < radius, F.lit(radius) - F.abs(d)).otherwise(0.0).alias("depth"),
    )


def fluence_at(power: Column, watts: float, spot_x: float, spot_y: float, speed: float) -> Column:
    """Energy per square centimetre of a spot at a share of the power, kept between 0 and 1."""
    return F.least(F.greatest(power, F.lit(0.0)), F.lit(1.0)) * watts * (spot_y / speed) / (spot_x * spot_y / 100)


def fluence(df: DataFrame, watts: float, spot_x: float, spot_y: float, speed: float) -> DataFrame:
    """Energy per square centimetre at each cut's power."""
    return ops.with_state(df).filter(is_moving()).select("job_id", "seq", fluence_at(F.col("power"), watts, spot_x, spot_y, speed).alias("fluence"))


def headings(df: DataFrame, tolerance: float) -> DataFrame:
    """Unwrapped heading of each straight cut in degrees, and whether the tool lifts because it turned too far."""
    rows = ops.with_previous(df).filter(is_("LINE_TO") & F.col("px").isNotNull())
    raw = F.degrees(F.atan2(F.col("y") - F.col("py"), F.col("x") - F.col("px")))
    rows = rows.withColumn("raw", raw)
    step = F.col("raw") - F.lag("raw").over(by_job())
    step = F.coalesce(step - F.lit(360.0) * F.floor((step + 180.0) / 360.0), F.lit(0.0))
    rows = rows.withColumn("step", step).withColumn("first", F.first("raw").over(so_far(by_job())))
    return rows.select("job_id", "seq", (F.col("first") + F.sum("step").over(so_far(by_job()))).alias("heading"), (F.abs("step") > tolerance).alias("lift"))


def smoothed(df: DataFrame, amount: int) -> DataFrame:
    """Gaussian smoothing of each subpath's ends of moves; its first and last stay. The kernel is a small table."""
    sigma = amount / 100.0 * 5.0 + 0.1
    radius = math.ceil(sigma * 3.0)
    weights = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    kernel = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(k / sum(weights)).alias("k")) for o, k in zip(range(-radius, radius + 1), weights)])
    w = Window.partitionBy("job_id", "subpath").orderBy("seq")
    rows = ops.with_subpaths(df).filter(is_moving()).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("job_id", "subpath")))
    want = rows.select("job_id", "subpath", "seq", F.col("i").alias("me"), "n", F.inline(kernel))
    want = want.withColumn("i", F.least(F.greatest(F.col("me") + F.col("o"), F.lit(0)), F.col("n") - 1))
    sums = want.join(rows.select("job_id", "subpath", "i", "x", "y"), ["job_id", "subpath", "i"]).groupBy("job_id", "subpath", "seq", "me", "n").agg(F.sum(F.col("x") * F.col("k")).alias("sx"), F.sum(F.col("y") * F.col("k")).alias("sy"))
    inner = (F.col("me") > 0) & (F.col("me") < F.col("n") - 1)
    both = sums.join(rows.select("job_id", "seq", "x", "y"), ["job_id", "seq"])
    return both.select("job_id", "seq", F.when(inner, F.col("sx")).otherwise(F.col("x")).alias("x"), F.when(inner, F.col("sy")).otherwise(F.col("y")).alias("y"))


def bezier_measures(rings: DataFrame) -> DataFrame:
    """Length and midpoint of the cubic curve through each run of four vertices, as its control polygon."""
    names = ("x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3")
    p = edges(rings).withColumns({"qx": F.col("mx") + F.col("nx") - F.col("x"), "qy": F.col("my") + F.col("ny") - F.col("y")})
    p = p.select("ring_id", "seq", *[(F.col(c) / 40).alias(n) for c, n in zip(("x", "y", "nx", "ny", "mx", "my", "qx", "qy"), names)])
    args, half = [F.col(n) for n in names], F.lit(0.5)
    p = p.withColumn("steps", bezier_steps(*args))
    return p.select("ring_id", "seq", bezier_length(F.col("steps"), *args).alias("length"), bezier_at(*args[0::2], half).alias("bx"), bezier_at(*args[1::2], half).alias("by"))


@dataclass(frozen=True)
class Transformer:
    """A user's transformer: applied in the order of phases, and within a phase in the order given."""

    name: str
    phase: int
    apply: Callable[[DataFrame], DataFrame]


def apply_transformers(df: DataFrame, transformers: list[Transformer]) -> DataFrame:
    for t in sorted(transformers, key=lambda t: t.phase):
        df = df.transform(t.apply)
    return df


def apply_by_layer(df: DataFrame, by_layer: dict[str, list[Transformer]], others: list[Transformer]) -> DataFrame:
    """Different transformers for each layer; rows outside the named layers get ``others``."""
    rows = ops.with_layers(df)
    parts = [apply_transformers(rows.filter(F.col("layer") == k), t) for k, t in by_layer.items()]
    rest = apply_transformers(rows.filter(~F.coalesce(F.col("layer").isin(*by_layer), F.lit(False))), others)
    for p in parts:
        rest = rest.unionByName(p)
    return rest


def fitness(placed: DataFrame, parts: int) -> DataFrame:
    """Score of each candidate layout, lower is better: ``placed(candidate, sheet, area, min_x, .., rotation)``.

    Sheets are summed first, then candidates. Weights are fixed values of the score.
    """
    per = placed.groupBy("candidate", "sheet").agg(
        F.min("min_x").alias("x0"), F.min("min_y").alias("y0"), F.max("max_x").alias("x1"), F.max("max_y").alias("y1"), F.sum("min_x").alias("sx"), F.sum("min_y").alias("sy"),
        F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"), F.sum(F.least(F.col("rotation") % 90, F.lit(90.0) - F.col("rotation") % 90) / 90 * 0.05).alias("turn"),
    )
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    pull = F.col("x0") + F.col("y0") + F.col("sx") - F.col("x0") * F.col("n") + F.col("sy") - F.col("y0") * F.col("n")
    total = per.groupBy("candidate").agg(F.sum(w * h).alias("box"), F.sum(pull).alias("pull"), F.sum(w + h * 10.0).alias("spread"), F.sum("area").alias("area"), F.sum("turn").alias("turn"), F.sum("n").alias("n"))
    scale = F.greatest(F.sqrt("area"), F.lit(1.0))
    missing = F.greatest(F.lit(parts) - F.col("n"), F.lit(0)) * 1000.0
    return total.select("candidate", (F.col("box") / F.col("area") + F.col("pull") / scale * 0.001 + F.col("spread") / scale * 0.01 + F.col("turn") + missing).alias("fitness"))


# Queries and their SQL ----------------------------------------------------------------------------------------------


def _q(f, name="commands", digits=6):
    return lambda spark, sf_dir: rounded(f(table(spark, sf_dir, name)), digits=digits)


def _heights(df: DataFrame) -> DataFrame:
    i, j = F.col("id") % 11, F.floor(F.col("id") / 11)
    return df.sparkSession.range(121).select(i.alias("i"), j.alias("j"), ((i * 7 + j * 3) % 5 / 10.0).alias("h"))


def _candidates(spark, sf_dir: str) -> DataFrame:
    boxes = ops_boxes(table(spark, sf_dir, "rings"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_partkey").alias("ring_id"), (F.col("l_linenumber") % 2).alias("sheet"), (F.col("l_suppkey") % 4 * 30.0).alias("rotation"))
    return rounded(fitness(line.join(boxes, "ring_id"), 4))


def ops_boxes(rings: DataFrame) -> DataFrame:
    from pathloom.operators.rings import ring_measures

    return ring_measures(rings).select("ring_id", "area", "min_x", "min_y", "max_x", "max_y")


def _largest(rings: DataFrame) -> DataFrame:
    from pathloom.operators.rings import ring_measures

    w = Window.partitionBy("geom_id").orderBy(F.desc("area"), "ring_id")
    return ring_measures(rings).select("geom_id", "ring_id", "area", F.row_number().over(w).alias("rank")).filter("rank <= 3")


_UP = Transformer("up", 2, lambda d: d.withColumn("x", F.col("x") + 1.0))
_DOUBLE = Transformer("double", 1, lambda d: d.withColumn("x", F.col("x") * 2.0))

QUERIES = {
    "linearize_arcs": _q(lambda d: renumbered(linearized(d, 2.0), "seq", "part").select("job_id", "seq", "cmd", "x", "y", "z")),
    "affine_mirror": _q(lambda d: affine(d, -0.6, 0.8, 0.8, 0.6, 1.0, 2.0).select("job_id", "seq", "x", "y", "ci", "cj", "cw")),
    "rotate_about": _q(lambda d: rotated(d, 30.0, (5.0, -2.0)).select("job_id", "seq", "x", "y", "ci", "cj", "cw")),
    "scale_about": _q(lambda d: scaled(d, 1.5, 1.5, (10.0, 20.0)).select("job_id", "seq", "x", "y", "ci", "cj", "cw")),
    "affine_stretch": _q(lambda d: affine(d, 2.0, 0.0, 0.0, 1.0, 0.0, 0.0, 2.0).select("job_id", "seq", "cmd", "x", "y")),
    "cap_power": _q(lambda d: cap_power(d, 0.6).select("job_id", "seq", "val")),
    "multipass": _q(lambda d: multipass(d, 3, 0.5).select("job_id", "seq", "cmd", "z")),
    "flip_paths": _q(flipped),
    "link_passes": _q(lambda d: linked(d, 10.0)),
    "concatenate": _q(lambda d: concatenated(d.select("job_id", "seq", "cmd"), d.filter("seq % 2 = 0").select("job_id", "seq", "cmd"))),
    "height_correction": _q(lambda d: corrected(d, _heights(d), 0.0, 0.0, 10.0, 10.0, 11, 11)),
    "grid_split": _q(lambda d: grid_split(d, 0.0, 0.0, 25.0, 25.0, 5, 5)),
    "on_cylinder": _q(lambda d: on_cylinder(d, 40.0)),
    "engagement": _q(lambda d: engagement(d, 20.0)),
    "command_fluence": _q(lambda d: fluence(d, 40.0, 0.1, 0.2, 50.0)),
    "tangential_headings": _q(lambda d: headings(d, 30.0), digits=4),
    "smooth_paths": _q(lambda d: smoothed(d, 10)),
    "bezier_measures": _q(bezier_measures, "rings", digits=8),
    "layout_fitness": _candidates,
    "largest_rings": _q(_largest, "rings"),
    "transformers": _q(lambda d: apply_transformers(d, [_UP, _DOUBLE]).select("job_id", "seq", "x")),
    "layer_transformers": _q(lambda d: apply_by_layer(d, {"layer-0": [_UP], "layer-1": [_DOUBLE, _UP]}, [_DOUBLE]).select("job_id", "seq", "x")),
}
J, MOVE, _lag = ops.J, ops.MOVE_SQL, ops._lag
_C = cte("commands")
_LIN = f"""{_C}, p AS (SELECT *, coalesce({_lag('x')}, 0) AS px, coalesce({_lag('y')}, 0) AS py, coalesce({_lag('z')}, 0) AS pz FROM commands),
 a AS (SELECT *, px + ci AS cx, py + cj AS cy, atan2(-cj, -ci) AS a0, atan2(y - py - cj, x - px - ci) AS a1 FROM p),
 g AS (SELECT *, CASE WHEN cw THEN a0 - a1 ELSE a1 - a0 END AS g0, sqrt(ci * ci + cj * cj) AS r0, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r1 FROM a),
 h AS (SELECT *, CASE WHEN g0 <= -pi() THEN g0 + 2 * pi() WHEN g0 > pi() THEN g0 - 2 * pi() ELSE g0 END AS gap FROM g),
 s AS (SELECT *, CASE WHEN abs(gap) < 1e-9 THEN 2 * pi() WHEN gap < 1e-9 THEN gap + 2 * pi() ELSE gap END AS sweep FROM h),
 n AS (SELECT *, CASE WHEN cmd = 'ARC_TO' AND r0 >= 1e-9 THEN greatest(2, ceil(sweep * (r0 + r1) / 2 / 2.0))::INT ELSE 1 END AS n FROM s),
 k AS (SELECT *, unnest(range(1, n + 1)) AS part FROM n),
 l AS (SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY seq, part) - 1)::BIGINT AS seq, CASE cmd WHEN 'ARC_TO' THEN 'LINE_TO' ELSE cmd END AS cmd,
  CASE WHEN part < n THEN cx + (r0 + part / n * (r1 - r0)) * cos(a0 + CASE WHEN cw THEN -1 ELSE 1 END * part / n * sweep) ELSE x END AS x,
  CASE WHEN part < n THEN cy + (r0 + part / n * (r1 - r0)) * sin(a0 + CASE WHEN cw THEN -1 ELSE 1 END * part / n * sweep) ELSE y END AS y, CASE WHEN part < n THEN pz + part / n * (z - pz) ELSE z END AS z FROM k)"""
ORACLE_SQL = {
    "linearize_arcs": f"{_LIN} SELECT job_id, seq, cmd, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM l",
    "rotate_about": f"""{_C} SELECT job_id, seq, round(5 + cos(pi() / 6) * (x - 5) - sin(pi() / 6) * (y + 2), 6) AS x, round(-2 + sin(pi() / 6) * (x - 5) + cos(pi() / 6) * (y + 2), 6) AS y,
 round(cos(pi() / 6) * ci - sin(pi() / 6) * cj, 6) AS ci, round(sin(pi() / 6) * ci + cos(pi() / 6) * cj, 6) AS cj, cw FROM commands""",
    "scale_about": f"{_C} SELECT job_id, seq, round(10 + (x - 10) * 1.5, 6)::DOUBLE AS x, round(20 + (y - 20) * 1.5, 6)::DOUBLE AS y, round(ci * 1.5, 6)::DOUBLE AS ci, round(cj * 1.5, 6)::DOUBLE AS cj, cw FROM commands",
    "affine_mirror": f"""{_C} SELECT job_id, seq, round(-0.6 * x + 0.8 * y + 1, 6) AS x, round(0.8 * x + 0.6 * y + 2, 6) AS y, round(-0.6 * ci + 0.8 * cj, 6) AS ci, round(0.8 * ci + 0.6 * cj, 6) AS cj, NOT cw AS cw FROM commands""",
    "affine_stretch": f"{_LIN} SELECT job_id, seq, cmd, round(2 * x, 6) AS x, round(y, 6) AS y FROM l",
    "cap_power": f"{_C} SELECT job_id, seq, round(CASE WHEN cmd = 'SET_POWER' THEN least(val, 0.6) ELSE val END, 6) AS val FROM commands",
    "multipass": f"""{_C}, c AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM commands) SELECT job_id, (seq + p.p * n)::BIGINT AS seq, cmd, round(z - p.p * 0.5, 6) AS z FROM c, range(3) AS p(p)""",
    "flip_paths": f"""{_C}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS k FROM commands),
 m AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS i, lag(x) {J}) AS px, lag(y) {J}) AS py, lag(z) {J}) AS pz FROM r WHERE {MOVE})
 SELECT job_id, 0::BIGINT AS seq, 'MOVE_TO' AS cmd, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, NULL::DOUBLE AS ci, NULL::DOUBLE AS cj, NULL::BOOLEAN AS cw, NULL::DOUBLE AS val, NULL::VARCHAR AS sval, NULL::VARCHAR AS section_type FROM m WHERE i = 1
 UNION ALL SELECT job_id, k, cmd, round(px, 6), round(py, 6), round(pz, 6), round(px + ci - x, 6), round(py + cj - y, 6), NOT cw, round(val, 6), sval, section_type FROM m WHERE px IS NOT NULL
 UNION ALL SELECT job_id, k, cmd, x, y, z, ci, cj, cw, round(val, 6), sval, section_type FROM r WHERE NOT ({MOVE})""",
    "link_passes": f"""{_C}, s AS (SELECT *, greatest(count(*) FILTER (cmd = 'MOVE_TO') {J} ROWS UNBOUNDED PRECEDING) - 1, 0) AS sp FROM commands), m AS (SELECT * FROM s WHERE {MOVE}),
 e AS (SELECT job_id, sp, min(seq) AS at0, arg_min(x, seq) AS ex, arg_min(y, seq) AS ey, arg_min(z, seq) AS ez, arg_max(x, seq) AS ox, arg_max(y, seq) AS oy FROM m GROUP BY ALL),
 g AS (SELECT *, lag(ox) OVER w AS fx, lag(oy) OVER w AS fy FROM e WINDOW w AS (PARTITION BY job_id ORDER BY sp)),
 u AS (SELECT job_id, 9 AS step, seq, cmd, x, y, z, ci, cj, cw, val, sval, section_type FROM commands UNION ALL SELECT job_id, 0, at0, 'MOVE_TO', fx, fy, 10, NULL, NULL, NULL, NULL, NULL, NULL FROM g WHERE fx IS NOT NULL
  UNION ALL SELECT job_id, 1, at0, 'MOVE_TO', ex, ey, 10, NULL, NULL, NULL, NULL, NULL, NULL FROM g WHERE sqrt((ex - fx) ** 2 + (ey - fy) ** 2) > 1e-12
  UNION ALL SELECT job_id, 2, at0, 'MOVE_TO', ex, ey, ez, NULL, NULL, NULL, NULL, NULL, NULL FROM g WHERE fx IS NOT NULL AND abs(ez - 10) > 1e-12)
 SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY seq, step) - 1)::BIGINT AS seq, cmd, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(ci, 6) AS ci, round(cj, 6) AS cj, cw, round(val, 6) AS val, sval, section_type FROM u""",
    "concatenate": f"""{_C}, u AS (SELECT 0 AS p, job_id, seq, cmd FROM commands UNION ALL SELECT 1, job_id, seq, cmd FROM commands WHERE seq % 2 = 0)
 SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY p, seq) - 1)::BIGINT AS seq, cmd FROM u""",
    "height_correction": f"""{_C}, h AS (SELECT i.i, j.j, (i.i * 7 + j.j * 3) % 5 / 10.0 AS h FROM range(11) i(i), range(11) j(j)),
 f AS (SELECT *, least(greatest(x / 10, 0), 10) AS fx, least(greatest(y / 10, 0), 10) AS fy FROM commands WHERE {MOVE}),
 g AS (SELECT *, floor(fx)::BIGINT AS i, floor(fy)::BIGINT AS j FROM f)
 SELECT job_id, seq, round(x, 6) AS x, round(y, 6) AS y, round(z + (a.h * (1 - fx + g.i) + b.h * (fx - g.i)) * (1 - fy + g.j) + (c.h * (1 - fx + g.i) + d.h * (fx - g.i)) * (fy - g.j), 6) AS z FROM g
 JOIN h a ON a.i = g.i AND a.j = g.j JOIN h b ON b.i = least(g.i + 1, 10) AND b.j = g.j JOIN h c ON c.i = g.i AND c.j = least(g.j + 1, 10) JOIN h d ON d.i = least(g.i + 1, 10) AND d.j = least(g.j + 1, 10)""",
    "grid_split": f"""{_C}, p AS (SELECT *, {_lag('x')} AS px, {_lag('y')} AS py, {_lag('z')} AS pz FROM commands), l AS (SELECT * FROM p WHERE cmd = 'LINE_TO' AND px IS NOT NULL),
 t AS (SELECT job_id, seq, (k.k * 25.0 - px) / (x - px) AS t FROM l, range(5) k(k) WHERE abs(x - px) >= 1e-9 UNION SELECT job_id, seq, (k.k * 25.0 - py) / (y - py) FROM l, range(5) k(k) WHERE abs(y - py) >= 1e-9),
 u AS (SELECT DISTINCT job_id, seq, round(t, 9)::DOUBLE AS t FROM t WHERE t > 1e-9 AND t < 1 - 1e-9 UNION SELECT job_id, seq, 1 FROM l)
 SELECT job_id, seq, round(t, 6) AS t, round(px + t * (x - px), 6) AS x, round(py + t * (y - py), 6) AS y, round(pz + t * (z - pz), 6) AS z FROM u JOIN l USING (job_id, seq)""",
    "on_cylinder": f"{_C} SELECT job_id, seq, round(x, 6) AS x, round(20 * sin(y / 20), 6) AS y, round(20 * cos(y / 20), 6) AS z FROM commands WHERE {MOVE}",
    "engagement": f"""{_C}, a AS (SELECT job_id, seq, x - y AS d, 2 * pi() - 2 * acos(least(greatest((x - y) / 20, -1), 1)) AS angle FROM commands WHERE {MOVE})
 SELECT job_id, seq, round(angle, 6) AS angle, round(200 * (angle - sin(angle)), 6) AS area, round(CASE WHEN abs(d) < 20 THEN 20 - abs(d) ELSE 0 END, 6) AS depth FROM a""",
    "command_fluence": f"""{_C}, s AS (SELECT job_id, seq, cmd, coalesce({ops._set('SET_POWER')}, 0) AS p FROM commands) SELECT job_id, seq, round(least(greatest(p, 0), 1) * 40 * (0.2 / 50) / (0.1 * 0.2 / 100), 6)::DOUBLE AS fluence FROM s WHERE {MOVE}""",
    "tangential_headings": f"""{_C}, p AS (SELECT *, {_lag('x')} AS px, {_lag('y')} AS py FROM commands), r AS (SELECT job_id, seq, degrees(atan2(y - py, x - px)) AS raw FROM p WHERE cmd = 'LINE_TO' AND px IS NOT NULL),
 d AS (SELECT *, raw - lag(raw) {J}) AS d FROM r), s AS (SELECT *, coalesce(d - 360 * floor((d + 180) / 360), 0) AS step, first_value(raw) {J}) AS f FROM d)
 SELECT job_id, seq, round(f + sum(step) {J} ROWS UNBOUNDED PRECEDING), 4) AS heading, abs(step) > 30 AS lift FROM s""",
    "smooth_paths": f"""{_C}, s AS (SELECT *, greatest(count(*) FILTER (cmd = 'MOVE_TO') {J} ROWS UNBOUNDED PRECEDING) - 1, 0) AS sp FROM commands),
 m AS (SELECT *, row_number() OVER (PARTITION BY job_id, sp ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY job_id, sp) AS n FROM s WHERE {MOVE}),
 w AS (SELECT o.o, exp(-0.5 * (o.o / 0.6) ** 2) AS w FROM range(-2, 3) o(o)), k AS (SELECT o, w / (SELECT sum(w) FROM w) AS k FROM w),
 c AS (SELECT m.job_id, m.seq, m.i, m.n, m.x, m.y, sum(q.x * k) AS sx, sum(q.y * k) AS sy FROM m, k JOIN m q ON q.job_id = m.job_id AND q.sp = m.sp AND q.i = least(greatest(m.i + o, 0), m.n - 1) GROUP BY ALL)
 SELECT job_id, seq, round(CASE WHEN i > 0 AND i < n - 1 THEN sx ELSE x END, 6) AS x, round(CASE WHEN i > 0 AND i < n - 1 THEN sy ELSE y END, 6) AS y FROM c""",
    "layout_fitness": f"""{cte('rings')}, e AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 b AS (SELECT ring_id, abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM e GROUP BY ring_id),
 l AS (SELECT l_orderkey AS candidate, l_linenumber % 2 AS sheet, l_suppkey % 4 * 30.0 AS rot, b.* FROM lineitem JOIN b ON ring_id = l_partkey),
 s AS (SELECT candidate, sheet, min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d, sum(x0) AS sx, sum(y0) AS sy, count(*) AS n, sum(area) AS area, sum(least(rot % 90, 90 - rot % 90) / 90 * 0.05) AS turn FROM l GROUP BY ALL),
 t AS (SELECT candidate, sum((c - a) * (d - b)) AS box, sum(a + b + sx - a * n + sy - b * n) AS pull, sum(c - a + (d - b) * 10) AS spread, sum(area) AS area, sum(turn) AS turn, sum(n) AS n FROM s GROUP BY candidate)
 SELECT candidate, round(box / area + pull / greatest(sqrt(area), 1) * 0.001 + spread / greatest(sqrt(area), 1) * 0.01 + turn + greatest(4 - n, 0) * 1000, 6)::DOUBLE AS fitness FROM t""",
    "transformers": f"{_C} SELECT job_id, seq, round(x * 2 + 1, 6) AS x FROM commands",
    "layer_transformers": f"""{_C}, l AS (SELECT *, {ops._LAYER_SQL} AS layer FROM commands) SELECT job_id, seq, round(CASE layer WHEN 'layer-0' THEN x + 1 WHEN 'layer-1' THEN x * 2 + 1 ELSE x * 2 END, 6) AS x FROM l""",
}
ORACLE_SQL["largest_rings"] = f"""{cte('rings')}, e AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM rings WINDOW w AS (PARTITION BY ring_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 b AS (SELECT geom_id, ring_id, abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2 AS area FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY geom_id ORDER BY area DESC, ring_id) AS rank FROM b)
 SELECT geom_id, ring_id, round(area, 6) AS area, rank FROM r WHERE rank <= 3"""
ORACLE_SQL["bezier_measures"] = f"""{cte('rings')}, n AS (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY ring_id) AS n FROM rings),
 c AS (SELECT a.ring_id, a.seq, a.x / 40 AS x0, a.y / 40 AS y0, b.x / 40 AS x1, b.y / 40 AS y1, c.x / 40 AS x2, c.y / 40 AS y2, (c.x + b.x - a.x) / 40 AS x3, (c.y + b.y - a.y) / 40 AS y3 FROM n a JOIN n b ON b.ring_id = a.ring_id AND b.i = a.i % a.n + 1 JOIN n c ON c.ring_id = a.ring_id AND c.i = (a.i + 1) % a.n + 1),
 k AS (SELECT *, greatest(2, ceil((sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) + sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) + sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2)) / 0.1))::INT AS k FROM c),
 t AS (SELECT *, unnest(range(k + 1)) / k AS t FROM k), p AS (SELECT ring_id, seq, t, (1 - t) ** 3 * x0 + 3 * (1 - t) ** 2 * t * x1 + 3 * (1 - t) * t ** 2 * x2 + t ** 3 * x3 AS x, (1 - t) ** 3 * y0 + 3 * (1 - t) ** 2 * t * y1 + 3 * (1 - t) * t ** 2 * y2 + t ** 3 * y3 AS y FROM t),
 d AS (SELECT ring_id, seq, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM p WINDOW w AS (PARTITION BY ring_id, seq ORDER BY t)),
 l AS (SELECT ring_id, seq, sum(d) AS length FROM d GROUP BY ALL)
 SELECT ring_id, seq, round(length, 8) AS length, round((x0 + 3 * x1 + 3 * x2 + x3) / 8, 8) AS bx, round((y0 + 3 * y1 + 3 * y2 + y3) / 8, 8) AS by FROM l JOIN c USING (ring_id, seq)"""
