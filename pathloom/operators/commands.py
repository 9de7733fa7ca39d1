"""Ordered machine commands: modal state, lengths, times, structure and per-job measures.

All operators take a commands table ``(job_id, seq, cmd, x, y, z, ci, cj, cw, val, sval, section_type)`` and use one
window, so a chain of them has a single exchange on ``job_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from pathloom.functions.geometry import COLLINEAR, arc_box, arc_length, bezier_length, bezier_steps, hypot
from pathloom.functions.windows import before, ffill, islands, long_scan, ordered, so_far
from pathloom.sources.derive import cte, table

#: Command names by category.
MOVING = ("MOVE_TO", "LINE_TO", "ARC_TO", "BEZIER_TO", "QUADRATIC_BEZIER_TO", "SCAN_LINE")
MARKERS = ("JOB_START", "JOB_END", "LAYER_START", "LAYER_END", "WORKPIECE_START", "WORKPIECE_END", "OPS_SECTION_START", "OPS_SECTION_END", "STATE_BLOCK_START", "STATE_BLOCK_END")
FEED, RAPID, ACCELERATION = 1000.0, 3000.0, 500.0



#: Columns of the two control points of a BEZIER_TO; tables without curves do without them.
CONTROLS = ("c1x", "c1y", "c1z", "c2x", "c2y", "c2z")


def has_curves(df: DataFrame) -> bool:
    return set(CONTROLS) <= set(df.columns)


def by_job() -> WindowSpec:
    return ordered("job_id")


def is_(*names: str) -> Column:
    return F.col("cmd").isin(*names)


def is_moving() -> Column:
    return is_(*MOVING)


def is_marker() -> Column:
    return is_(*MARKERS)


def category() -> Column:
    return F.when(is_moving(), "MOVING").when(is_marker(), "MARKER").otherwise("STATE")


def with_flags(df: DataFrame) -> DataFrame:
    """Category and flags of each command."""
    return df.select(
        "job_id", "seq", category().alias("category"), is_("MOVE_TO").alias("is_travel"),
        (is_moving() & ~is_("MOVE_TO")).alias("is_cutting"), is_("SCAN_LINE").alias("is_scanline"),
    )


def without_state(df: DataFrame) -> DataFrame:
    return df.filter(is_moving() | is_marker())


def with_state(df: DataFrame, w: WindowSpec | None = None) -> DataFrame:
    """Modal state in effect at each command, all its fields. A pitch of 0 or less clears the pitch, so it is carried wrapped.

    The plunge feed is a field of the state that no command sets; it is left out."""
    w = w or by_job()
    def carried(name, value=F.col("val")):  # noqa: E306
        return ffill(F.when(is_(name), value), w)
    pitch = ffill(F.when(is_("SET_SYNC_PITCH"), F.struct(F.when(F.col("val") > 0, F.col("val")).alias("v"))), w)["v"]
    state = {"power": F.coalesce(carried("SET_POWER"), F.lit(0.0)), **{n: carried(c) for n, c in NUMBERS.items()}, "sync_pitch": pitch, **{n: carried(c, F.col("sval")) for n, c in WORDS.items()}}
    return df.select("*", *[state[n].alias(n) for n in STATE])


#: Fields of the state that a command's number or word sets.
NUMBERS = {"feed_rate": "SET_FEED_RATE", "rapid_rate": "SET_RAPID_RATE", "spindle_rpm": "SET_SPINDLE_RPM", "dwell_ms": "DWELL", "frequency": "SET_FREQUENCY", "pulse_width": "SET_PULSE_WIDTH"}
WORDS = {"coolant": "SET_COOLANT", "active_head_uid": "SET_HEAD", "spindle_direction": "SET_SPINDLE_DIRECTION", "air_assist": "SET_AIR_ASSIST", "head_coolant": "SET_HEAD_COOLANT", "power_mode": "SET_POWER_MODE"}
STATE = ("power", *NUMBERS, "sync_pitch", *WORDS)


def preloaded(df: DataFrame) -> DataFrame:
    """State on every moving command."""
    return with_state(df).filter(is_moving()).select("job_id", "seq", "cmd", *STATE)


def state_at(df: DataFrame, probes: DataFrame) -> DataFrame:
    """The whole state in effect at chosen positions ``probes(job_id, seq)``, commands at them included: a union and a forward fill."""
    marked = df.withColumn("probe", F.lit(0)).unionByName(probes.withColumn("probe", F.lit(1)), allowMissingColumns=True)
    w = ordered("job_id").orderBy("seq", "probe")
    return with_state(marked, w).filter("probe = 1").select("job_id", "seq", *STATE)


def with_previous(df: DataFrame) -> DataFrame:
    """Adds the end of the moving command before (null for the first one)."""
    return df.select("*", *[F.last(F.when(is_moving(), F.col(c)), ignorenulls=True).over(before(by_job())).alias(f"p{c}") for c in "xyz"])


def move_length(df: DataFrame) -> DataFrame:
    """XY chord of each moving command; 0 for the first one and for all others."""
    length = F.when(is_moving(), F.coalesce(hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0))).otherwise(F.lit(0.0))
    return with_previous(df).withColumn("length", length)


def trapezoid(distance: Column, speed: Column, acceleration: float) -> Column:
    """Seconds of a move that starts and ends at rest; ``speed`` in units a minute."""
    v = speed / 60.0
    if acceleration <= 0:
        return F.try_divide(distance, v)
    ramp = v / acceleration
    ramp_distance = F.lit(0.5 * acceleration) * ramp * ramp
    cruise = F.lit(2.0) * ramp + F.try_divide(distance - F.lit(2.0) * ramp_distance, v)
    return F.when(distance < F.lit(2.0) * ramp_distance, F.lit(2.0) * F.sqrt(distance / acceleration)).otherwise(cruise)


def with_durations(df: DataFrame, feed: float = FEED, rapid: float = RAPID, acceleration: float = ACCELERATION) -> DataFrame:
    """Seconds of each command: travel at the rapid rate, cuts at pitch times revolutions when both are set, else at
    the feed rate; dwells by their milliseconds. Lengths are true lengths of arcs and curves, and the path starts at the origin."""
    def carried(name, default):  # noqa: E306
        return F.coalesce(ffill(F.when(is_(name), F.col("val")), by_job()), F.lit(default))
    rows = with_previous(df).select(
        "*", carried("SET_FEED_RATE", feed).alias("__feed"), carried("SET_RAPID_RATE", rapid).alias("__rapid"),
        carried("SET_SPINDLE_RPM", 0.0).alias("__rpm"), carried("SET_SYNC_PITCH", 0.0).alias("__pitch"),
    )
    px, py = F.coalesce("px", F.lit(0.0)), F.coalesce("py", F.lit(0.0))
    x, y = F.col("x"), F.col("y")
    length = F.when(is_("ARC_TO"), arc_length(px, py, x, y, F.col("ci"), F.col("cj"), F.col("cw")))
    if has_curves(df):
        points = (px, py, F.col("c1x"), F.col("c1y"), F.col("c2x"), F.col("c2y"), x, y)
        rows = rows.withColumn("__steps", F.when(is_("BEZIER_TO"), bezier_steps(*points)))
        length = length.when(is_("BEZIER_TO"), bezier_length(F.col("__steps"), *points))
    length = length.otherwise(hypot(x - px, y - py))
    synced = F.when((F.col("__pitch") > 0) & (F.col("__rpm") > 0), F.col("__pitch") * F.col("__rpm")).otherwise(F.col("__feed"))
    speed = F.when(is_("MOVE_TO"), F.col("__rapid")).otherwise(synced)
    seconds = F.when(is_moving(), F.when(F.col("__length") < COLLINEAR, F.lit(0.0)).otherwise(trapezoid(F.col("__length"), speed, acceleration)))
    seconds = seconds.when(is_("DWELL"), F.col("val") / 1000.0).otherwise(F.lit(0.0))
    return rows.withColumn("__length", length).withColumn("duration", seconds).drop("__feed", "__rapid", "__rpm", "__pitch", "__length", "__steps")


def with_clock(df: DataFrame) -> DataFrame:
    """Running simulated time after each command."""
    return df.withColumn("clock", F.sum("duration").over(so_far(by_job())))


def index_at_time(df: DataFrame, probes: DataFrame) -> DataFrame:
    """The last command whose clock is not after ``probes(job_id, t)``, 0 where none is: union and forward fill."""
    timed = with_clock(with_durations(df)).select("job_id", F.col("clock").alias("t"), "seq", F.lit(0).alias("probe"))
    both = timed.unionByName(probes.select("job_id", "t", F.lit(None).cast("long").alias("seq"), F.lit(1).alias("probe")))
    w = ordered("job_id").orderBy("t", "probe", "seq")
    found = F.coalesce(F.last("seq", ignorenulls=True).over(so_far(w)), F.lit(0))
    return both.select("job_id", "t", "probe", found.alias("at")).filter("probe = 1").drop("probe")


def translate_layers(df: DataFrame, offsets: DataFrame, default: tuple[float, float, float]) -> DataFrame:
    """Moves points by the offset of the open layer, or by the default one: ``offsets(layer, ox, oy, oz)``.

    All rows and columns stay, and ``layer`` comes besides; rows without a point are not changed."""
    opened = ffill(F.when(is_("LAYER_START"), F.struct(F.col("sval").alias("v"))).when(is_("LAYER_END"), F.struct(F.lit(None).cast("string").alias("v"))), by_job())["v"]
    rows = df.withColumn("layer", opened).join(offsets, "layer", "left")
    moved = {c: F.when(is_moving(), F.col(c) - F.coalesce(f"o{c}", F.lit(d))).otherwise(F.col(c)) for c, d in zip("xyz", default)}
    return rows.withColumns(moved).select(*df.columns, "layer")


def with_layers(df: DataFrame) -> DataFrame:
    """The open layer, workpiece and section's type at each command, null outside."""
    def opened(start, end, value):  # noqa: E306
        return ffill(F.when(is_(start), F.struct(value.alias("v"))).when(is_(end), F.struct(F.lit(None).cast("string").alias("v"))), by_job())["v"]
    return df.select("*", opened("LAYER_START", "LAYER_END", F.col("sval")).alias("layer"), opened("WORKPIECE_START", "WORKPIECE_END", F.col("sval")).alias("workpiece"), opened("OPS_SECTION_START", "OPS_SECTION_END", F.col("section_type")).alias("open_section"))


def with_subpaths(df: DataFrame) -> DataFrame:
    """Subpath number: new at each travel after the first; rows before it belong to subpath 0."""
    return df.withColumn("subpath", F.greatest(islands(is_("MOVE_TO"), by_job()) - 1, F.lit(0)))


def with_segments(df: DataFrame) -> DataFrame:
    """Segment number. Travel starts one; in a run of other rows every second stands alone, the rest open segments.

    After a moving row positions 1, 3, ... of the run stand alone; at the start of a job the parity is reversed.
    """
    moving = is_moving().cast("int")
    run = islands(F.coalesce(moving != F.lag(moving).over(by_job()), F.lit(True)), by_job())
    rows = df.withColumn("__run", run)
    inside = ordered("job_id", "__run")
    rows = rows.withColumn("__at", F.row_number().over(inside)).withColumn("__first_run", F.col("__run") == 1)
    alone = ~is_moving() & F.when(F.col("__first_run"), F.col("__at") % 2 == 0).otherwise(F.col("__at") % 2 == 1)
    rows = rows.withColumn("__alone", alone)
    after_alone = F.coalesce(F.lag("__alone").over(by_job()), F.lit(True))
    starts = F.when(is_moving(), is_("MOVE_TO") | after_alone).otherwise(F.lit(True))
    return rows.withColumn("segment", islands(starts, by_job()) - 1).drop("__run", "__at", "__first_run", "__alone")


def with_sections(df: DataFrame) -> DataFrame:
    """Section number (starts plus ends before) and type; unmarked content has a null type."""
    number = islands(is_("OPS_SECTION_START"), by_job()) + F.coalesce(F.sum(is_("OPS_SECTION_END").cast("int")).over(before(by_job())), F.lit(0))
    return with_layers(df).withColumn("section", number)


def nesting_errors(df: DataFrame) -> DataFrame:
    """Commands at which layers nest or end without a start."""
    depth = F.sum(F.when(is_("LAYER_START"), 1).when(is_("LAYER_END"), -1).otherwise(0)).over(so_far(by_job()))
    return df.withColumn("depth", depth).filter(is_("LAYER_START", "LAYER_END") & ~F.col("depth").isin(0, 1)).select("job_id", "seq", "cmd", "depth")


def with_coolant_groups(df: DataFrame) -> DataFrame:
    """Runs of moving commands of equal coolant, air assist and head coolant; markers and rows without state stand alone."""
    rows = with_state(df).withColumn("__s", F.when(is_moving(), F.struct("coolant", "air_assist", "head_coolant")))
    last_marker = F.coalesce(F.lag(is_marker()).over(by_job()), F.lit(True))
    before_row = F.lag("__s").over(by_job())
    same = F.col("__s").isNotNull() & before_row.isNotNull()
    for c in ("coolant", "air_assist", "head_coolant"):
        same = same & F.col("__s")[c].eqNullSafe(before_row[c])
    return rows.withColumn("regime", islands(is_marker() | last_marker | ~same, by_job()) - 1).drop("__s")


def job_measures(df: DataFrame) -> DataFrame:
    """Distance, cutting distance, counts, time and size of each job, in one exchange."""
    rows = move_length(with_durations(df).drop("px", "py", "pz"))
    cutting = is_moving() & ~is_("MOVE_TO")
    return rows.groupBy("job_id").agg(
        F.sum("length").alias("distance"), F.sum(F.when(cutting, F.col("length")).otherwise(0.0)).alias("cut_distance"),
        F.sum("duration").alias("seconds"), F.count_if(cutting).alias("n_cutting"), F.count_if(is_("MOVE_TO")).alias("n_travel"),
        F.count_if(is_("SCAN_LINE")).alias("n_scanline"), F.count(F.lit(1)).alias("n_commands"),
    )


def _boxes(df: DataFrame) -> DataFrame:
    """Bounds of each moving command, control points of curves included; cuts before any travel start at the origin."""
    rows = with_state(with_previous(df)).filter(is_moving())
    px, py, x, y = F.coalesce("px", F.lit(0.0)), F.coalesce("py", F.lit(0.0)), F.col("x"), F.col("y")
    ci, cj, r = F.col("ci"), F.col("cj"), hypot(F.col("ci"), F.col("cj"))
    circle = (F.abs(px - x) < COLLINEAR) & (F.abs(py - y) < COLLINEAR) & (r > COLLINEAR)
    round_box = (F.least(px, px + ci - r), F.least(py, py + cj - r), F.greatest(px, px + ci + r), F.greatest(py, py + cj + r))
    plain = (F.least(px, x), F.least(py, y), F.greatest(px, x), F.greatest(py, y))
    arc = arc_box(px, py, x, y, ci, cj, F.col("cw"))
    names = ("x0", "y0", "x1", "y1")
    curve = [f(p, *[F.col(f"c{k}{n[0]}") for k in (1, 2)]) for n, p, f in zip(names, plain, (F.least, F.least, F.greatest, F.greatest))] if has_curves(df) else plain
    return rows.select("*", *[F.when(is_("ARC_TO"), F.when(circle, c).otherwise(a)).when(is_("BEZIER_TO"), b).otherwise(p).alias(n) for n, c, a, p, b in zip(names, round_box, arc, plain, curve)])


def _bounds(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max("x1").alias("max_x"), F.max("y1").alias("max_y"))


def bounding_boxes(df: DataFrame, travel: bool = False) -> DataFrame:
    """Box of each job's cuts, or of all its moves; a travel counts with its end and where it came from."""
    rows = _boxes(df)
    return _bounds(rows if travel else rows.filter(~is_("MOVE_TO")), "job_id")


def powered_boxes(df: DataFrame) -> DataFrame:
    """Box of each job's cuts at a power above 0."""
    return _bounds(_boxes(df).filter(~is_("MOVE_TO") & (F.col("power") > 0)), "job_id")


def frames(df: DataFrame, power: float | None = None, feed_rate: float | None = None) -> DataFrame:
    """A closed rectangle around each job's cuts, as commands, behind rows that set power and feed rate where these are given."""
    null = F.lit(None).cast("double")
    state = [(c, null, null, F.lit(float(v))) for c, v in (("SET_POWER", power), ("SET_FEED_RATE", feed_rate)) if v is not None]
    path = [("MOVE_TO", "min_x", "min_y"), ("LINE_TO", "min_x", "max_y"), ("LINE_TO", "max_x", "max_y"), ("LINE_TO", "max_x", "min_y"), ("LINE_TO", "min_x", "min_y")]
    rows = state + [(c, F.col(x), F.col(y), null) for c, x, y in path]
    structs = [F.struct(F.lit(i).alias("seq"), F.lit(c).alias("cmd"), x.alias("x"), y.alias("y"), v.alias("val")) for i, (c, x, y, v) in enumerate(rows)]
    return bounding_boxes(df).select("job_id", F.inline(F.array(*structs)))


def long_jobs(df: DataFrame, block_rows: int = 1000) -> DataFrame:
    """Modal power and running value of jobs of any length, by the two-level scan."""
    rows = df.withColumn("set_power", F.when(is_("SET_POWER"), F.col("val"))).withColumn("dx", F.coalesce("x", F.lit(0.0)))
    return long_scan(rows, "job_id", "seq", {"sum_x": "dx"}, {"power": "set_power"}, block_rows).select("job_id", "seq", "sum_x", "power")


# Queries and their SQL ----------------------------------------------------------------------------------------------

J = "OVER (PARTITION BY job_id ORDER BY seq"
MOVE_SQL = "cmd IN ('MOVE_TO','LINE_TO','ARC_TO')"
MARK_SQL = "cmd IN ('LAYER_START','LAYER_END','WORKPIECE_START','WORKPIECE_END','OPS_SECTION_START','OPS_SECTION_END')"


def _ff(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) {J} ROWS UNBOUNDED PRECEDING)"


def _lag(c: str) -> str:
    return f"last_value(CASE WHEN {MOVE_SQL} THEN {c} END IGNORE NULLS) {J} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _set(name: str, value: str = "val") -> str:
    return _ff(f"CASE WHEN cmd = '{name}' THEN {value} END")


_STATE_SQL = ", ".join([
    f"coalesce({_set('SET_POWER')}, 0.0) AS power", *[f"{_set(c)} AS {n}" for n, c in NUMBERS.items()],
    _ff("CASE WHEN cmd = 'SET_SYNC_PITCH' THEN {'v': CASE WHEN val > 0 THEN val END} END") + ".v AS sync_pitch", *[f"{_set(c, 'sval')} AS {n}" for n, c in WORDS.items()],
])
_TIME_SQL = f"""{cte('commands')},
a AS (SELECT *, {_lag('x')} AS px, {_lag('y')} AS py, coalesce({_set('SET_FEED_RATE')}, {FEED}) AS feed, coalesce({_set('SET_RAPID_RATE')}, {RAPID}) AS rapid,
 coalesce({_set('SET_SPINDLE_RPM')}, 0) AS rpm, coalesce({_set('SET_SYNC_PITCH')}, 0) AS pitch FROM commands),
b AS (SELECT *, coalesce(px, 0) AS qx, coalesce(py, 0) AS qy, sqrt(ci * ci + cj * cj) AS r, atan2(y - coalesce(py, 0) - cj, x - coalesce(px, 0) - ci) - atan2(-cj, -ci) AS d,
 CASE WHEN cmd = 'MOVE_TO' THEN rapid WHEN pitch > 0 AND rpm > 0 THEN pitch * rpm ELSE feed END / 60.0 AS v FROM a),
c AS (SELECT *, CASE WHEN cmd = 'ARC_TO' THEN CASE WHEN r < 1e-9 THEN 0 ELSE r * abs(CASE WHEN abs(d) < 1e-9 OR abs(d) > 2 * pi() - 1e-9 THEN 2 * pi() WHEN cw AND d > 1e-9 THEN d - 2 * pi()
 WHEN NOT cw AND d < -1e-9 THEN d + 2 * pi() ELSE d END) END ELSE sqrt((x - qx) ** 2 + (y - qy) ** 2) END AS len FROM b),
timed AS (SELECT *, CASE WHEN {MOVE_SQL} THEN CASE WHEN len < 1e-9 THEN 0 WHEN len < v * v / {ACCELERATION} THEN 2 * sqrt(len / {ACCELERATION})
 ELSE 2 * v / {ACCELERATION} + (len - v * v / {ACCELERATION}) / v END WHEN cmd = 'DWELL' THEN val / 1000.0 ELSE 0 END AS duration,
 CASE WHEN {MOVE_SQL} THEN coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0) ELSE 0 END AS length FROM c)"""
_PIECE_SQL = _ff("CASE WHEN cmd = 'WORKPIECE_START' THEN {'v': sval} WHEN cmd = 'WORKPIECE_END' THEN {'v': NULL::VARCHAR} END") + ".v"
_LAYER_SQL = _ff("CASE WHEN cmd = 'LAYER_START' THEN {'v': sval} WHEN cmd = 'LAYER_END' THEN {'v': NULL::VARCHAR} END") + ".v"
_SECTION_SQL = _ff("CASE WHEN cmd = 'OPS_SECTION_START' THEN {'v': section_type} WHEN cmd = 'OPS_SECTION_END' THEN {'v': NULL::VARCHAR} END") + ".v"
_BETWEEN = "CASE WHEN cw THEN CASE WHEN s < e THEN {t} <= s OR {t} >= e ELSE e <= {t} AND {t} <= s END ELSE CASE WHEN s > e THEN {t} >= s OR {t} <= e ELSE s <= {t} AND {t} <= e END END"
_BOX_SQL = f"""{cte('commands')},
a AS (SELECT *, coalesce({_lag('x')}, 0) AS px, coalesce({_lag('y')}, 0) AS py, sqrt(ci * ci + cj * cj) AS r, coalesce({_set('SET_POWER')}, 0.0) AS power FROM commands),
b AS (SELECT *, px + ci AS cx, py + cj AS cy, (atan2(-cj, -ci) + 2 * pi()) % (2 * pi()) AS s, (atan2(y - py - cj, x - px - ci) + 2 * pi()) % (2 * pi()) AS e,
 abs(px - x) < 1e-9 AND abs(py - y) < 1e-9 AND r > 1e-9 AS whole FROM a WHERE cmd IN ('LINE_TO', 'ARC_TO')),
boxes AS (SELECT *, CASE WHEN cmd = 'ARC_TO' AND (whole OR {_BETWEEN.format(t='pi()')}) THEN least(px, x, cx - r) ELSE least(px, x) END AS x0,
 CASE WHEN cmd = 'ARC_TO' AND (whole OR {_BETWEEN.format(t='(3 * pi() / 2)')}) THEN least(py, y, cy - r) ELSE least(py, y) END AS y0,
 CASE WHEN cmd = 'ARC_TO' AND (whole OR {_BETWEEN.format(t='0')}) THEN greatest(px, x, cx + r) ELSE greatest(px, x) END AS x1,
 CASE WHEN cmd = 'ARC_TO' AND (whole OR {_BETWEEN.format(t='(pi() / 2)')}) THEN greatest(py, y, cy + r) ELSE greatest(py, y) END AS y1 FROM b)"""
_BOUNDS_SQL = "job_id, round(min(x0), 6) AS min_x, round(min(y0), 6) AS min_y, round(max(x1), 6) AS max_x, round(max(y1), 6) AS max_y"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with another engine; sums of doubles depend on their order."""
    names = columns or [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


def _q(f):
    return lambda spark, sf_dir: rounded(f(table(spark, sf_dir, "commands")))


def _probes(df: DataFrame) -> DataFrame:
    return df.filter("seq % 7 = 3").select("job_id", "seq")


def _times(df: DataFrame) -> DataFrame:
    return df.select("job_id").distinct().select("job_id", F.explode(F.array(*[F.lit(float(t) + 0.0005) for t in (0, 5, 50, 500)])).alias("t"))


def _offsets(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([("layer-0", 1.0, 2.0, 3.0), ("layer-1", 4.0, 5.0, 6.0)], "layer string, ox double, oy double, oz double")


QUERIES = {
    "job_costing": _q(job_measures),
    "command_flags": _q(with_flags),
    "without_state": _q(lambda d: without_state(d).select("job_id", "seq", "cmd")),
    "preload_state": _q(preloaded),
    "state_at": _q(lambda d: state_at(d, _probes(d))),
    "move_length": _q(lambda d: move_length(d).select("job_id", "seq", "length")),
    "command_times": _q(lambda d: with_durations(d).select("job_id", "seq", "duration")),
    "cumulative_time": _q(lambda d: with_clock(with_durations(d)).select("job_id", "seq", "clock")),
    "index_at_time": _q(lambda d: index_at_time(d, _times(d))),
    "translate_layers": _q(lambda d: translate_layers(d, _offsets(d), (0.5, 0.5, 0.0)).select("job_id", "seq", "layer", "cmd", "x", "y", "z", "val")),
    "layer_labels": _q(lambda d: with_layers(d).select("job_id", "seq", "layer", "workpiece", "open_section")),
    "subpaths": _q(lambda d: with_subpaths(d).select("job_id", "seq", "subpath")),
    "segments": _q(lambda d: with_segments(d).select("job_id", "seq", "segment")),
    "sections": _q(lambda d: with_sections(d).select("job_id", "seq", "section", "open_section")),
    "nesting_errors": _q(nesting_errors),
    "coolant_groups": _q(lambda d: with_coolant_groups(d).select("job_id", "seq", "regime")),
    "bounding_boxes": _q(bounding_boxes),
    "powered_boxes": _q(powered_boxes),
    "moves_boxes": _q(lambda d: bounding_boxes(d, travel=True)),
    "frames": _q(lambda d: frames(d, 0.25, 1200.0)),
    "long_job_scan": _q(long_jobs),
}

ORACLE_SQL = {
    "job_costing": f"""{_TIME_SQL} SELECT job_id, round(sum(length), 6) AS distance, round(sum(CASE WHEN cmd IN ('LINE_TO','ARC_TO') THEN length ELSE 0 END), 6) AS cut_distance,
 round(sum(duration), 6) AS seconds, count(*) FILTER (cmd IN ('LINE_TO','ARC_TO')) AS n_cutting, count(*) FILTER (cmd = 'MOVE_TO') AS n_travel,
 count(*) FILTER (cmd = 'SCAN_LINE') AS n_scanline, count(*) AS n_commands FROM timed GROUP BY job_id""",
    "command_flags": f"""{cte('commands')} SELECT job_id, seq, CASE WHEN {MOVE_SQL} THEN 'MOVING' WHEN {MARK_SQL} THEN 'MARKER' ELSE 'STATE' END AS category,
 cmd = 'MOVE_TO' AS is_travel, cmd IN ('LINE_TO','ARC_TO') AS is_cutting, cmd = 'SCAN_LINE' AS is_scanline FROM commands""",
    "without_state": f"{cte('commands')} SELECT job_id, seq, cmd FROM commands WHERE {MOVE_SQL} OR {MARK_SQL}",
    "preload_state": f"{cte('commands')}, s AS (SELECT job_id, seq, cmd, {_STATE_SQL} FROM commands) SELECT * FROM s WHERE {MOVE_SQL}",
    "state_at": f"""{cte('commands')}, s AS (SELECT job_id, seq, {_STATE_SQL} FROM commands) SELECT * FROM s WHERE seq % 7 = 3""",
    "move_length": f"{_TIME_SQL} SELECT job_id, seq, round(length, 6) AS length FROM timed",
    "command_times": f"{_TIME_SQL} SELECT job_id, seq, round(duration, 6) AS duration FROM timed",
    "cumulative_time": f"{_TIME_SQL} SELECT job_id, seq, round(sum(duration) {J} ROWS UNBOUNDED PRECEDING), 6) AS clock FROM timed",
    "index_at_time": f"""{_TIME_SQL}, k AS (SELECT job_id, seq, sum(duration) {J} ROWS UNBOUNDED PRECEDING) AS clock FROM timed),
 p AS (SELECT job_id, unnest([0.0005, 5.0005, 50.0005, 500.0005])::DOUBLE AS t FROM (SELECT DISTINCT job_id FROM commands))
 SELECT p.job_id, p.t, coalesce(max(seq), 0) AS at FROM p LEFT JOIN k ON k.job_id = p.job_id AND k.clock <= p.t GROUP BY p.job_id, p.t""",
    "translate_layers": f"""{cte('commands')}, l AS (SELECT *, {_LAYER_SQL} AS layer FROM commands),
 o AS (SELECT * FROM (VALUES ('layer-0', 1.0, 2.0, 3.0), ('layer-1', 4.0, 5.0, 6.0)) AS t(layer, ox, oy, oz))
 SELECT job_id, seq, l.layer, l.cmd, (x - coalesce(ox, 0.5))::DOUBLE AS x, (y - coalesce(oy, 0.5))::DOUBLE AS y, (z - coalesce(oz, 0.0))::DOUBLE AS z, val FROM l LEFT JOIN o ON o.layer = l.layer""",
    "layer_labels": f"{cte('commands')} SELECT job_id, seq, {_LAYER_SQL} AS layer, {_PIECE_SQL} AS workpiece, {_SECTION_SQL} AS open_section FROM commands",
    "subpaths": f"{cte('commands')} SELECT job_id, seq, greatest(count(*) FILTER (cmd = 'MOVE_TO') {J} ROWS UNBOUNDED PRECEDING) - 1, 0) AS subpath FROM commands",
    "segments": f"""{cte('commands')}, ordered AS (SELECT *, {MOVE_SQL} AS m FROM commands),
 r AS (SELECT *, sum(CASE WHEN m IS DISTINCT FROM pm THEN 1 ELSE 0 END) {J} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(m) {J}) AS pm FROM ordered)),
 n AS (SELECT *, row_number() OVER (PARTITION BY job_id, run ORDER BY seq) AS k FROM r),
 s AS (SELECT *, NOT m AND k % 2 = CASE WHEN run = 1 THEN 0 ELSE 1 END AS alone FROM n)
 SELECT job_id, seq, (sum(CASE WHEN NOT m OR cmd = 'MOVE_TO' OR coalesce(pa, true) THEN 1 ELSE 0 END) {J} ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS segment
 FROM (SELECT *, lag(alone) {J}) AS pa FROM s)""",
    "sections": f"""{cte('commands')} SELECT job_id, seq, count(*) FILTER (cmd = 'OPS_SECTION_START') {J} ROWS UNBOUNDED PRECEDING)
 + count(*) FILTER (cmd = 'OPS_SECTION_END') {J} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section, {_SECTION_SQL} AS open_section FROM commands""",
    "nesting_errors": f"""{cte('commands')}, d AS (SELECT job_id, seq, cmd, (sum(CASE cmd WHEN 'LAYER_START' THEN 1 WHEN 'LAYER_END' THEN -1 ELSE 0 END) {J} ROWS UNBOUNDED PRECEDING))::BIGINT AS depth FROM commands)
 SELECT * FROM d WHERE cmd IN ('LAYER_START', 'LAYER_END') AND depth NOT IN (0, 1)""",
    "coolant_groups": f"""{cte('commands')}, s AS (SELECT *, {MARK_SQL} AS k, {MOVE_SQL} AS m, {{'a': {_set('SET_COOLANT', 'sval')}, 'b': {_set('SET_AIR_ASSIST', 'sval')}, 'c': {_set('SET_HEAD_COOLANT', 'sval')}}} AS c FROM commands),
 p AS (SELECT *, lag(k) {J}) AS pk, lag(m) {J}) AS pm, lag(c) {J}) AS pc FROM s)
 SELECT job_id, seq, (sum(CASE WHEN k OR coalesce(pk, true) OR NOT (m AND pm AND c IS NOT DISTINCT FROM pc) THEN 1 ELSE 0 END) {J} ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS regime FROM p""",
    "bounding_boxes": f"{_BOX_SQL} SELECT {_BOUNDS_SQL} FROM boxes GROUP BY job_id",
    "powered_boxes": f"{_BOX_SQL} SELECT {_BOUNDS_SQL} FROM boxes WHERE power > 0 GROUP BY job_id",
    "moves_boxes": f"""{_BOX_SQL}, tr AS (SELECT job_id, x, y, coalesce({_lag('x')}, 0) AS px, coalesce({_lag('y')}, 0) AS py, cmd FROM commands),
 al AS (SELECT job_id, x0, y0, x1, y1 FROM boxes UNION ALL SELECT job_id, least(px, x), least(py, y), greatest(px, x), greatest(py, y) FROM tr WHERE cmd = 'MOVE_TO') SELECT {_BOUNDS_SQL} FROM al GROUP BY job_id""",
    "frames": f"""{_BOX_SQL}, b2 AS (SELECT {_BOUNDS_SQL} FROM boxes GROUP BY job_id)
 SELECT job_id, t.seq, t.cmd, CASE t.fx WHEN 0 THEN min_x WHEN 1 THEN max_x END AS x, CASE t.fy WHEN 0 THEN min_y WHEN 1 THEN max_y END AS y, t.val::DOUBLE AS val
 FROM b2, (VALUES (0, 'SET_POWER', 9, 9, 0.25), (1, 'SET_FEED_RATE', 9, 9, 1200), (2, 'MOVE_TO', 0, 0, NULL), (3, 'LINE_TO', 0, 1, NULL), (4, 'LINE_TO', 1, 1, NULL), (5, 'LINE_TO', 1, 0, NULL), (6, 'LINE_TO', 0, 0, NULL)) AS t(seq, cmd, fx, fy, val)""",
    "long_job_scan": f"{cte('commands')} SELECT job_id, seq, round(sum(coalesce(x, 0)) {J} ROWS UNBOUNDED PRECEDING), 6) AS sum_x, {_set('SET_POWER')} AS power FROM commands",
}
