"""Commands of jobs of any length: state, times, clock and structure by the two-level scan, so one giant job is many tasks.

The results are those of the operators in ``commands``, which hold a whole job in one task. Here rows are cut into blocks
of ``seq``; a block's window, an aggregate of the blocks and a join give what a window over the job would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.geometry import COLLINEAR, arc_length, bezier_length, bezier_steps, hypot
from pathloom.functions.windows import long_scan
from pathloom.operators import commands as ops
from pathloom.operators.commands import ACCELERATION, FEED, NUMBERS, RAPID, STATE, WORDS, has_curves, is_, is_moving, rounded, trapezoid
from pathloom.sources.derive import cte, table

BLOCK = 65536


def _scan(df: DataFrame, sums: dict[str, Column], fills: dict[str, Column], befores: dict[str, Column], block_rows: int) -> DataFrame:
    """``long_scan`` of expressions: their columns come and go."""
    given = {f"__i_{n}": e for n, e in (sums | fills | befores).items()}
    rows = df.withColumns(given) if given else df
    out = long_scan(rows, "job_id", "seq", {n: f"__i_{n}" for n in sums}, {n: f"__i_{n}" for n in fills}, block_rows, {n: f"__i_{n}" for n in befores})
    return out.drop(*given)


def with_state(df: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """Modal state in effect at each command."""
    carried = {n: F.when(is_(c), F.col("val")) for n, c in NUMBERS.items()} | {n: F.when(is_(c), F.col("sval")) for n, c in WORDS.items()}
    carried |= {"power": F.when(is_("SET_POWER"), F.col("val")), "sync_pitch": F.when(is_("SET_SYNC_PITCH"), F.struct(F.when(F.col("val") > 0, F.col("val")).alias("v")))}
    rows = _scan(df, {}, carried, {}, block_rows).withColumns({"power": F.coalesce("power", F.lit(0.0)), "sync_pitch": F.col("sync_pitch.v")})
    return rows.select(*df.columns, *STATE)


def with_durations(df: DataFrame, feed: float = FEED, rapid: float = RAPID, acceleration: float = ACCELERATION, block_rows: int = BLOCK) -> DataFrame:
    """``length``, the chord, and ``duration`` of each command, by the rules of ``commands``."""
    rates = {"__feed": ("SET_FEED_RATE", feed), "__rapid": ("SET_RAPID_RATE", rapid), "__rpm": ("SET_SPINDLE_RPM", 0.0), "__pitch": ("SET_SYNC_PITCH", 0.0)}
    rows = _scan(df, {}, {n: F.when(is_(c), F.col("val")) for n, (c, _) in rates.items()}, {f"__p{c}": F.when(is_moving(), F.col(c)) for c in "xy"}, block_rows)
    rows = rows.withColumns({n: F.coalesce(n, F.lit(d)) for n, (_, d) in rates.items()})
    px, py, x, y = F.coalesce("__px", F.lit(0.0)), F.coalesce("__py", F.lit(0.0)), F.col("x"), F.col("y")
    way = F.when(is_("ARC_TO"), arc_length(px, py, x, y, F.col("ci"), F.col("cj"), F.col("cw")))
    if has_curves(df):
        points = (px, py, F.col("c1x"), F.col("c1y"), F.col("c2x"), F.col("c2y"), x, y)
        rows = rows.withColumn("__steps", F.when(is_("BEZIER_TO"), bezier_steps(*points)))
        way = way.when(is_("BEZIER_TO"), bezier_length(F.col("__steps"), *points))
    rows = rows.withColumn("__way", way.otherwise(hypot(x - px, y - py)))
    synced = F.when((F.col("__pitch") > 0) & (F.col("__rpm") > 0), F.col("__pitch") * F.col("__rpm")).otherwise(F.col("__feed"))
    speed = F.when(is_("MOVE_TO"), F.col("__rapid")).otherwise(synced)
    seconds = F.when(is_moving(), F.when(F.col("__way") < COLLINEAR, F.lit(0.0)).otherwise(trapezoid(F.col("__way"), speed, acceleration))).when(is_("DWELL"), F.col("val") / 1000.0).otherwise(F.lit(0.0))
    chord = F.when(is_moving(), F.coalesce(hypot(x - F.col("__px"), y - F.col("__py")), F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.withColumns({"length": chord, "duration": seconds}).select(*df.columns, "length", "duration")


def with_clock(df: DataFrame, block_rows: int = BLOCK, **rates: float) -> DataFrame:
    """Running simulated time after each command: a second scan, of the durations."""
    return _scan(with_durations(df, block_rows=block_rows, **rates), {"clock": F.col("duration")}, {}, {}, block_rows)


def with_structure(df: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """``subpath``, ``segment``, ``section``, ``open_section``, ``layer`` and ``workpiece`` of each command.

    A segment's parity needs the row's place in its run, so ``seq`` must be dense; the run's first row is carried like a state.
    """
    moving = is_moving().cast("int")
    nulled = lambda start, end, v: F.when(is_(start), F.struct(v.alias("v"))).when(is_(end), F.struct(F.lit(None).cast("string").alias("v")))
    sums = {"__travels": is_("MOVE_TO").cast("long"), "__starts": is_("OPS_SECTION_START").cast("long"), "__ends": is_("OPS_SECTION_END").cast("long")}
    fills = {"layer": nulled("LAYER_START", "LAYER_END", F.col("sval")), "workpiece": nulled("WORKPIECE_START", "WORKPIECE_END", F.col("sval")), "open_section": nulled("OPS_SECTION_START", "OPS_SECTION_END", F.col("section_type"))}
    rows = _scan(df, sums, fills, {"__was": moving}, block_rows)
    turn = F.coalesce(moving != F.col("__was"), F.lit(True))
    rows = _scan(rows.withColumn("__turn", turn), {"__runs": F.col("__turn").cast("long")}, {"__since": F.when(F.col("__turn"), F.col("seq"))}, {}, block_rows)
    place = F.col("seq") - F.col("__since") + 1
    alone = ~is_moving() & F.when(F.col("__runs") == 1, place % 2 == 0).otherwise(place % 2 == 1)
    rows = _scan(rows.withColumn("__alone", alone), {}, {}, {"__after": F.col("__alone")}, block_rows)
    begins = F.when(is_moving(), is_("MOVE_TO") | F.coalesce("__after", F.lit(True))).otherwise(F.lit(True))
    rows = _scan(rows.withColumn("__begins", begins), {"__segments": F.col("__begins").cast("long")}, {}, {}, block_rows)
    return rows.select(
        *df.columns, F.greatest(F.col("__travels") - 1, F.lit(0)).alias("subpath"), (F.col("__segments") - 1).alias("segment"), (F.col("__starts") + F.col("__ends") - is_("OPS_SECTION_END").cast("long")).alias("section"),
        F.col("open_section.v").alias("open_section"), F.col("layer.v").alias("layer"), F.col("workpiece.v").alias("workpiece"),
    )


def job_measures(df: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """Distance, cutting distance, counts and time of each job; the sums of blocks are combined before the last shuffle."""
    cutting = is_moving() & ~is_("MOVE_TO")
    return with_durations(df, block_rows=block_rows).groupBy("job_id").agg(
        F.sum("length").alias("distance"), F.sum(F.when(cutting, F.col("length")).otherwise(0.0)).alias("cut_distance"), F.sum("duration").alias("seconds"),
        F.count_if(cutting).alias("n_cutting"), F.count_if(is_("MOVE_TO")).alias("n_travel"), F.count_if(is_("SCAN_LINE")).alias("n_scanline"), F.count(F.lit(1)).alias("n_commands"),
    )


# Queries and their SQL ----------------------------------------------------------------------------------------------


def _q(f):
    return lambda spark, sf_dir: rounded(f(table(spark, sf_dir, "giant")), digits=4)


QUERIES = {
    "long_job_costing": _q(lambda d: job_measures(d, 1000)),
    "long_preload_state": _q(lambda d: with_state(d, 1000).filter(is_moving()).select("job_id", "seq", "cmd", *STATE)),
    "long_cumulative_time": _q(lambda d: with_clock(d, 1000).select("job_id", "seq", "clock")),
    "long_structure": _q(lambda d: with_structure(d, 1000).select("job_id", "seq", "subpath", "segment", "section", "open_section", "layer", "workpiece")),
}


def _sql(name: str, tail: str = "") -> str:
    text = (tail or ops.ORACLE_SQL[name]).replace(cte("commands"), cte("giant")).replace("FROM commands", "FROM giant")
    return text.replace(", 6)", ", 4)")


_PARTS = {n: _sql(n) for n in ("subpaths", "segments", "sections", "layer_labels")}
ORACLE_SQL = {
    "long_job_costing": _sql("job_costing"),
    "long_preload_state": _sql("preload_state"),
    "long_cumulative_time": _sql("cumulative_time"),
    "long_structure": "SELECT job_id, seq, subpath, segment, section, u.open_section, layer, workpiece FROM " + " JOIN ".join(f"({t}) AS {a}{'' if a == 'a' else ' USING (job_id, seq)'}" for a, t in zip(("a", "b", "u", "d"), (*[_PARTS[n] for n in ("subpaths", "segments", "sections")], f"SELECT job_id, seq, layer, workpiece FROM ({_PARTS['layer_labels']})"), strict=True)),
}
