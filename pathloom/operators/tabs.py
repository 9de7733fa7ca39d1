"""Tabs on the contours of commands: power lowered along stretches of a path and restored behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geometry import GAP_CLOSE, hypot, on_segment
from pathloom.functions.loops import saved
from pathloom.functions.windows import ffill, so_far
from pathloom.operators.commands import by_job, is_, is_moving, rounded
from pathloom.operators.curves import _LINES, _MOVE, contours
from pathloom.operators.spatial import nearest_edges
from pathloom.operators.transforms import linearized
from pathloom.sources.derive import table


def contour_pieces(df: DataFrame, resolution: float = 1.0, tolerance: float = 0.01) -> DataFrame:
    """Straight pieces of the contours of vector sections: ``job_id, line, seq, part, at, ax .. bz`` and ``e0, e1``, how far along the
    contour they begin and end. ``at`` counts a contour's pieces from 0; arcs and curves are their chords; pieces of no length go."""
    marked = contours(df).select("job_id", "seq", "__in", F.col("__line").alias("line"))
    rows = linearized(df.filter(is_moving()), resolution, tolerance).join(marked, ["job_id", "seq"]).filter("__in")
    w = Window.partitionBy("job_id", "line").orderBy("seq", "part")
    rows = rows.withColumns({f"a{c}": F.lag(c).over(w) for c in "xyz"} | {"head": F.first("cmd").over(w)}).filter((F.col("head") == "MOVE_TO") & ~is_("MOVE_TO"))
    rows = rows.withColumn("length", hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))).filter("length >= 1e-9")
    rows = rows.withColumns({"at": F.row_number().over(w) - 1, "e1": F.sum("length").over(so_far(w))})
    return rows.select("job_id", "line", "seq", "part", "at", "ax", "ay", "az", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"), (F.col("e1") - F.col("length")).alias("e0"), "e1")


def tab_stretches(pieces: DataFrame, tabs: DataFrame) -> DataFrame:
    """Stretches of contours that tabs ``(tab_id, job_id, x, y, width)`` take: ``job_id, line, g0, g1``, those that overlap made one.

    A tab belongs to the nearest contour of its job, if within twice its width. It takes half its width on both sides,
    on a closed contour also across its end. Gaps and islands: the running maximum of the ends so far.
    """
    rows = saved(pieces)
    edges = rows.select("job_id", F.col("line").alias("ring_id"), F.col("at").alias("seq"), "ax", "ay", "bx", "by")
    hit = nearest_edges(tabs.select(F.col("tab_id").alias("point_id"), "job_id", "x", "y"), edges, "job_id").withColumnsRenamed({"point_id": "tab_id", "ring_id": "line", "seq": "at"})
    near = hit.join(tabs, ["tab_id", "job_id"]).filter(F.col("d2") <= 4 * F.col("width") ** 2).join(rows, ["job_id", "line", "at"])
    t = on_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))[0]
    middle = F.col("e0") + t * (F.col("e1") - F.col("e0"))
    whole = rows.groupBy("job_id", "line").agg(F.max("e1").alias("total"), (hypot(F.max_by("bx", "at") - F.min_by("ax", "at"), F.max_by("by", "at") - F.min_by("ay", "at")) < GAP_CLOSE).alias("closed"))
    raw = near.select("job_id", "line", (middle - F.col("width") / 2).alias("g0"), (middle + F.col("width") / 2).alias("g1")).join(whole, ["job_id", "line"])
    turns = raw.withColumn("turn", F.explode(F.when(F.col("closed"), F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    shift = lambda c: F.least(F.greatest(F.col(c) + F.col("turn") * F.col("total"), F.lit(0.0)), F.col("total"))
    clipped = turns.select("job_id", "line", shift("g0").alias("g0"), shift("g1").alias("g1")).filter("g1 > g0 + 1e-9")
    w = Window.partitionBy("job_id", "line").orderBy("g0", "g1")
    fresh = F.coalesce(F.col("g0") > F.max("g1").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1e-9, F.lit(True))
    runs = clipped.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(so_far(w)))
    return runs.groupBy("job_id", "line", "run").agg(F.min("g0").alias("g0"), F.max("g1").alias("g1")).drop("run")


def with_tab_power(df: DataFrame, tabs: DataFrame, share: float, resolution: float = 1.0, tolerance: float = 0.01) -> DataFrame:
    """The job's rows with its power times ``share`` along the tabs, restored behind them: ``job_id, seq, part, cmd, x, y, z, val``.

    Contours with a tab become lines, cut where a stretch begins and ends; there SET_POWER rows follow. The power that is
    restored is the one in effect at that row. Other rows stay as they are, in their place (part 0); new rows of a command
    have its ``seq`` and count on. Points on a contour and ends of stretches are put in one order by their way along
    it, and the piece under an end is the next one in that order: a window, not a join of all pieces with all tabs.
    """
    pieces = saved(contour_pieces(df, resolution, tolerance))
    stretches = saved(tab_stretches(pieces, tabs))
    own = saved(pieces.join(stretches.select("job_id", "line").distinct(), ["job_id", "line"]))
    w = Window.partitionBy("job_id", "line").orderBy("d", "kind")
    corners = own.select("job_id", "line", F.col("e1").alias("d"), F.lit(0).alias("kind"), F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bz").alias("z"), "seq", F.struct("ax", "ay", "az", "bx", "by", "bz", "e0", "e1", "seq").alias("piece"))
    none = {"x": "double", "y": "double", "z": "double", "seq": "long"}
    ends = stretches.select("job_id", "line", F.inline(F.array(F.struct(F.col("g0").alias("d"), F.lit(True).alias("enter")), F.struct(F.col("g1").alias("d"), F.lit(False).alias("enter")))))
    both = corners.withColumn("enter", F.lit(None).cast("boolean")).unionByName(ends.withColumn("kind", F.lit(1)).withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"piece": F.lit(None).cast(corners.schema["piece"].dataType)}))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"last": F.last("piece", ignorenulls=True).over(before), "next": F.first("piece", ignorenulls=True).over(after)})
    gap = F.col("d") - F.col("last.e1")
    on_corner = F.coalesce(gap < 1e-9, F.lit(False))
    under = F.when(on_corner | F.col("next").isNull(), F.col("last")).otherwise(F.col("next"))
    both = both.withColumn("under", under)
    t = (F.col("d") - F.col("under.e0")) / (F.col("under.e1") - F.col("under.e0"))
    at = lambda c: F.col(f"under.a{c}") + t * (F.col(f"under.b{c}") - F.col(f"under.a{c}"))
    split = ~on_corner & F.col("next").isNotNull() & (F.col("d") > 1e-9)
    event = F.col("kind") == 1
    row = lambda k, cmd, x, y, z, enter: F.struct(F.lit(k).alias("k"), F.lit(cmd).alias("cmd"), x.alias("x"), y.alias("y"), z.alias("z"), enter.alias("enter"))
    null, unknown = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    emitted = F.array_compact(F.array(F.when(~event, row(0, "LINE_TO", F.col("x"), F.col("y"), F.col("z"), unknown)), F.when(event & split, row(1, "LINE_TO", at("x"), at("y"), at("z"), unknown)), F.when(event, row(2, "SET_POWER", null, null, null, F.col("enter")))))
    new = both.select("job_id", F.coalesce("seq", "under.seq").alias("seq"), "d", "kind", F.inline(emitted))
    power = df.select("job_id", "seq", F.coalesce(ffill(F.when(is_("SET_POWER"), F.col("val")), by_job()), F.lit(0.0)).alias("power"))
    new = new.join(power, ["job_id", "seq"]).withColumn("val", F.when(F.col("enter").isNotNull(), F.when(F.col("enter"), F.col("power") * share).otherwise(F.col("power"))))
    gone = own.select("job_id", "seq").distinct()
    kept = df.join(gone, ["job_id", "seq"], "left_anti").select("job_id", "seq", "cmd", "x", "y", "z", "val", F.lit(-1.0).alias("d"), F.lit(0).alias("kind"), F.lit(0).alias("k"))
    rows = kept.unionByName(new.select("job_id", "seq", "cmd", "x", "y", "z", "val", "d", "kind", "k"))
    part = F.row_number().over(Window.partitionBy("job_id", "seq").orderBy("d", "kind", "k")) - 1
    return rows.select("job_id", "seq", part.alias("part"), "cmd", "x", "y", "z", "val")


# Queries and their SQL ----------------------------------------------------------------------------------------------


def _tabs(df: DataFrame) -> DataFrame:
    """Tabs beside the ends of some cuts."""
    some = df.filter(is_moving() & (F.col("seq") % 3 == 1))
    return some.select((F.col("job_id") * 1_000_000 + F.col("seq")).alias("tab_id"), "job_id", (F.col("x") + 0.37).alias("x"), (F.col("y") - 0.21).alias("y"), (F.col("seq") % 4 * 0.5 + 1.25).alias("width"))


QUERIES = {"tab_power": lambda spark, sf_dir: rounded(with_tab_power(df := table(spark, sf_dir, "curves"), _tabs(df), 0.3, 2.0, 0.5))}
_J = "OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
_D = "PARTITION BY job_id, line ORDER BY d, kind"
ORACLE_SQL = {
    "tab_power": f"""{_LINES.replace("(row_number() OVER (PARTITION BY job_id ORDER BY seq, part) - 1)::BIGINT AS seq", "seq, part, " + _MOVE + " AS mv")},
 ma AS (SELECT *, coalesce(cmd IN ('OPS_SECTION_START', 'OPS_SECTION_END') AND section_type = 'VECTOR_OUTLINE', false) AS edge, coalesce(last_value(CASE WHEN section_type = 'VECTOR_OUTLINE' THEN cmd = 'OPS_SECTION_START' END IGNORE NULLS) {_J}, false) AS v,
  coalesce(last_value(CASE WHEN cmd = 'SET_POWER' THEN val END IGNORE NULLS) {_J}, 0) AS power FROM curves),
 mb AS (SELECT job_id, seq, power, v AND NOT edge AS ins, sum(CASE WHEN cmd = 'MOVE_TO' AND v AND NOT edge OR edge THEN 1 ELSE 0 END) {_J} AS line FROM ma),
 pa AS (SELECT l.*, line, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lag(z) OVER w AS az, first_value(l.cmd) OVER w AS head FROM l JOIN mb ON mb.job_id = l.job_id AND mb.seq = l.seq WHERE mv AND ins WINDOW w AS (PARTITION BY l.job_id, line ORDER BY l.seq, part)),
 pb AS (SELECT *, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) AS len FROM pa WHERE head = 'MOVE_TO' AND cmd <> 'MOVE_TO'),
 pc AS (SELECT job_id, line, seq, ax, ay, az, x AS bx, y AS by_, z AS bz, row_number() OVER w - 1 AS "at", sum(len) OVER (PARTITION BY job_id, line ORDER BY seq, part ROWS UNBOUNDED PRECEDING) AS e1, len FROM pb WHERE len >= 1e-9 WINDOW w AS (PARTITION BY job_id, line ORDER BY seq, part)),
 pd AS (SELECT *, e1 - len AS e0 FROM pc),
 tb AS (SELECT job_id * 1000000 + seq AS tab_id, job_id, x + 0.37::DOUBLE AS x, y - 0.21::DOUBLE AS y, seq % 4 * 0.5::DOUBLE + 1.25::DOUBLE AS width FROM curves WHERE {_MOVE} AND seq % 3 = 1),
 ta AS (SELECT tab_id, width, x, y, pd.*, CASE WHEN (bx - ax) ** 2 + (by_ - ay) ** 2 < 1e-18 THEN 0 ELSE least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) END AS t FROM tb JOIN pd ON pd.job_id = tb.job_id),
 td AS (SELECT *, (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2 AS d2 FROM ta),
 tn AS (SELECT *, e0 + t * (e1 - e0) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY d2, line, "at") AS i FROM td) WHERE i = 1 AND d2 <= 4 * width * width),
 wh AS (SELECT job_id, line, max(e1) AS total, sqrt((arg_max(bx, "at") - arg_min(ax, "at")) ** 2 + (arg_max(by_, "at") - arg_min(ay, "at")) ** 2) < 1e-6 AS closed FROM pd GROUP BY ALL),
 tu AS (SELECT tn.job_id, tn.line, least(greatest(mid - width / 2 + k * total, 0), total) AS g0, least(greatest(mid + width / 2 + k * total, 0), total) AS g1 FROM tn JOIN wh ON wh.job_id = tn.job_id AND wh.line = tn.line, range(-1, 2) r(k) WHERE closed OR k = 0),
 tr AS (SELECT *, coalesce(g0 > max(g1) OVER (PARTITION BY job_id, line ORDER BY g0, g1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9, true) AS fresh FROM tu WHERE g1 > g0 + 1e-9),
 ts AS (SELECT job_id, line, min(g0) AS g0, max(g1) AS g1 FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY job_id, line ORDER BY g0, g1 ROWS UNBOUNDED PRECEDING) AS run FROM tr) GROUP BY job_id, line, run),
 ow AS (SELECT * FROM pd WHERE (job_id, line) IN (SELECT (job_id, line) FROM ts)),
 ba AS (SELECT job_id, line, e1 AS d, 0 AS kind, bx AS x, by_ AS y, bz AS z, seq, {{'ax': ax, 'ay': ay, 'az': az, 'bx': bx, 'cy': by_, 'bz': bz, 'e0': e0, 'e1': e1, 'seq': seq}} AS piece, NULL::BOOLEAN AS enter FROM ow
  UNION ALL SELECT job_id, line, g0, 1, NULL, NULL, NULL, NULL, NULL, true FROM ts UNION ALL SELECT job_id, line, g1, 1, NULL, NULL, NULL, NULL, NULL, false FROM ts),
 bb AS (SELECT *, last_value(piece IGNORE NULLS) OVER ({_D} ROWS UNBOUNDED PRECEDING) AS las, first_value(piece IGNORE NULLS) OVER ({_D} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nex FROM ba),
 bc AS (SELECT *, coalesce(d - las.e1 < 1e-9, false) AS onc FROM bb), bd AS (SELECT *, CASE WHEN onc OR nex IS NULL THEN las ELSE nex END AS u FROM bc), be AS (SELECT *, (d - u.e0) / (u.e1 - u.e0) AS t FROM bd),
 nw AS (SELECT job_id, seq, d, kind, 0 AS k, 'LINE_TO' AS cmd, x, y, z, enter FROM be WHERE kind = 0 UNION ALL SELECT job_id, u.seq, d, kind, 1, 'LINE_TO', u.ax + t * (u.bx - u.ax), u.ay + t * (u.cy - u.ay), u.az + t * (u.bz - u.az), NULL FROM be WHERE kind = 1 AND NOT onc AND nex IS NOT NULL AND d > 1e-9
  UNION ALL SELECT job_id, u.seq, d, kind, 2, 'SET_POWER', NULL, NULL, NULL, enter FROM be WHERE kind = 1),
 al AS (SELECT job_id, seq, cmd, x, y, z, val, -1 AS d, 0 AS kind, 0 AS k FROM curves WHERE (job_id, seq) NOT IN (SELECT (job_id, seq) FROM ow) UNION ALL
  SELECT nw.job_id, nw.seq, cmd, x, y, z, CASE WHEN enter THEN power * 0.3::DOUBLE WHEN NOT enter THEN power END, d, kind, k FROM nw JOIN mb ON mb.job_id = nw.job_id AND mb.seq = nw.seq)
 SELECT job_id, seq, (row_number() OVER (PARTITION BY job_id, seq ORDER BY d, kind, k) - 1)::INT AS part, cmd, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(val, 6) AS val FROM al""",
}
