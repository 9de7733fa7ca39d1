"""Named state blocks of sections, and crossings of paths with themselves and with others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.geometry import INTERSECT, hypot
from pathloom.functions.grid import in_cells, joined
from pathloom.functions.loops import saved
from pathloom.functions.windows import ordered, so_far
from pathloom.operators import commands as ops
from pathloom.operators.commands import is_, is_moving, rounded
from pathloom.operators.curves import _LINES, _MOVE
from pathloom.operators.rings import edges
from pathloom.operators.transforms import linearized
from pathloom.sources.derive import cte, table

START, END = "STATE_BLOCK_START", "STATE_BLOCK_END"


def _in_sections(df: DataFrame) -> DataFrame:
    """Rows of sections that have a type, with the running depth of their blocks."""
    rows = ops.with_sections(df).filter(F.col("open_section").isNotNull())
    w = so_far(ordered("job_id", "section"))
    step = F.when(is_(START), 1).when(is_(END), -1).otherwise(0)
    return rows.withColumns({"depth": F.sum(step).over(w), "block": F.sum(is_(START).cast("int")).over(w)})


def block_errors(df: DataFrame) -> DataFrame:
    """What is wrong with the blocks of a section: ``job_id, section, seq, error``. A block that starts in another one is
    nested, an end without a start unmatched, and one still open at the section's end unclosed (``seq`` is the section's last row)."""
    rows = _in_sections(df)
    here = rows.filter(is_(START) & (F.col("depth") > 1) | is_(END) & (F.col("depth") < 0)).select("job_id", "section", "seq", F.when(is_(START), "nested").otherwise("unmatched").alias("error"))
    last = rows.groupBy("job_id", "section").agg(F.max_by("depth", "seq").alias("depth"), F.max("seq").alias("seq"))
    return here.unionByName(last.filter("depth > 0").select("job_id", "section", "seq", F.lit("unclosed").alias("error")))


def state_blocks(df: DataFrame) -> DataFrame:
    """Blocks of sections without an error: ``job_id, section, block, name, first, last, n_content, n_moves``; ``first`` and ``last``
    are the rows of its start and end. One window gives the running depth, so a section with errors drops out by an aggregate."""
    rows = _in_sections(df)
    whole = Window.partitionBy("job_id", "section")
    rows = rows.withColumns({"__bad": F.max((~F.col("depth").isin(0, 1)).cast("int")).over(whole), "__open": F.max_by("depth", "seq").over(whole)})
    own = rows.filter("__bad = 0 and __open = 0 and block > 0").filter((F.col("depth") == 1) | is_(END))
    edge = is_(START, END)
    return own.groupBy("job_id", "section", "block").agg(
        F.min_by("sval", "seq").alias("name"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_if(~edge).alias("n_content"), F.count_if(is_moving()).alias("n_moves"),
    )


def blocks_named(blocks: DataFrame, pattern: str) -> DataFrame:
    """Blocks of that name; with ``*`` at its end, those whose name starts so. Blocks without a name match nothing."""
    name = F.col("name")
    return blocks.filter(name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern)


# Crossings ----------------------------------------------------------------------------------------------------------


def path_segments(df: DataFrame, resolution: float = 1.0, tolerance: float = 0.01) -> DataFrame:
    """Straight pieces of the cuts of commands: ``job_id, subpath, seq, k, part, ax, ay, bx, by, ex, ey``; arcs and curves by their
    chords. ``k`` counts a job's moving commands, ``ex, ey`` is the command's end."""
    moves = df.filter(is_moving())
    rows = linearized(moves, resolution, tolerance)
    w = Window.partitionBy("job_id").orderBy("seq", "part")
    whole = Window.partitionBy("job_id", "seq").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    travel = F.sum(is_("MOVE_TO").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({
        "ax": F.coalesce(F.lag("x").over(w), F.lit(0.0)), "ay": F.coalesce(F.lag("y").over(w), F.lit(0.0)), "subpath": F.greatest(travel - 1, F.lit(0)),
        "k": F.dense_rank().over(Window.partitionBy("job_id").orderBy("seq")), "ex": F.last("x").over(whole), "ey": F.last("y").over(whole),
    })
    return rows.filter(~is_("MOVE_TO")).select("job_id", "subpath", "seq", "k", "part", "ax", "ay", F.col("x").alias("bx"), F.col("y").alias("by"), "ex", "ey")


def ring_segments(rings: DataFrame) -> DataFrame:
    """The same pieces of rings: ``geom_id, ring_id, seq, k, part, ..``."""
    rows = edges(rings).withColumn("k", F.row_number().over(ordered("geom_id", "ring_id")))
    return rows.select("geom_id", "ring_id", "seq", "k", F.lit(1).alias("part"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"), F.col("nx").alias("ex"), F.col("ny").alias("ey"))


def meetings(ours: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of pieces of equal ``keys`` that meet, ends included and parallel ones not, once each: all columns of the one, those
    of the other with ``o_`` in front, and the place ``mx, my``. Cells are as large as the mean piece; pieces are made once and saved."""
    ours = saved(ours)
    size = max(1e-6, ours.agg(F.avg(hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))).first()[0] or 1.0)
    box = lambda df, o: in_cells(df, F.least(f"{o}ax", f"{o}bx"), F.least(f"{o}ay", f"{o}by"), F.greatest(f"{o}ax", f"{o}bx"), F.greatest(f"{o}ay", f"{o}by"), size)
    other = ours.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ours.columns if c not in keys])
    pairs = joined(box(ours, ""), box(other, "o_"), *keys)
    ax, ay, bx, by, cx, cy, dx, dy = (F.col(c) for c in ("ax", "ay", "bx", "by", "o_ax", "o_ay", "o_bx", "o_by"))
    den = (ax - bx) * (cy - dy) - (ay - by) * (cx - dx)
    safe = F.nullif(den, F.lit(0.0))
    t = ((ax - cx) * (cy - dy) - (ay - cy) * (cx - dx)) / safe
    u = -((ax - bx) * (ay - cy) - (ay - by) * (ax - cx)) / safe
    # as a generated row, so that the optimizer does not copy these into every use of them in the join's condition
    met = pairs.select("*", F.inline(F.array(F.struct(F.abs(den).alias("__den"), t.alias("__t"), u.alias("__u")))))
    met = met.filter((F.col("__den") >= 1e-9) & F.col("__t").between(0, 1) & F.col("__u").between(0, 1))
    return met.withColumns({"mx": ax + (bx - ax) * F.col("__t"), "my": ay + (by - ay) * F.col("__t")}).drop("__den", "__t", "__u")


def self_crossings(pieces: DataFrame, keys: list[str], touching: bool = False) -> DataFrame:
    """Where a path ``(keys, seq, k, part, ..)`` meets itself: pairs of commands ``keys, seq, other_seq``, the first before the second.

    Pieces of one command do not count, nor does the point that a command shares with the next one. Elsewhere a meeting
    at an end of a piece counts only where ``touching``.
    """
    met = meetings(pieces, keys).filter("k < o_k")
    near = lambda x, y: (F.col("mx") - F.col(x)) ** 2 + (F.col("my") - F.col(y)) ** 2 < INTERSECT
    at_end = near("ax", "ay") | near("bx", "by") | near("o_ax", "o_ay") | near("o_bx", "o_by")
    counts = F.when(F.col("o_k") == F.col("k") + 1, ~near("ex", "ey")).otherwise(F.lit(True) if touching else ~at_end)
    return met.filter(counts).select(*keys, "seq", F.col("o_seq").alias("other_seq")).distinct()


def path_meetings(pieces: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Pairs of different paths of equal ``keys`` that meet anywhere, their ends included: ``keys, path, other``."""
    rows = pieces.select(*keys, path, "ax", "ay", "bx", "by")
    return meetings(rows, keys).filter(F.col(path) < F.col(f"o_{path}")).select(*keys, path, F.col(f"o_{path}").alias("other")).distinct()


# Queries and their SQL ----------------------------------------------------------------------------------------------


def _bow_ties(rings: DataFrame) -> DataFrame:
    """Every third ring with two neighbours exchanged, so that it crosses itself."""
    seq = F.when(F.col("ring_id") % 3 == 0, F.when(F.col("seq") == 1, 2).when(F.col("seq") == 2, 1).otherwise(F.col("seq"))).otherwise(F.col("seq"))
    return rings.withColumn("seq", seq)


def _q(f, name: str):
    return lambda spark, sf_dir: rounded(f(table(spark, sf_dir, name)))


QUERIES = {
    "state_blocks": _q(state_blocks, "blocks"),
    "block_errors": _q(block_errors, "blocks"),
    "blocks_named": _q(lambda d: blocks_named(state_blocks(d), "pre-1*"), "blocks"),
    "ring_self_crossings": _q(lambda r: self_crossings(ring_segments(_bow_ties(r)), ["geom_id", "ring_id"]), "rings"),
    "path_self_crossings": _q(lambda d: self_crossings(path_segments(d, 2.0, 0.5), ["job_id", "subpath"]), "curves"),
    "path_meetings": _q(lambda d: path_meetings(path_segments(d, 2.0, 0.5), ["job_id"], "subpath"), "curves"),
}
_RUN = "OVER (PARTITION BY job_id, section ORDER BY seq ROWS UNBOUNDED PRECEDING)"
_BLOCKS = f"""{cte('blocks')}, s AS (SELECT *, count(*) FILTER (cmd = 'OPS_SECTION_START') {ops.J} ROWS UNBOUNDED PRECEDING) + count(*) FILTER (cmd = 'OPS_SECTION_END') {ops.J} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section,
  {ops._SECTION_SQL} AS open_section FROM blocks),
 d AS (SELECT *, sum(CASE cmd WHEN 'STATE_BLOCK_START' THEN 1 WHEN 'STATE_BLOCK_END' THEN -1 ELSE 0 END) {_RUN} AS depth, count(*) FILTER (cmd = 'STATE_BLOCK_START') {_RUN} AS block FROM s WHERE open_section IS NOT NULL),
 g AS (SELECT *, max(CASE WHEN depth NOT IN (0, 1) THEN 1 ELSE 0 END) OVER w AS bad, arg_max(depth, seq) OVER w AS fin FROM d WINDOW w AS (PARTITION BY job_id, section)),
 bl AS (SELECT job_id, section, block, arg_min(sval, seq) FILTER (cmd = 'STATE_BLOCK_START') AS name, min(seq) AS first, max(seq) AS last, count(*) FILTER (cmd NOT IN ('STATE_BLOCK_START', 'STATE_BLOCK_END')) AS n_content, count(*) FILTER ({ops.MOVE_SQL}) AS n_moves
  FROM g WHERE bad = 0 AND fin = 0 AND block > 0 AND (depth = 1 OR cmd = 'STATE_BLOCK_END') GROUP BY ALL)"""
_PIECES = f"""{_LINES.replace("(row_number() OVER (PARTITION BY job_id ORDER BY seq, part) - 1)::BIGINT AS seq", "seq, part, " + _MOVE + " AS mv")}, li AS (SELECT * FROM l WHERE mv),
 sb AS (SELECT job_id, seq, part, x AS bx, y AS by_, cmd, coalesce(lag(x) OVER w, 0) AS ax, coalesce(lag(y) OVER w, 0) AS ay, greatest(count(*) FILTER (cmd = 'MOVE_TO') OVER (PARTITION BY job_id ORDER BY seq, part ROWS UNBOUNDED PRECEDING) - 1, 0) AS subpath,
  dense_rank() OVER (PARTITION BY job_id ORDER BY seq) AS k, last_value(x) OVER v AS ex, last_value(y) OVER v AS ey FROM li
  WINDOW w AS (PARTITION BY job_id ORDER BY seq, part), v AS (PARTITION BY job_id, seq ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 sg AS (SELECT * FROM sb WHERE cmd <> 'MOVE_TO')"""
_DEN = "((a.ax - a.bx) * (o.ay - o.by_) - (a.ay - a.by_) * (o.ax - o.bx))"
_PAIRS = f"""me AS (SELECT a.*, o.k AS ok, o.seq AS oseq, o.subpath AS osub, o.ax AS ox, o.ay AS oy, o.bx AS px, o.by_ AS py, ((a.ax - o.ax) * (o.ay - o.by_) - (a.ay - o.ay) * (o.ax - o.bx)) / {_DEN} AS t,
  -((a.ax - a.bx) * (a.ay - o.ay) - (a.ay - a.by_) * (a.ax - o.ax)) / {_DEN} AS u FROM sg a JOIN sg o ON {{on}} AND abs({_DEN}) >= 1e-9 AND a.k < o.k
  AND least(a.ax, a.bx) <= greatest(o.ax, o.bx) AND least(o.ax, o.bx) <= greatest(a.ax, a.bx) AND least(a.ay, a.by_) <= greatest(o.ay, o.by_) AND least(o.ay, o.by_) <= greatest(a.ay, a.by_)),
 mt AS (SELECT *, ax + (bx - ax) * t AS mx, ay + (by_ - ay) * t AS my FROM me WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
 co AS (SELECT *, CASE WHEN ok = k + 1 THEN (mx - ex) ** 2 + (my - ey) ** 2 >= 1e-12 ELSE least((mx - ax) ** 2 + (my - ay) ** 2, (mx - bx) ** 2 + (my - by_) ** 2, (mx - ox) ** 2 + (my - oy) ** 2, (mx - px) ** 2 + (my - py) ** 2) >= 1e-12 END AS counts FROM mt)"""
ORACLE_SQL = {
    "state_blocks": f"{_BLOCKS} SELECT * FROM bl",
    "blocks_named": f"{_BLOCKS} SELECT * FROM bl WHERE starts_with(name, 'pre-1')",
    "block_errors": f"""{_BLOCKS} SELECT job_id, section, seq, CASE cmd WHEN 'STATE_BLOCK_START' THEN 'nested' ELSE 'unmatched' END AS error FROM d WHERE cmd = 'STATE_BLOCK_START' AND depth > 1 OR cmd = 'STATE_BLOCK_END' AND depth < 0
 UNION ALL SELECT job_id, section, max(seq), 'unclosed' FROM d GROUP BY job_id, section HAVING arg_max(depth, seq) > 0""",
    "ring_self_crossings": f"""{cte('rings')}, b0 AS (SELECT geom_id, ring_id, CASE WHEN ring_id % 3 = 0 AND seq IN (1, 2) THEN 3 - seq ELSE seq END AS seq, x, y FROM rings), n AS (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY seq) AS k FROM b0),
 sg AS (SELECT a.geom_id, a.ring_id, a.seq, a.k, 0 AS subpath, a.x AS ax, a.y AS ay, c.x AS bx, c.y AS by_, c.x AS ex, c.y AS ey FROM n a JOIN n c ON c.ring_id = a.ring_id AND c.k = a.k % 4 + 1),
 {_PAIRS.format(on='a.ring_id = o.ring_id')} SELECT DISTINCT geom_id, ring_id, seq, oseq AS other_seq FROM co WHERE counts""",
    "path_self_crossings": f"{_PIECES}, {_PAIRS.format(on='a.job_id = o.job_id AND a.subpath = o.subpath')} SELECT DISTINCT job_id, subpath, seq, oseq AS other_seq FROM co WHERE counts",
    "path_meetings": f"{_PIECES}, {_PAIRS.format(on='a.job_id = o.job_id AND a.subpath <> o.subpath')} SELECT DISTINCT job_id, subpath, osub AS other FROM mt",
}
