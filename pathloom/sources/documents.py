"""Command documents in and out: JSON, point lists, segments, columnar form and machine-code text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.loops import shared_folder
from pathloom.functions.windows import ordered, so_far
from pathloom.operators import commands as ops
from pathloom.operators.commands import by_job, is_, is_moving, rounded
from pathloom.sources.derive import cte, table

#: Schema of a command document.
DOCUMENT = "commands array<struct<type:string,`end`:array<double>,center_offset:array<double>,clockwise:boolean,value:double,text:string,section_type:string,control:array<double>,power_values:array<int>>>, last_move_to array<double>"
#: Type codes of the columnar form.
CODES = {
    "MOVE_TO": 1, "LINE_TO": 2, "ARC_TO": 3, "SCAN_LINE": 4, "DWELL": 5, "BEZIER_TO": 6, "QUADRATIC_BEZIER_TO": 7, "SET_POWER": 10, "SET_FEED_RATE": 11, "SET_RAPID_RATE": 12,
    "SET_HEAD": 15, "SET_FREQUENCY": 16, "SET_PULSE_WIDTH": 17, "SET_SPINDLE_RPM": 18, "SET_COOLANT": 20, "SET_AIR_ASSIST": 21, "SET_HEAD_COOLANT": 22, "SET_POWER_MODE": 23,
    "SET_SPINDLE_DIRECTION": 24, "SET_SYNC_PITCH": 25, "CUSTOM": 30, "JOB_START": 100, "JOB_END": 101, "LAYER_START": 102, "LAYER_END": 103, "WORKPIECE_START": 104, "WORKPIECE_END": 105,
    "OPS_SECTION_START": 106, "OPS_SECTION_END": 107, "STATE_BLOCK_START": 108, "STATE_BLOCK_END": 109,
}
#: Columns of the narrow queries, and buckets of the partitioned form.
BUCKETS = 16
SQL_COLUMNS = ("job_id", "seq", "cmd", "x", "y", "z", "ci", "cj", "cw", "val")
#: Columns that a table of commands may lack: control points of curves, three numbers each, and power values of scanlines.
SIDE = {"sval": "string", "section_type": "string", "control": "array<double>", "power_values": "array<int>"}


def _sides(df: DataFrame) -> DataFrame:
    return df.withColumns({c: (F.col(c) if c in df.columns else F.lit(None)).cast(t) for c, t in SIDE.items()})


def to_documents(df: DataFrame) -> DataFrame:
    """One JSON document per job: ``job_id, document``."""
    row = F.struct(
        F.col("cmd").alias("type"), F.when(is_moving(), F.array("x", "y", "z")).alias("end"), F.when(is_("ARC_TO"), F.array("ci", "cj")).alias("center_offset"),
        F.col("cw").alias("clockwise"), F.col("val").alias("value"), F.col("sval").alias("text"), "section_type", "control", "power_values",
    )
    per = _sides(df).groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("seq", row.alias("c")))).alias("s"), F.max_by(F.array("x", "y", "z"), F.when(is_("MOVE_TO"), F.col("seq"))).alias("last_move_to"))
    return per.select("job_id", F.to_json(F.struct(F.transform("s", lambda r: r["c"]).alias("commands"), "last_move_to")).alias("document"))


def from_documents(documents: DataFrame) -> DataFrame:
    """Rows of JSON documents ``(job_id, document)``, in order."""
    rows = documents.select("job_id", F.from_json("document", DOCUMENT).alias("d")).select("job_id", F.posexplode("d.commands").alias("seq", "c"))
    at = lambda name, i: F.get(F.col(f"c.{name}"), F.lit(i))
    return rows.select(
        "job_id", F.col("seq").cast("long").alias("seq"), F.col("c.type").alias("cmd"), at("end", 0).alias("x"), at("end", 1).alias("y"), at("end", 2).alias("z"),
        at("center_offset", 0).alias("ci"), at("center_offset", 1).alias("cj"), F.col("c.clockwise").alias("cw"), F.col("c.value").alias("val"),
        F.col("c.text").alias("sval"), "c.section_type", "c.control", "c.power_values",
    )


def columnar(df: DataFrame) -> DataFrame:
    """Type code (0 for an unknown type), end point, all further columns and a bucket of the job for partitioned files."""
    return _sides(df).select("job_id", "seq", _code(CODES), *SQL_COLUMNS[3:], *SIDE, bucket_of().alias("bucket"))


def bucket_of(job: Column | str = "job_id", buckets: int = BUCKETS) -> Column:
    """The bucket of a job: null ids have the first one."""
    return F.coalesce(F.pmod(F.col(job) if isinstance(job, str) else job, F.lit(buckets)), F.lit(0))


def write_columnar(df: DataFrame, path: str, block_rows: int = 1_000_000) -> None:
    """The columnar form as Parquet below ``path``, a folder for each bucket, rows of a file in order.

    Rows are dealt by bucket and block of ``seq``, so a bucket or a job of any size is as many tasks and files as it needs.
    """
    rows = columnar(df).withColumn("__block", F.floor(F.col("seq") / block_rows))
    rows.repartition("bucket", "__block").sortWithinPartitions("job_id", "seq").drop("__block").write.partitionBy("bucket").parquet(path)


def read_columnar(spark: SparkSession, path: str, jobs: list[int] | None = None) -> DataFrame:
    """Rows of the columnar form; of ``jobs`` only where given: folders of other buckets are not read."""
    rows = spark.read.parquet(path)
    if jobs is None:
        return rows
    return rows.filter(F.col("bucket").isin(sorted({j % BUCKETS for j in jobs})) & F.col("job_id").isin(jobs))


def _code(codes: dict[str, int]) -> Column:
    code = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, v)])
    return F.coalesce(F.element_at(code, F.col("cmd")), F.lit(0)).alias("code")


def narrow_columnar(df: DataFrame) -> DataFrame:
    """Type codes and end points only."""
    return df.select("job_id", "seq", _code(CODES), "x", "y", "z", bucket_of().alias("bucket"))


def from_points(points: DataFrame, close: bool) -> DataFrame:
    """Vertex lists ``(ring_id, seq, x, y)`` as a travel and lines, with a line back to the start on demand."""
    w = ordered("ring_id")
    rows = points.select("ring_id", (F.row_number().over(w) - 1).alias("seq"), "x", "y")
    if close:
        ends = rows.groupBy("ring_id").agg(F.min_by("x", "seq").alias("x"), F.min_by("y", "seq").alias("y"), (F.max("seq") + 1).alias("seq"))
        rows = rows.unionByName(ends.select("ring_id", "seq", "x", "y"))
    return rows.withColumn("cmd", F.when(F.col("seq") == 0, "MOVE_TO").otherwise("LINE_TO"))


def point_lists(df: DataFrame) -> DataFrame:
    """The ends of moves of each subpath as one ordered list of ``x y z`` strings with its size."""
    rows = ops.with_subpaths(df).filter(is_moving())
    per = rows.groupBy("job_id", "subpath").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("s"))
    text = F.array_join(F.transform("s", lambda p: F.concat_ws(" ", *[number(p[c], 3) for c in "xyz"])), ";")
    return per.select("job_id", "subpath", F.size("s").alias("n"), text.alias("points"))


def segments(df: DataFrame) -> DataFrame:
    """Moves as segments with their class: travel, powered or zero power. The first travel of a job has no start."""
    rows = ops.with_state(ops.with_previous(df)).filter(is_moving() & F.col("px").isNotNull())
    kind = F.when(is_("MOVE_TO"), "travel").when(F.col("power") > 0, "powered").otherwise("zero_power")
    return rows.select("job_id", "seq", kind.alias("kind"), *[F.col(f"p{c}").alias(f"{c}0") for c in "xyz"], *[F.col(c).alias(f"{c}1") for c in "xyz"])


def number(value: Column, digits: int) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", value + F.lit(0.0)), r"\.?0+$", "") if digits else F.format_string("%.0f", value)


def machine_code(df: DataFrame, digits: int = 3) -> DataFrame:
    """Text lines of each command, null for those that give none: a coordinate that stays is left out, unless all do.

    A travel to where the machine already is gives no line, once a move has set the place.
    """
    rows = ops.with_previous(df)
    stays = {c: F.coalesce(F.abs(F.col(c) - F.coalesce(f"p{c}", F.lit(0.0))) <= 1e-12, F.lit(False)) for c in "xyz"}
    none = stays["x"] & stays["y"] & stays["z"]
    coords = [F.when(~stays["x"] | none, F.concat(F.lit("X"), number(F.col("x"), digits)))] + [F.when(~stays[c], F.concat(F.lit(c.upper()), number(F.col(c), digits))) for c in "yz"]
    arc = [F.concat(F.lit("I"), number(F.col("ci"), digits)), F.concat(F.lit("J"), number(F.col("cj"), digits))]
    line = (
        F.when(is_("MOVE_TO"), F.when(~(none & F.col("px").isNotNull()), F.concat_ws(" ", F.lit("G0"), *coords)))
        .when(is_("LINE_TO"), F.concat_ws(" ", F.lit("G1"), *coords))
        .when(is_("ARC_TO"), F.concat_ws(" ", F.when(F.col("cw"), "G2").otherwise("G3"), *coords, *arc))
        .when(is_("SET_POWER"), F.concat(F.lit("M4 S"), number(F.col("val") * 1000, 0)))
        .when(is_("SET_FEED_RATE"), F.concat(F.lit("F"), number(F.col("val"), 0)))
        .when(is_("DWELL"), F.concat(F.lit("G4 P"), number(F.col("val") / 1000, digits)))
    )
    return rows.select("job_id", "seq", line.alias("line"))


def line_map(lines: DataFrame) -> DataFrame:
    """First line and number of lines of each command."""
    n = F.col("line").isNotNull().cast("int")
    return lines.select("job_id", "seq", (F.sum(n).over(so_far(by_job())) - n).alias("first_line"), n.alias("n_lines"))


def lines_to_commands(ranges: DataFrame) -> DataFrame:
    """The command of each line."""
    spans = ranges.filter("n_lines > 0")
    return spans.select("job_id", F.explode(F.sequence("first_line", F.col("first_line") + F.col("n_lines") - 1)).alias("line_no"), "seq")


def _q(f, name="commands"):
    return lambda spark, sf_dir: rounded(f(table(spark, sf_dir, name)))


def _one_bucket(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Jobs of one bucket, from the partitioned form of all of them."""
    path = shared_folder(spark)
    write_columnar(df, path)
    return rounded(spark.read.parquet(path).filter(F.col("bucket") == 3).select("job_id", "seq", "code", "x", "y", "z", "val", "sval", F.col("bucket").cast("long").alias("bucket")))


QUERIES = {
    "document_round_trip": _q(lambda d: from_documents(to_documents(d)).select(*SQL_COLUMNS)),
    "document_round_trip_whole": _q(lambda d: from_documents(to_documents(d))),
    "columnar_commands": _q(narrow_columnar),
    "columnar_bucket": lambda spark, sf_dir: _one_bucket(spark, table(spark, sf_dir, "commands")),
    "columnar_commands_whole": _q(columnar),
    "rings_to_commands": _q(lambda r: from_points(r, True), "rings"),
    "point_lists": _q(point_lists),
    "segment_classes": _q(segments),
    "machine_code": _q(machine_code),
    "line_map": _q(lambda d: line_map(machine_code(d))),
    "line_to_command": _q(lambda d: lines_to_commands(line_map(machine_code(d)))),
}
_C, J, MOVE, _lag = cte("commands"), ops.J, ops.MOVE_SQL, ops._lag
_NUM = lambda v, d: f"regexp_replace(printf('%.{d}f', ({v})::DOUBLE), '\\.?0+$', '')" if d else f"printf('%.0f', ({v})::DOUBLE)"
_SAME = {c: f"coalesce(abs({c} - coalesce(p{c}, 0)) <= 1e-12, false)" for c in "xyz"}
_XYZ = f"CASE WHEN NOT {_SAME['x']} OR ({' AND '.join(_SAME.values())}) THEN 'X' || {_NUM('x', 3)} END, CASE WHEN NOT {_SAME['y']} THEN 'Y' || {_NUM('y', 3)} END, CASE WHEN NOT {_SAME['z']} THEN 'Z' || {_NUM('z', 3)} END"
_CODE = f"""{_C}, p AS (SELECT *, {_lag('x')} AS px, {_lag('y')} AS py, {_lag('z')} AS pz FROM commands),
 code AS (SELECT job_id, seq, CASE cmd WHEN 'MOVE_TO' THEN CASE WHEN NOT ({' AND '.join(_SAME.values())} AND px IS NOT NULL) THEN concat_ws(' ', 'G0', {_XYZ}) END
 WHEN 'LINE_TO' THEN concat_ws(' ', 'G1', {_XYZ}) WHEN 'ARC_TO' THEN concat_ws(' ', CASE WHEN cw THEN 'G2' ELSE 'G3' END, {_XYZ}, 'I' || {_NUM('ci', 3)}, 'J' || {_NUM('cj', 3)})
 WHEN 'SET_POWER' THEN 'M4 S' || {_NUM('val * 1000', 0)} WHEN 'SET_FEED_RATE' THEN 'F' || {_NUM('val', 0)} WHEN 'DWELL' THEN 'G4 P' || {_NUM('val / 1000', 3)} END AS line FROM p),
 map AS (SELECT job_id, seq, count(line) {J} ROWS UNBOUNDED PRECEDING) - (line IS NOT NULL)::INT AS first_line, (line IS NOT NULL)::INT AS n_lines FROM code)"""
_REST = ", ".join(f"round({c}, 6) AS {c}" for c in ("x", "y", "z", "ci", "cj", "val")) + ", cw, sval, section_type, NULL AS control, NULL AS power_values"
ORACLE_SQL = {
    "document_round_trip": f"{_C} SELECT job_id, seq, cmd, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(ci, 6) AS ci, round(cj, 6) AS cj, cw, round(val, 6) AS val FROM commands",
    "columnar_bucket": f"{_C} SELECT job_id, seq, CASE cmd {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in CODES.items())} ELSE 0 END AS code, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(val, 6) AS val, sval, job_id % 16 AS bucket FROM commands WHERE job_id % 16 = 3",
    "columnar_commands": f"{_C} SELECT job_id, seq, CASE cmd {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in CODES.items())} ELSE 0 END AS code, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, job_id % 16 AS bucket FROM commands",
    "document_round_trip_whole": f"{_C} SELECT job_id, seq, cmd, {_REST} FROM commands",
    "columnar_commands_whole": f"""{_C} SELECT job_id, seq, CASE cmd WHEN 'MOVE_TO' THEN 1 WHEN 'LINE_TO' THEN 2 WHEN 'ARC_TO' THEN 3 WHEN 'DWELL' THEN 5 WHEN 'SET_POWER' THEN 10 WHEN 'SET_FEED_RATE' THEN 11
 WHEN 'SET_RAPID_RATE' THEN 12 WHEN 'SET_SPINDLE_RPM' THEN 18 WHEN 'SET_COOLANT' THEN 20 WHEN 'SET_SYNC_PITCH' THEN 25 WHEN 'LAYER_START' THEN 102 WHEN 'LAYER_END' THEN 103 WHEN 'OPS_SECTION_START' THEN 106
 WHEN 'OPS_SECTION_END' THEN 107 WHEN 'SET_HEAD' THEN 15 WHEN 'SET_FREQUENCY' THEN 16 WHEN 'SET_PULSE_WIDTH' THEN 17 WHEN 'SET_AIR_ASSIST' THEN 21 WHEN 'SET_HEAD_COOLANT' THEN 22
 WHEN 'SET_POWER_MODE' THEN 23 WHEN 'SET_SPINDLE_DIRECTION' THEN 24 WHEN 'WORKPIECE_START' THEN 104 WHEN 'WORKPIECE_END' THEN 105 END AS code, {_REST}, job_id % 16 AS bucket FROM commands""",
    "rings_to_commands": f"""{cte('rings')}, u AS (SELECT ring_id, seq, x, y FROM rings UNION ALL SELECT ring_id, max(seq) + 1, arg_min(x, seq), arg_min(y, seq) FROM rings GROUP BY ring_id)
 SELECT ring_id, seq, round(x, 6) AS x, round(y, 6) AS y, CASE seq WHEN 0 THEN 'MOVE_TO' ELSE 'LINE_TO' END AS cmd FROM u""",
    "point_lists": f"""{_C}, s AS (SELECT *, greatest(count(*) FILTER (cmd = 'MOVE_TO') {J} ROWS UNBOUNDED PRECEDING) - 1, 0) AS subpath FROM commands)
 SELECT job_id, subpath, count(*)::INT AS n, string_agg({_NUM('x', 3)} || ' ' || {_NUM('y', 3)} || ' ' || {_NUM('z', 3)}, ';' ORDER BY seq) AS points FROM s WHERE {MOVE} GROUP BY ALL""",
    "segment_classes": f"""{_C}, p AS (SELECT *, {_lag('x')} AS px, {_lag('y')} AS py, {_lag('z')} AS pz, coalesce({ops._set('SET_POWER')}, 0) AS power FROM commands)
 SELECT job_id, seq, CASE WHEN cmd = 'MOVE_TO' THEN 'travel' WHEN power > 0 THEN 'powered' ELSE 'zero_power' END AS kind, round(px, 6) AS x0, round(py, 6) AS y0, round(pz, 6) AS z0, round(x, 6) AS x1, round(y, 6) AS y1, round(z, 6) AS z1 FROM p WHERE {MOVE} AND px IS NOT NULL""",
    "machine_code": f"{_CODE} SELECT * FROM code",
    "line_map": f"{_CODE} SELECT * FROM map",
    "line_to_command": f"{_CODE} SELECT job_id, first_line AS line_no, seq FROM map WHERE n_lines = 1",
}
