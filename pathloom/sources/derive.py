"""Tables of toolpaths, rings, meshes, rasters and logs, derived from the given tables.

Each text is valid in Spark SQL and in DuckDB; only ``pixels`` unpacks its arrays in a dialect of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Derived table -> SQL over the given tables, and which of those it reads.
SQL = {
    "commands": """
WITH e AS (SELECT user_id AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS seq,
  event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
c AS (SELECT job_id, seq, value, k, CASE
  WHEN event_type = 'signup' THEN 'MOVE_TO' WHEN event_type = 'click' THEN 'LINE_TO'
  WHEN event_type = 'view' THEN 'ARC_TO' WHEN event_type = 'purchase' THEN 'SET_POWER'
  WHEN k IN (60, 70) THEN 'SET_AIR_ASSIST' WHEN k = 80 THEN 'SET_FREQUENCY' WHEN k = 90 THEN 'SET_PULSE_WIDTH'
  WHEN k = 74 THEN 'SET_SPINDLE_DIRECTION' WHEN k = 87 THEN 'SET_HEAD_COOLANT' WHEN k = 77 THEN 'SET_HEAD'
  WHEN k = 78 THEN 'SET_POWER_MODE' WHEN k = 81 THEN 'WORKPIECE_START' WHEN k = 82 THEN 'WORKPIECE_END'
  WHEN k % 10 = 0 THEN 'DWELL' WHEN k % 10 = 1 THEN 'LAYER_START' WHEN k % 10 = 2 THEN 'LAYER_END'
  WHEN k % 10 = 3 THEN 'SET_SYNC_PITCH' WHEN k % 10 = 4 THEN 'SET_SPINDLE_RPM'
  WHEN k % 10 = 5 THEN 'OPS_SECTION_START' WHEN k % 10 = 6 THEN 'OPS_SECTION_END'
  WHEN k % 10 = 7 THEN 'SET_COOLANT' WHEN k % 10 = 8 THEN 'SET_RAPID_RATE' ELSE 'SET_FEED_RATE' END AS cmd FROM e)
SELECT job_id, seq, cmd,
  CASE WHEN cmd IN ('MOVE_TO','LINE_TO','ARC_TO') THEN value END AS x,
  CASE WHEN cmd IN ('MOVE_TO','LINE_TO','ARC_TO') THEN CAST(k AS DOUBLE) END AS y,
  CASE WHEN cmd IN ('MOVE_TO','LINE_TO','ARC_TO') THEN CAST(k % 3 AS DOUBLE) END AS z,
  CASE WHEN cmd = 'ARC_TO' THEN k / 10.0e0 + 1.0e0 END AS ci,
  CASE WHEN cmd = 'ARC_TO' THEN value / 10.0e0 END AS cj,
  CASE WHEN cmd = 'ARC_TO' THEN k % 2 = 0 END AS cw,
  CASE WHEN cmd = 'SET_POWER' THEN (k % 5) / 4.0e0 WHEN cmd = 'SET_FEED_RATE' THEN 600.0e0 + 10 * k
       WHEN cmd = 'SET_RAPID_RATE' THEN 3000.0e0 + 10 * k WHEN cmd = 'DWELL' THEN 100.0e0 * k
       WHEN cmd = 'SET_SYNC_PITCH' THEN CASE WHEN k < 50 THEN 0.0e0 ELSE 1.5e0 END
       WHEN cmd = 'SET_SPINDLE_RPM' THEN 20.0e0 * k WHEN cmd = 'SET_FREQUENCY' THEN 1000.0e0 + floor(value)
       WHEN cmd = 'SET_PULSE_WIDTH' THEN value / 10.0e0 END AS val,
  CASE WHEN cmd IN ('LAYER_START','LAYER_END') THEN concat('layer-', CAST(floor(k / 30.0e0) AS INT))
       WHEN cmd IN ('WORKPIECE_START','WORKPIECE_END') THEN concat('piece-', CAST(floor(value / 25.0e0) AS INT))
       WHEN cmd = 'SET_COOLANT' THEN CASE WHEN k < 40 THEN 'OFF' ELSE 'FLOOD' END
       WHEN cmd IN ('SET_AIR_ASSIST','SET_HEAD_COOLANT') THEN CASE WHEN k < 70 THEN 'ON' ELSE 'OFF' END
       WHEN cmd = 'SET_SPINDLE_DIRECTION' THEN CASE WHEN value < 50 THEN 'CW' ELSE 'CCW' END
       WHEN cmd = 'SET_HEAD' THEN concat('head-', CAST(floor(value / 40.0e0) AS INT))
       WHEN cmd = 'SET_POWER_MODE' THEN CASE WHEN value < 50 THEN 'CONSTANT' ELSE 'DYNAMIC' END END AS sval,
  CASE WHEN cmd IN ('OPS_SECTION_START','OPS_SECTION_END')
       THEN CASE WHEN k < 50 THEN 'VECTOR_OUTLINE' ELSE 'RASTER_FILL' END END AS section_type
FROM c
""",
    "rings": """
WITH p AS (SELECT p_partkey AS ring_id, p_partkey % 97 AS geom_id, p_size + p_partkey / 100000.0e0 AS h,
  ((p_partkey % 97) % 10) * 120.0e0 AS cx, floor((p_partkey % 97) / 10.0e0) * 120.0e0 AS cy FROM part),
s AS (SELECT * FROM (VALUES (0,-1,-1),(1,1,-1),(2,1,1),(3,-1,1)) AS t(i, sx, sy))
SELECT geom_id, ring_id, CASE WHEN ring_id % 2 = 0 THEN i ELSE 3 - i END AS seq,
  CAST(cx + sx * h AS DOUBLE) AS x, CAST(cy + sy * h AS DOUBLE) AS y FROM p CROSS JOIN s
""",
    "points": """
SELECT c_custkey AS point_id, CAST((c_custkey * 37) % 1200 AS DOUBLE) AS x,
  CAST((c_custkey * 91) % 1200 AS DOUBLE) AS y FROM customer
""",
    "hatch": """
WITH l AS (SELECT l_suppkey AS job_id, CAST(row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS seg,
  CAST(l_partkey % 200 AS DOUBLE) AS y, l_quantity * 10.0e0 AS xa, l_quantity * 10.0e0 + 1.0e0 + abs(l_discount) * 200.0e0 AS xb,
  l_linenumber % 2 AS rev, CAST(l_linenumber % 2 AS DOUBLE) AS z FROM lineitem)
SELECT job_id, seg, CASE WHEN rev = 1 THEN xb ELSE xa END AS x0, y AS y0,
  CASE WHEN rev = 1 THEN xa ELSE xb END AS x1, y AS y1, z FROM l
""",
    "mesh_verts": """
SELECT p_partkey AS v, (p_partkey % 50) + p_size / 500.0e0 AS x,
  CAST(floor(p_partkey / 50.0e0) AS DOUBLE) + (p_size % 7) / 50.0e0 AS y FROM part
""",
    "mesh_tris": """
SELECT a.p_partkey * 2 + t.i AS t, a.p_partkey AS a, a.p_partkey + CASE WHEN t.i = 0 THEN 1 ELSE 51 END AS b,
  a.p_partkey + CASE WHEN t.i = 0 THEN 51 ELSE 50 END AS c
FROM part a JOIN part d ON d.p_partkey = a.p_partkey + 51 CROSS JOIN (VALUES (0),(1)) AS t(i)
WHERE a.p_partkey % 50 < 49
""",
    "requests": """
SELECT l_partkey AS req_key, l_orderkey * 8 + l_linenumber AS generation, l_extendedprice AS payload FROM lineitem
""",
    "trace_spans": """
SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, 'root' AS source
UNION ALL SELECT 1 + CAST(r_regionkey AS BIGINT), 0, 'region' FROM region
UNION ALL SELECT 100 + CAST(n_nationkey AS BIGINT), 1 + CAST(n_regionkey AS BIGINT), 'nation' FROM nation
UNION ALL SELECT 1000 + s_suppkey, 100 + CAST(s_nationkey AS BIGINT), 'supplier' FROM supplier
""",
    "trace_events": """
SELECT event_id AS seq, 1000 + user_id % 100 AS span, event_type AS source,
  CASE WHEN event_type IN ('click','view') THEN 'move' ELSE 'resume' END AS kind,
  value AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS y FROM events
""",
}

#: Commands with every third arc as a curve of two control points instead.
SQL["curves"] = f"""
WITH co AS ({SQL['commands']}), cu AS (SELECT *, cmd = 'ARC_TO' AND seq % 3 = 1 AS curve FROM co)
SELECT job_id, seq, CASE WHEN curve THEN 'BEZIER_TO' ELSE cmd END AS cmd, x, y, z, CASE WHEN NOT curve THEN ci END AS ci, CASE WHEN NOT curve THEN cj END AS cj, CASE WHEN NOT curve THEN cw END AS cw,
  val, sval, section_type, CASE WHEN curve THEN x - ci * 4.0e0 END AS c1x, CASE WHEN curve THEN y + cj END AS c1y, CASE WHEN curve THEN z END AS c1z,
  CASE WHEN curve THEN x + cj END AS c2x, CASE WHEN curve THEN y - ci * 3.0e0 END AS c2y, CASE WHEN curve THEN z + 1.0e0 END AS c2z
FROM cu
"""

#: The same rows as one giant job, in the order of the events.
SQL["giant"] = SQL["commands"].replace("user_id AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS seq", "CAST(0 AS BIGINT) AS job_id, event_id AS seq")
#: Commands with named blocks of state: every ninth row starts one that ends three rows on, unless a marker of a section is there;
#: in every fourth job layers are blocks instead, some of them nested, unclosed or without a start.
SQL["blocks"] = f"""
WITH co AS ({SQL['commands']}), ma AS (SELECT *, CASE WHEN cmd IN ('OPS_SECTION_START', 'OPS_SECTION_END') THEN 0
  WHEN job_id % 4 = 0 THEN CASE cmd WHEN 'LAYER_START' THEN 1 WHEN 'LAYER_END' THEN -1 ELSE 0 END WHEN seq % 9 = 2 THEN 1 WHEN seq % 9 = 5 THEN -1 ELSE 0 END AS edge FROM co)
SELECT job_id, seq, CASE edge WHEN 1 THEN 'STATE_BLOCK_START' WHEN -1 THEN 'STATE_BLOCK_END' ELSE cmd END AS cmd, x, y, z, ci, cj, cw, val,
  CASE edge WHEN 1 THEN concat(CASE WHEN seq % 2 = 0 THEN 'post-' ELSE 'pre-' END, CAST(seq % 20 AS INT)) WHEN -1 THEN NULL ELSE sval END AS sval, section_type
FROM ma
"""

PIXELS_DUCKDB = """
SELECT image_id, y, x, CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.55e0) * 240.0e0))) AS INT) AS gray,
 CASE WHEN (y + x) % 11 = 0 THEN 0 ELSE 255 END AS a FROM (SELECT image_id, y, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS x
 FROM (SELECT label AS image_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS y, embedding FROM embeddings))
"""
PIXELS_SPARK = """
SELECT image_id, y, x, CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.55e0) * 240.0e0))) AS INT) AS gray,
 CASE WHEN (y + x) % 11 = 0 THEN 0 ELSE 255 END AS a FROM (SELECT image_id, y, posexplode(embedding) AS (x, e)
 FROM (SELECT label AS image_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS y, embedding FROM embeddings))
"""

SOURCES = {"commands": ["events"], "curves": ["events"], "blocks": ["events"], "giant": ["events"], "rings": ["part"], "points": ["customer"], "hatch": ["lineitem"], "mesh_verts": ["part"], "mesh_tris": ["part"], "requests": ["lineitem"], "trace_spans": ["region", "nation", "supplier"], "trace_events": ["events"]} | {"pixels": ["embeddings"]}



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a given one read from Parquet."""
    if name not in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    given = {base: spark.read.parquet(f"{sf_dir}/{base}.parquet") for base in SOURCES[name]}
    text = PIXELS_SPARK if name == "pixels" else SQL[name]
    for base in given:  # as parameters, so that no view of the caller is replaced
        text = re.sub(rf"\b(FROM|JOIN) {base}\b", rf"\1 {{{base}}}", text)
    return spark.sql(text, **given)


def cte(*names: str) -> str:
    """The same tables as the head of a DuckDB query."""
    return "WITH " + ", ".join(f"{n} AS ({PIXELS_DUCKDB if n == 'pixels' else SQL[n]})" for n in names)
