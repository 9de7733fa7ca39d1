"""Trace logs and request logs: paths, counts, span trees, newest generations, readiness levels."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.loops import saved
from pathloom.operators.commands import rounded
from pathloom.sources.derive import cte, table


def toolpath(events: DataFrame, span: int | None = None) -> DataFrame:
    """Points of the move events, of one span on demand."""
    moves = events.filter("kind = 'move'")
    return (moves if span is None else moves.filter(F.col("span") == span)).select("seq", "span", "x", "y")


def span_counts(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each span, 0 where there are none."""
    n = events.groupBy("span").agg(F.count(F.lit(1)).alias("n"))
    return spans.join(n, spans["id"] == n["span"], "left").select("id", "source", F.coalesce("n", F.lit(0)).alias("n"))


def sources(spans: DataFrame, events: DataFrame) -> DataFrame:
    return spans.select("source").union(events.select("source")).distinct()


def span_tree(spans: DataFrame, most: int = 1000) -> DataFrame:
    """Depth of each span and the ids from its root to it; spans below a cycle or a missing parent are left out."""
    part = lambda: F.lpad(F.col("id").cast("string"), 12, "0")
    front = saved(spans.filter("parent is null").select("id", "source", F.lit(0).alias("depth"), part().alias("path")))
    done = front
    for _ in range(most):
        child = spans.join(front.select(F.col("id").alias("parent"), "depth", F.col("path").alias("up")), "parent")
        front = saved(child.select("id", "source", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "up", part()).alias("path")))
        if not front.limit(1).count():
            return done
        done = done.unionByName(front)
    raise RuntimeError("the tree is deeper than allowed")


def newest(requests: DataFrame) -> DataFrame:
    """The latest generation of each key, the smallest payload of equal ones, and how many older rows it shadows."""
    best = F.max(F.struct("generation", (-F.col("payload")).alias("p")))
    return requests.groupBy("req_key").agg(best.alias("s"), F.count(F.lit(1)).alias("n")).select("req_key", F.col("s.generation").alias("generation"), (-F.col("s.p")).alias("payload"), (F.col("n") - 1).alias("shadowed"))


def readiness(keys: DataFrame, needs: DataFrame) -> DataFrame:
    """Level at which each key can run, after all that it needs ``(req_key, need)``; null for keys that never can."""
    open_keys = saved(keys.select("req_key"))
    done = saved(open_keys.join(needs, "req_key", "left_anti").select("req_key", F.lit(0).alias("level")))
    for level in itertools.count(1):
        waiting = needs.join(done.select(F.col("req_key").alias("need")), "need", "left_anti").select("req_key").distinct()
        ready = open_keys.join(done.select("req_key"), "req_key", "left_anti").join(waiting, "req_key", "left_anti")
        ready = saved(ready.select("req_key", F.lit(level).alias("level")))
        if not ready.limit(1).count():
            break
        done = saved(done.unionByName(ready))
    return open_keys.join(done, "req_key", "left")


def _q(f, *names):
    return lambda spark, sf_dir: rounded(f(*[table(spark, sf_dir, n) for n in names]))


def _needs(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = r.select("req_key").distinct()
    need = F.when(F.col("req_key") % 50 == 49, F.lit(-1)).otherwise(F.floor(F.col("req_key") / 3)).cast("long")
    return keys, keys.withColumn("need", need).filter("req_key > 0 and need <> req_key and (need > 0 or need = -1)")


QUERIES = {
    "trace_toolpath": _q(toolpath, "trace_events"),
    "trace_span_counts": _q(span_counts, "trace_spans", "trace_events"),
    "trace_sources": _q(sources, "trace_spans", "trace_events"),
    "trace_tree": _q(span_tree, "trace_spans"),
    "newest_requests": _q(newest, "requests"),
    "readiness_levels": _q(lambda r: readiness(*_needs(r)), "requests"),
}
_L = cte("trace_spans", "trace_events")
ORACLE_SQL = {
    "trace_toolpath": f"{_L} SELECT seq, span, round(x, 6) AS x, y FROM trace_events WHERE kind = 'move'",
    "trace_span_counts": f"{_L} SELECT id, s.source, count(e.seq) AS n FROM trace_spans s LEFT JOIN trace_events e ON e.span = s.id GROUP BY ALL",
    "trace_sources": f"{_L} SELECT source FROM trace_spans UNION SELECT source FROM trace_events",
    "trace_tree": f"""{_L.replace('WITH', 'WITH RECURSIVE', 1)}, r AS (SELECT id, source, 0 AS depth, lpad(id::VARCHAR, 12, '0') AS path FROM trace_spans WHERE parent IS NULL
 UNION ALL SELECT s.id, s.source, depth + 1, path || '/' || lpad(s.id::VARCHAR, 12, '0') FROM r JOIN trace_spans s ON s.parent = r.id) SELECT * FROM r""",
    "newest_requests": f"""{cte('requests')}, n AS (SELECT *, row_number() OVER (PARTITION BY req_key ORDER BY generation DESC, payload) AS i, count(*) OVER (PARTITION BY req_key) AS c FROM requests)
 SELECT req_key, generation, round(payload, 6) AS payload, c - 1 AS shadowed FROM n WHERE i = 1""",
    "readiness_levels": f"""{cte('requests').replace('WITH', 'WITH RECURSIVE', 1)}, k AS (SELECT DISTINCT req_key, CASE WHEN req_key % 50 = 49 THEN -1 ELSE req_key // 3 END AS need FROM requests),
 d AS (SELECT * FROM k WHERE req_key > 0 AND need <> req_key AND (need > 0 OR need = -1)),
 r AS (SELECT req_key, 0 AS level FROM k WHERE req_key NOT IN (SELECT req_key FROM d) UNION ALL SELECT d.req_key, level + 1 FROM r JOIN d ON d.need = r.req_key)
 SELECT k.req_key, max(level) AS level FROM k LEFT JOIN r ON r.req_key = k.req_key GROUP BY ALL""",
}
