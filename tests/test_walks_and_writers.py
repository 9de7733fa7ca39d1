"""Workpiece walks, nearest edges of odd points, chains of repeats, partitioned files and slabs of streams."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import loops
from pathloom.operators import contours, iterative, spatial, structure, textures
from pathloom.sources import documents
from pathloom.sources.derive import table
from pathloom.streaming import commands as streams

DATA = "/root/testdata/sf0.001"
COMMANDS = "job_id long, seq long, cmd string, x double, y double, z double, ci double, cj double, cw boolean, val double, sval string, section_type string"
RING = "geom_id long, ring_id long, seq long, x double, y double"
SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]


def plain_walk(a, b, flips):
    left, here, out = set(range(1, len(a))), b[0], [(0, False)]
    while left:
        _, i, e = min((math.dist(here, p) ** 2, i, e) for i in left for e, p in ((0, a[i]), (1, b[i])))
        back = bool(e and flips[i])
        out.append((i, back))
        left.remove(i)
        here = a[i] if back else b[i]
    return out


def test_piece_walks_are_those_of_a_plain_search():
    rng = random.Random(2)
    for n in (1, 2, 3, 40, 300):
        a, b = ([(rng.randrange(30), rng.randrange(30)) for _ in range(n)] for _ in range(2))
        flips = [rng.random() < 0.7 for _ in range(n)]
        assert iterative.piece_walk(np.array(a, float), np.array(b, float), np.array(flips)) == plain_walk(a, b, flips)


def test_workpieces_of_a_job(spark):
    rows = [("WORKPIECE_START", "lost"), ("MOVE_TO", 50, 50), ("WORKPIECE_START", "a"), ("MOVE_TO", 0, 0), ("LINE_TO", 1, 0), ("WORKPIECE_END", None), ("MOVE_TO", 99, 99), ("WORKPIECE_START", "far"), ("MOVE_TO", 9, 0), ("LINE_TO", 5, 0),
            ("WORKPIECE_END", None), ("WORKPIECE_START", "empty"), ("WORKPIECE_END", None), ("WORKPIECE_START", "b"), ("MOVE_TO", 4, 0), ("LINE_TO", 1.5, 0)]
    full = [(1, i, r[0], *(map(float, r[1:]) if len(r) == 3 else (None, None)), *[None] * 5, r[1] if len(r) == 2 else None, None) for i, r in enumerate(rows)]
    got = [(r["uid"], r["flipped"]) for r in iterative.workpiece_order(spark.createDataFrame(full, COMMANDS)).orderBy("rank").collect()]
    assert got == [("a", False), ("b", True), ("far", True)]


def test_nearest_edges_of_odd_points(spark):
    rng = random.Random(5)
    rings = {r: [(x * 3 + r * 7, y * 2 + r % 5) for x, y in SQUARE] for r in range(40)} | {99: [(-1e4, -1e4), (2e4, -1e4), (2e4, 2e4), (-1e4, 2e4)]}
    rows = [(r % 3, r, i, float(x), float(y)) for r, v in rings.items() for i, (x, y) in enumerate(v)] + [(0, 100, 0, math.nan, 0.0), (0, 100, 1, math.inf, 1.0), (0, 100, 2, None, 1.0)]
    points = {i: (rng.uniform(-20, 300), rng.uniform(-20, 30)) for i in range(60)} | {60: (1e6, 0.5), 61: (-1e9, 1e9), 62: (1.0, 0.0)}
    odd = [(70, math.nan, 0.5), (71, math.inf, 0.0), (72, None, 0.0)]
    df = spark.createDataFrame([*[(i, *p) for i, p in points.items()], *odd], "point_id long, x double, y double")

    def apart(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = min(1.0, max(0.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return (p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2

    want = {i: min((apart(p, v[k], v[(k + 1) % 4]), r) for r, v in rings.items() for k in range(4)) for i, p in points.items()}
    got = {r["point_id"]: (r["ring_id"], r["distance"]) for r in spatial.nearest_rings(df, spark.createDataFrame(rows, RING).filter("ring_id <> 100")).collect()}
    assert set(got) == set(points)
    for i, (d2, _) in want.items():
        assert got[i][1] == pytest.approx(math.sqrt(d2), rel=1e-9, abs=1e-9)
    assert set(r["point_id"] for r in spatial.nearest_rings(df, spark.createDataFrame(rows, RING)).collect()) == set(points)
    assert spatial.nearest_rings(df, spark.createDataFrame([], RING)).count() == 0


def test_ring_ids_that_repeat_between_geometries(spark):
    rows = [(g, 1, i, float(x * s), float(y * s)) for g, s in ((1, 10), (2, 4)) for i, (x, y) in enumerate(SQUARE)]
    rows += [(g, 2, i, float(x * s + 1), float(y * s + 1)) for g, s in ((1, 2), (2, 1)) for i, (x, y) in enumerate(SQUARE)]
    tree = {(r["geom_id"], r["ring_id"]): (r["depth"], r["parent"]) for r in spatial.hierarchy(spark.createDataFrame(rows, RING)).collect()}
    assert tree == {(1, 1): (0, None), (1, 2): (1, 1), (2, 1): (0, None), (2, 2): (1, 1)}


def test_repeats_are_dropped_when_an_earlier_one_stays(spark, monkeypatch):
    rng = random.Random(3)
    for _ in range(4):
        pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
        kept: set = set()
        for n in range(60):
            if not any((a, n) in pairs for a in kept):
                kept.add(n)
        nodes = spark.createDataFrame([(0, n) for n in range(60)], "k long, node long")
        got = contours.first_kept(nodes, spark.createDataFrame([(0, a, b) for a, b in pairs], "k long, a long, b long"), ["k"])
        assert {r["node"] for r in got.collect()} == kept
    saves, keep = [], contours.saved
    monkeypatch.setattr(contours, "saved", lambda df: saves.append(1) or keep(df))
    n = 10_000
    nodes, pairs = spark.range(n).select(F.lit(0).alias("k"), F.col("id").alias("node")), spark.range(n - 1).select(F.lit(0).alias("k"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["node"] for r in contours.first_kept(nodes, pairs, ["k"]).collect()}
    assert got == set(range(0, n, 2)) and len(saves) < 40


def test_one_bucket_is_read_alone(spark, tmp_path):
    df = table(spark, DATA, "commands")
    documents.write_columnar(df, f"{tmp_path}/c")
    back = documents.read_columnar(spark, f"{tmp_path}/c")
    assert back.count() == df.count() and back.filter("bucket <> pmod(job_id, 16)").count() == 0
    some = documents.read_columnar(spark, f"{tmp_path}/c", [3, 19, 5])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert some.count() == df.filter("job_id in (3, 19, 5)").count()
    odd = spark.createDataFrame([(None, 0, "MOVE_TO"), (-3, 0, "CUSTOM_X")], "job_id long, seq long, cmd string").withColumns({c: F.lit(None).cast("double") for c in ("x", "y", "z", "ci", "cj", "val")} | {"cw": F.lit(None).cast("boolean")})
    assert {(r["job_id"], r["code"], r["bucket"]) for r in documents.columnar(odd).collect()} == {(None, 1, 0), (-3, 0, 13)}


def test_rows_split_over_slabs_come_out_once(spark, tmp_path):
    schema = "image_id long, y long, x int, gray int, a int, width long"
    rows = [(i, y, x, 10 * x + y, 255, 4) for i in (1, 2) for y in (0, 1) for x in range(4)]
    slabs = [[r for r in rows if r[2] in (0, 3)], [r for r in rows if r[2] == 1] + [rows[0]], [r for r in rows if r[2] == 2 and r[0] == 1], [r for r in rows if r[0] == 1]]
    for k, part in enumerate(slabs):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.scan_slabs(live).writeStream.format("memory").queryName("slabs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["image_id"], r["y"], len(r["samples"])) for r in spark.sql("select * from slabs").collect())
    assert got == [(1, 0, 4), (1, 1, 4)]  # the other image still waits for a pixel


def test_blocks_and_their_errors(spark):
    def job(*cmds):
        return [(1, i, c, *[None] * 7, n, "VECTOR_OUTLINE" if c.startswith("OPS") else None) for i, (c, n) in enumerate(cmds)]

    start, end = "STATE_BLOCK_START", "STATE_BLOCK_END"
    good = spark.createDataFrame(job(("OPS_SECTION_START", None), (start, "pre-a"), ("DWELL", None), (end, None), ("DWELL", None), (start, "post"), (end, None), ("OPS_SECTION_END", None)), COMMANDS)
    blocks = structure.state_blocks(good)
    assert [(r["name"], r["first"], r["last"], r["n_content"]) for r in blocks.orderBy("first").collect()] == [("pre-a", 1, 3, 1), ("post", 5, 6, 0)]
    assert structure.blocks_named(blocks, "pre*").count() == 1 and structure.blocks_named(blocks, "pre").count() == 0
    bad = spark.createDataFrame(job(("OPS_SECTION_START", None), (start, "a"), (start, "b"), (end, None), ("OPS_SECTION_START", None), (end, None), ("OPS_SECTION_START", None), (start, None), (end, None)), COMMANDS)
    assert sorted(r["error"] for r in structure.block_errors(bad).collect()) == ["nested", "unclosed", "unmatched"]
    assert structure.state_blocks(bad).count() == 1


def test_texture_of_level_and_slanted_lines(spark):
    rows = [(1, 0, "MOVE_TO", 0.0, 1.0, None), (1, 1, "SCAN_LINE", 2.0, 1.0, [0, 255]), (2, 0, "MOVE_TO", 0.0, 0.0, None), (2, 1, "SCAN_LINE", 3.0, 3.0, [9, 9, 9])]
    df = spark.createDataFrame(rows, "job_id long, seq long, cmd string, x double, y double, samples array<int>")
    got = {(r["job_id"], r["px"], r["py"]): r["power"] for r in textures.to_texture(df, 4, 4, (1.0, 1.0)).collect()}
    assert got == {(1, 1, 3): 255, (2, 1, 3): 9, (2, 2, 2): 9, (2, 3, 1): 9}
    wide = {(r["px"], r["py"]) for r in textures.to_texture(df.filter("job_id = 1"), 4, 4, (1.0, 1.0), radius=1).collect()}
    assert wide == {(x, y) for x in (0, 1, 2) for y in (2, 3)}


def test_components_of_edges_in_any_order(spark, monkeypatch):
    from pathloom.functions import loops

    rng = random.Random(8)
    edges = [(k, *rng.sample(range(400), 2)) for k in (1, 2) for _ in range(250)] + [(3, i + 1, i) for i in range(5000)] + [(4, 7, 7)]
    rng.shuffle(edges)
    nodes = {(k, n) for k, a, b in edges for n in (a, b)} | {(5, 1)}
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for k, a, b in edges:
        x, y = sorted((top((k, a)), top((k, b))))
        parent[y] = x
    df = spark.createDataFrame(edges, "image_id long, a long, b long").repartition(7)
    whole = loops.contracted
    for most in (1 << 20, 64):  # also where a task holds few edges at a time
        monkeypatch.setattr(loops, "contracted", lambda e, key, most=most: whole(e, key, most))
        got = loops.component_labels(spark.createDataFrame(list(nodes), "image_id long, node long"), df)
        assert {(r["image_id"], r["node"]): r["label"] for r in got.collect()} == {n: top(n)[1] for n in nodes}


def test_one_giant_job_is_many_tasks(spark):
    from pathloom.operators import commands, long_jobs

    n = 40_000
    job = spark.range(n).select(F.lit(1).cast("long").alias("job_id"), F.col("id").alias("seq"), F.when(F.col("id") % 10 == 0, "SET_FEED_RATE").when(F.col("id") % 7 == 0, "MOVE_TO").otherwise("LINE_TO").alias("cmd"), (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    job = job.withColumns({"z": F.lit(0.0), "val": F.when(F.col("cmd") == "SET_FEED_RATE", 500.0 + F.col("seq") % 300), **{c: F.lit(None).cast("double") for c in ("ci", "cj")}, "cw": F.lit(None).cast("boolean"), "sval": F.lit(None).cast("string"), "section_type": F.lit(None).cast("string")})
    job = job.withColumns({c: F.when(F.col("cmd") != "SET_FEED_RATE", F.col(c)) for c in "xyz"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = long_jobs.with_durations(job, block_rows=1000)
        most = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.count("count")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most[0] < 0.7 * n and most[1] >= 3
    a, b = long_jobs.job_measures(job, 1000).first().asDict(), commands.job_measures(job).first().asDict()
    assert all(a[k] == pytest.approx(b[k]) for k in b)


def test_components_of_long_chains(spark, monkeypatch):
    order = random.Random(2).sample(range(600), 600)
    rows = [(g, int(a), int(b)) for g in (0, 1) for a, b in zip(order, order[1:], strict=False) if g == 0 or a % 50]
    monkeypatch.setattr(loops, "contracted", lambda edges, key: edges)  # as where a task can join but few of them
    nodes = spark.createDataFrame([(g, n) for g in (0, 1) for n in range(601)], "geom_id long, node long")
    got = {(r["geom_id"], r["node"]): r["label"] for r in loops.component_labels(nodes, spark.createDataFrame(rows, "geom_id long, a long, b long"), "geom_id", 24).collect()}
    want, parts = {(g, 600): 600 for g in (0, 1)} | {(0, n): 0 for n in range(600)}, [[]]
    for n in order:
        parts[-1].append(n)
        if n % 50 == 0:
            parts.append([])
    want |= {(1, n): min(part) for part in parts for n in part}
    assert got == want
