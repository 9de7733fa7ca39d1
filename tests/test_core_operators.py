"""Literal cases, invariants, plans and streams of the operators that SQL does not cover."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom.operators import commands, iterative, mesh, spatial, transforms
from pathloom.sources import documents
from pathloom.sources.derive import table
from pathloom.streaming import commands as streams

DATA = "/root/testdata/sf0.001"
SCHEMA = "job_id long, seq long, cmd string, x double, y double, z double, ci double, cj double, cw boolean, val double, sval string, section_type string"


def job(spark, *rows):
    """Rows of one job given as (cmd, x, y, val)."""
    full = [(1, i, r[0], *(float(v) if v is not None else None for v in r[1:3]), 0.0 if r[1] is not None else None, None, None, None, float(r[3]) if len(r) > 3 else None, None, None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_times_of_a_square(spark):
    df = job(spark, ("SET_FEED_RATE", None, None, 600), ("MOVE_TO", 10, 0), ("LINE_TO", 10, 20), ("DWELL", None, None, 500))
    rows = commands.with_durations(df, rapid=6000.0, acceleration=0.0).orderBy("seq").collect()
    assert [round(r["duration"], 6) for r in rows] == [0.0, 0.1, 2.0, 0.5]
    total = commands.job_measures(df).first()
    assert (total["distance"], total["cut_distance"], total["n_cutting"]) == (20.0, 20.0, 1)


def test_short_moves_have_triangular_profiles(spark):
    df = job(spark, ("MOVE_TO", 1, 0))
    row = commands.with_durations(df, rapid=6000.0, acceleration=100.0).first()
    assert row["duration"] == pytest.approx(2 * math.sqrt(1 / 100.0))


def test_segments_follow_the_state_machine(spark):
    rng = random.Random(4)
    for _ in range(5):
        kinds = [rng.choice(("MOVE_TO", "LINE_TO", "SET_POWER")) for _ in range(60)]
        df = job(spark, *[(k, 1, 1) if k != "SET_POWER" else (k, None, None, 1) for k in kinds])
        want, open_now, number = [], False, -1
        for k in kinds:
            if k == "MOVE_TO":
                number, open_now = number + 1, True
            elif k == "LINE_TO":
                if not open_now:
                    number, open_now = number + 1, True
            elif open_now:
                number, open_now = number + 1, False
            else:
                number, open_now = number + 1, True
            want.append(number)
        assert [r["segment"] for r in commands.with_segments(df).orderBy("seq").collect()] == want


def test_job_costing_has_one_exchange(spark):
    plan = commands.job_measures(table(spark, DATA, "commands").filter("true"))
    given = spark.createDataFrame([], SCHEMA)
    text = commands.job_measures(given)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert plan.count() > 0


def test_long_scan_is_the_plain_scan(spark):
    df = table(spark, DATA, "commands").select("*").withColumn("seq", F.row_number().over(Window.orderBy("job_id", "seq")) - 1).withColumn("job_id", F.lit(0).cast("long"))
    a = commands.long_jobs(df, 37).orderBy("seq").collect()
    b = commands.long_jobs(df, 10**9).orderBy("seq").collect()
    assert all(abs(p["sum_x"] - q["sum_x"]) < 1e-6 and p["power"] == q["power"] for p, q in zip(a, b, strict=True))


@pytest.mark.parametrize("parts", [1, 7, 31])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = table(spark, DATA, "commands")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(map(tuple, commands.rounded(commands.job_measures(df.repartition(parts, F.rand(parts)))).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(map(tuple, commands.rounded(commands.job_measures(df)).collect()))


def test_hulls_hold_all_points(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(x), float(y)) for k, x, y in zip(rng.integers(0, 4, 3000), rng.normal(size=3000), rng.normal(size=3000))] + [(9, 1.0, 1.0)] * 3
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(9)
    found = {}
    for r in iterative.convex_hulls(df, "k").orderBy("k", "i").collect():
        found.setdefault(r["k"], []).append((r["x"], r["y"]))
    assert found[9] == [(1.0, 1.0)]
    for k in range(4):
        h = np.asarray(found[k])
        n = np.roll(h, -1, axis=0)
        for q, x, y in rows:
            if q == k:
                assert ((n[:, 0] - h[:, 0]) * (y - h[:, 1]) - (n[:, 1] - h[:, 1]) * (x - h[:, 0]) >= -1e-9).all()


def test_simplified_paths_stay_within_tolerance(spark):
    rng = random.Random(6)
    rows = [(p, i, float(i), rng.uniform(-3, 3)) for p in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "path long, seq long, x double, y double")
    kept = {}
    for r in iterative.simplified(df, 1.5).orderBy("path", "seq").collect():
        kept.setdefault(r["path"], []).append((r["seq"], r["x"], r["y"]))

    def plain(pts):
        (ax, ay), (bx, by) = pts[0][1:], pts[-1][1:]
        d = [abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / math.hypot(bx - ax, by - ay) for _, x, y in pts[1:-1]]
        if not d or max(d) <= 1.5:
            return [pts[0], pts[-1]]
        k = d.index(max(d)) + 1
        return plain(pts[: k + 1])[:-1] + plain(pts[k:])

    for p in range(3):
        assert kept[p] == plain([r[1:] for r in rows if r[0] == p])


def test_nearest_order_visits_every_path_once(spark):
    df = table(spark, DATA, "commands")
    rows = iterative.nearest_order(df).collect()
    paths = commands.with_subpaths(df).filter(commands.is_moving()).select("job_id", "subpath").distinct().count()
    assert len({(r["job_id"], r["subpath"]) for r in rows}) == len({(r["job_id"], r["rank"]) for r in rows}) == paths == len(rows)


def test_laplace_field_solves_its_system(spark):
    n = 7
    verts = [(i * n + j, float(j), float(i), "OUTER" if i in (0, n - 1) or j in (0, n - 1) else "INNER" if (i, j) == (3, 3) else "NONE") for i in range(n) for j in range(n)]
    tris = [t for i in range(n - 1) for j in range(n - 1) for t in ((2 * (i * n + j), i * n + j, i * n + j + 1, i * n + j + n + 1), (2 * (i * n + j) + 1, i * n + j, i * n + j + n + 1, i * n + j + n))]
    v = spark.createDataFrame(verts, "v long, x double, y double, tag string")
    t = spark.createDataFrame(tris, "t long, a long, b long, c long")
    u = {r["v"]: r["u"] for r in mesh.laplace(t, v).collect()}
    k = np.zeros((n * n, n * n))
    for r in mesh.stiffness(t, v).collect():
        k[r["i"], r["j"]] = r["k"]
    x = np.asarray([u[i] for i in range(n * n)])
    free = [i for i, *_, tag in verts if tag == "NONE"]
    assert np.abs((k @ x)[free]).max() < 1e-6 and u[24] == 0.0 and u[0] == 1.0


def test_documents_round_trip_and_code(spark):
    df = job(spark, ("MOVE_TO", 1, 2), ("MOVE_TO", 1, 2), ("LINE_TO", 1.5, 2), ("SET_POWER", None, None, 0.5))
    assert documents.from_documents(documents.to_documents(df)).count() == 4
    assert [r["line"] for r in documents.machine_code(df).orderBy("seq").collect()] == ["G0 X1 Y2", None, "G1 X1.5", "M4 S500"]


def test_documents_and_columns_keep_everything(spark):
    rows = [
        (1, 0, "MOVE_TO", 1.0, 2.0, 0.0, None, None, None, None, None, None, None, None),
        (1, 1, "LAYER_START", *[None] * 7, "layer-1", None, None, None),
        (1, 2, "SET_COOLANT", *[None] * 7, "FLOOD", None, None, None),
        (1, 3, "OPS_SECTION_START", *[None] * 8, "RASTER_FILL", None, None),
        (1, 4, "BEZIER_TO", 3.0, 4.0, 0.0, *[None] * 6, [1.0, 2.0, 0.0, 3.0, 3.0, 0.0], None),
        (1, 5, "SCAN_LINE", 9.0, 4.0, 0.0, *[None] * 7, [0, 127, 255]),
        (1, 6, "ARC_TO", 9.0, 5.0, 0.0, 0.5, 0.25, True, *[None] * 5),
        (1, 7, "DWELL", *[None] * 6, 250.0, *[None] * 4),
    ]
    kinds = "job_id long, seq long, cmd string, x double, y double, z double, ci double, cj double, cw boolean, val double, sval string, section_type string, control array<double>, power_values array<int>"
    df = spark.createDataFrame(rows, kinds)
    assert sorted(map(tuple, documents.from_documents(documents.to_documents(df)).select(*df.columns).collect())) == rows
    out = documents.columnar(df).orderBy("seq").collect()
    assert [r["code"] for r in out] == [1, 102, 20, 106, 6, 4, 3, 5]
    assert [tuple(r[c] for c in df.columns if c != "cmd") for r in out] == [(*r[:2], *r[3:]) for r in rows]
    assert len(documents.CODES) == len(set(documents.CODES.values())) == 31


def test_transformers_run_by_phase_then_as_given(spark):
    seen = []
    mark = lambda n: lambda d: (seen.append(n), d)[1]
    steps = [transforms.Transformer(n, p, mark(n)) for n, p in (("c", 2), ("a", 1), ("d", 2), ("b", 1))]
    transforms.apply_transformers(spark.range(1), steps)
    assert seen == ["a", "b", "c", "d"]


def test_streams_carry_state_over_batches(spark, tmp_path):
    rows = [(1, 1, "LINE_TO", 3.0, 4.0, None), (1, 0, "MOVE_TO", 0.0, 0.0, None), (1, 3, "SET_POWER", None, None, 0.5), (2, 0, "MOVE_TO", 1.0, 1.0, None), (1, 2, "LINE_TO", 3.0, 9.0, None), (1, 4, "LINE_TO", 0.0, 9.0, None)]
    schema = "job_id long, seq long, cmd string, x double, y double, val double"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.running_state(stream).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["job_id"], r["seq"]): (r["power"], r["distance"]) for r in spark.sql("select * from carried").collect()}
    assert got == {(1, 0): (0.0, 0.0), (1, 1): (0.0, 5.0), (1, 2): (0.0, 10.0), (1, 3): (0.5, 10.0), (1, 4): (0.5, 13.0), (2, 0): (0.0, 0.0)}


def test_stream_of_generations(spark, tmp_path):
    table(spark, DATA, "requests").write.parquet(f"{tmp_path}/r")
    live = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/r").schema).parquet(f"{tmp_path}/r")
    q = streams.newest_requests(live).writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r[0]: r[1] for r in spark.read.parquet(f"{tmp_path}/r").groupBy("req_key").agg(F.max("generation")).collect()}
    assert {r["req_key"]: r["generation"] for r in spark.sql("select * from newest").collect()} == want


def test_walks_of_any_size_take_the_nearest_start(spark):
    def plain(a, b, n):
        at = int(len(a) - 1 - n[::-1].argmax())
        left, order = np.ones(len(a), dtype=bool), [at]
        left[at] = False
        while left.any():
            at = int(np.where(left, ((a - b[at]) ** 2).sum(axis=1), np.inf).argmin())
            left[at] = False
            order.append(at)
        return order

    rng = np.random.default_rng(5)
    for size in (1, 2, 9, 60, 700):
        for a in (rng.normal(size=(size, 2)), rng.integers(0, 9, size=(size, 2)).astype(float)):
            b = a[rng.permutation(size)] + rng.integers(0, 2, size=(size, 1))
            n = rng.integers(1, 5, size=size)
            assert iterative.nearest_walk(a, b, n) == plain(a, b, n)
            a[rng.random(size) < 0.1, 0], b[rng.random(size) < 0.1, 1] = np.nan, np.nan
            assert iterative.nearest_walk(a, b, n) == plain(a, b, n)
    df = job(spark, *[("MOVE_TO", i * 7919 % 10_501, 0) for i in range(10_501)])
    rows = iterative.nearest_order(df).orderBy("rank").collect()
    assert sorted(r["subpath"] for r in rows) == list(range(10_501)) and rows[0]["subpath"] == 10_500


def test_simplified_takes_as_many_rounds_as_needed(spark):
    # every round keeps only the next of the growing steps
    points = [(1, i, float(4**i), 0.0 if i % 2 else float(4**i)) for i in range(70)]
    want, todo = {0, 69}, [(0, 69, 0)]
    deepest = 0
    xy = [p[2:] for p in points]
    while todo:
        lo, hi, deep = todo.pop()
        (ax, ay), (bx, by) = xy[lo], xy[hi]
        d = [(((xy[i][0] - ax) * (by - ay) - (xy[i][1] - ay) * (bx - ax)) ** 2 / ((bx - ax) ** 2 + (by - ay) ** 2)) ** 0.5 for i in range(lo + 1, hi)]
        if d and max(d) > 0.1:
            mid = lo + 1 + d.index(max(d))
            want.add(mid)
            deepest = max(deepest, deep + 1)
            todo += [(lo, mid, deep + 1), (mid, hi, deep + 1)]
    assert deepest > 61
    out = iterative.simplified(spark.createDataFrame(points, "path long, seq long, x double, y double"), 0.1)
    assert {r["seq"] for r in out.collect()} == want


def test_points_far_from_all_rings_have_a_nearest_one(spark):
    rings = spark.createDataFrame([(1, 1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], "geom_id long, ring_id long, seq long, x double, y double")
    points = spark.createDataFrame([(1, 1e6, 0.5), (2, 2.0, 0.5), (3, None, 0.5)], "point_id long, x double, y double")
    found = {r["point_id"]: (r["ring_id"], r["distance"]) for r in spatial.nearest_rings(points, rings).collect()}
    assert found == {1: (1, 999_999.0), 2: (1, 1.0)}


def test_field_that_does_not_converge_is_an_error(spark):
    verts = spark.createDataFrame([(3 * i + j, float(i), float(j), "INNER" if i == 0 else "OUTER" if i == 4 else "NONE") for i in range(5) for j in range(3)], "v long, x double, y double, tag string")
    cells = [(3 * i + j, 3 * i + j + 1, 3 * i + j + 3, 3 * i + j + 4) for i in range(4) for j in range(2)]
    tris = spark.createDataFrame([(2 * n + h, *((p, r, s) if h else (p, s, q))) for n, (p, q, r, s) in enumerate(cells) for h in (0, 1)], "t long, a long, b long, c long")
    with pytest.raises(RuntimeError):
        mesh.laplace(tris, verts, most=1)


def test_field_takes_few_rounds(spark):
    """Eliminated cells leave fewer rounds than the 54 of all vertices; the field solves its system, a vertex without triangles is 0."""
    n = 20
    verts = [(i * n + j, float(j), float(i), "OUTER" if i in (0, n - 1) or j in (0, n - 1) else "INNER" if (i, j) == (10, 10) else "NONE") for i in range(n) for j in range(n)]
    tris = [t for i in range(n - 1) for j in range(n - 1) for t in ((2 * (i * n + j), i * n + j, i * n + j + 1, i * n + j + n + 1), (2 * (i * n + j) + 1, i * n + j, i * n + j + n + 1, i * n + j + n))]
    v = spark.createDataFrame([*verts, (n * n, 5.0, 5.0, "NONE")], "v long, x double, y double, tag string")
    t = spark.createDataFrame(tris, "t long, a long, b long, c long")
    u = {r["v"]: r["u"] for r in mesh.laplace(t, v, most=42).collect()}
    k = np.zeros((n * n, n * n))
    for r in mesh.stiffness(t, v).collect():
        k[r["i"], r["j"]] = r["k"]
    x = np.asarray([u[i] for i in range(n * n)])
    free = [i for i, *_, tag in verts if tag == "NONE"]
    assert np.abs((k @ x)[free]).max() < 1e-6 and u[210] == 0.0 and u[0] == 1.0 and u[n * n] == 0.0 and len(u) == n * n + 1


def test_only_those_that_equal_a_kept_one_are_dropped(spark):
    """A chain 1-2-3-4 of equal pairs keeps 1 and 3: 3 equals only the dropped 2, and 4 equals 3."""
    from pathloom.operators.contours import first_kept

    nodes = spark.createDataFrame([(0, i) for i in range(1, 7)], "k int, node int")
    pairs = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 5, 6), (0, 5, 6)], "k int, a int, b int")
    assert sorted(r["node"] for r in first_kept(nodes, pairs, ["k"]).collect()) == [1, 3, 5]


def test_state_of_waiting_rows_keeps_every_digit():
    import pandas as pd
    import pyarrow as pa

    from pathloom.streaming import commands as streams

    rows = pd.DataFrame({"seq": [3], "cmd": ["LINE_TO"], "x": [0.1234567890123456], "y": [1e-17], "val": [None]})
    back = pa.ipc.open_stream(streams._packed(rows)).read_pandas()
    assert back["x"][0] == 0.1234567890123456 and back["y"][0] == 1e-17 and back["val"].isna().all()


def test_areas_of_rings_that_are_not_convex(spark):
    from pathloom.operators.spatial import overlap_areas

    shapes = {1: [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], 2: [(0, 2), (0, 0), (4, 0), (4, 2)], 3: [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]}
    rings = spark.createDataFrame([(0, k, i, float(x), float(y)) for k, ring in shapes.items() for i, (x, y) in enumerate(ring)], "geom_id int, ring_id int, seq int, x double, y double")
    pairs = spark.createDataFrame([(0, 1, 2), (0, 1, 3)], "geom_id int, ring_id int, other int")
    found = {r["other"]: r["area"] for r in overlap_areas(rings, pairs).collect()}
    whole = 4 * 4 - 0.5 * 4 * 3
    # above y = 1 the notch of the first ring is (y - 1) * 4 / 3 wide
    assert abs(found[3] - whole) < 1e-6 and abs(found[2] - (8 - 2 / 3)) < 1e-6
