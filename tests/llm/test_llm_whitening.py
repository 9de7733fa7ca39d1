"""Whitening against numpy over all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def vectors(n: int = 300, size: int = 12, seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1 + k % 4) for k in range(size)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(7, rows[3][1]), (None, rows[4][1])]  # many copies, repeated and null ids
    bad = [None, [], [None] * size, [1.0, None] + [0.0] * (size - 2), [math.inf] + [0.0] * (size - 1), [math.nan] * size, [1.0] * (size + 1), [3e30] * size]
    return rows + [(5000 + i, v) for i, v in enumerate(bad)]


def plain(rows, weights="counts"):
    good = [(i, v) for i, v in rows if v and len(v) == 12 and all(c is not None and math.isfinite(c) and abs(c) < 1e20 for c in v)]
    x = np.floor(1024 * np.array([np.float32(v).astype(np.float64) for _, v in good])).astype(np.int64) + 100_000
    fit = x if weights == "counts" else np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, s, strict=True)) for r in x]
    return good, n, deviation, (x - s / n) @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_rows_are_those_of_numpy(spark, weights):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("component", "n", "id", "key", "whitened")}).repartition(5)
    got = whitening.whitened(df, weights=weights).collect()
    good, n, deviation, z, share = plain(rows, weights)
    assert len(got) == 8 * len(good)
    want: dict = {}
    for (i, _), d, line in zip(good, deviation, z, strict=True):
        want.setdefault(i, []).append((d, line))
    signs = {}
    for r in sorted(got, key=lambda r: (r["vec_id"] is None, r["vec_id"])):
        k = r["component"] - 1
        near = [(d, line) for d, line in want[r["vec_id"]] if d == int(r["deviation"]) and abs(abs(line[k]) - abs(r["whitened"])) < 1e-6]
        assert near and r["n"] == n and abs(r["explained"] / share[k] - 1) < 1e-9 and r["identity_error"] < 1e-9
        if abs(r["whitened"]) > 1e-3 and len(want[r["vec_id"]]) == 1:
            signs.setdefault(k, set()).add(np.sign(r["whitened"]) == np.sign(near[0][1][k]))
    assert all(len(s) == 1 for s in signs.values())


def test_edge_cases(spark):
    empty = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)
    flat = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], SCHEMA)).collect()
    assert sorted((r["component"], None if r["whitened"] is None else round(abs(r["whitened"]), 9)) for r in flat) == [(1, 1.0), (1, 1.0), (2, None), (2, None)]
    large = whitening.whitened(spark.createDataFrame([(1, [1e11, 2.0]), (2, [-1e11, 2.0]), (3, [1e11, 2.0])], SCHEMA)).filter("component = 1").collect()
    xs = [math.floor(1024 * float(np.float32(v))) + 100_000 for v in (1e11, -1e11, 1e11)]
    assert {int(r["deviation"]) for r in large} == {(3 * x - sum(xs)) ** 2 for x in xs}
