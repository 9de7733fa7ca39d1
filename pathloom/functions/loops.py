"""Iterations over DataFrames whose lineage is cut by tables in the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of tables that ``saved`` wrote, so that ``discard`` can remove them.
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: A key with at least this share of all rows is hot; there are at most so many hot keys.
HOT_KEYS = 512


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    A session in one process may have none, then a temporary folder is set. On a cluster executors would write to
    their own disks, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-loops-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write and reread in the shared folder."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of tables of ``saved`` that nothing reads any more, as those of the rounds before."""
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join with a table of one row per key, whose ``weight`` counts the rows of ``left`` that have the key.

    Keys that hold at least 1/HOT_KEYS of the ``total`` rows of ``left`` are at most HOT_KEYS, so they are broadcast;
    the other keys are joined by a shuffle in which no key can fill a task. ``left`` is read twice, and null keys
    match nothing. ``how`` is inner or left.
    """
    hot = F.col(weight) * F.lit(HOT_KEYS) >= F.lit(max(1, total)) if total > HOT_KEYS else F.lit(True)
    few = right.filter(hot)
    if total <= HOT_KEYS:
        return left.join(F.broadcast(few.drop(weight)), keys, how)
    marked = F.broadcast(few.drop(weight))
    loud = left.join(marked, keys)
    quiet = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(right.filter(~hot).drop(weight), keys, how)
    return loud.unionByName(quiet)


def _stars(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges as stars: every node of a connected part with its smallest one, ``key, smallest, node``, without that one itself."""
    keys, kc = np.unique(key, return_inverse=True)
    names, nc = np.unique(np.concatenate([a, b]), return_inverse=True)
    nodes, at = np.unique(np.tile(kc, 2) * len(names) + nc, return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(parent[u], parent[v]), np.maximum(parent[u], parent[v])
        apart = low != high
        u, v = u[apart], v[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return keys[nodes[moved] // len(names)], names[nodes[parent[moved]] % len(names)], names[nodes[moved] % len(names)]


def contracted(edges: DataFrame, key: str, most: int = 1 << 20) -> DataFrame:
    """Edges ``key, a, b`` with the same connected parts, shorter paths and often far fewer rows: each task makes stars of its edges.

    Edges are dealt by ranges, so a task has the neighbours of neighbours. It holds ``most`` edges at a time; what a task
    cannot join, the rounds of ``component_labels`` do. Keys and nodes are whole numbers without null.
    """
    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[list, ...] = ([], [], [])
        count = 0
        for batch in batches:
            for part, c in zip(held, (key, "a", "b"), strict=True):
                part.append(batch[c].to_numpy(dtype=np.int64))
            count += len(batch)
            if count >= most:
                star = _stars(*(np.concatenate(p) for p in held))
                if len(star[0]) >= most // 2:  # hardly shorter any more
                    yield pd.DataFrame(dict(zip((key, "a", "b"), star, strict=True)))
                    star = tuple(x[:0] for x in star)
                held, count = tuple([x] for x in star), len(star[0])
        if count:
            yield pd.DataFrame(dict(zip((key, "a", "b"), _stars(*(np.concatenate(p) for p in held)), strict=True)))

    rows = edges.select(F.col(key).cast("long").alias(key), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    return rows.repartitionByRange(key, F.least("a", "b")).mapInPandas(stars, f"{key} long, a long, b long")


def component_labels(nodes: DataFrame, edges: DataFrame, key: str = "image_id", most: int = 100) -> DataFrame:
    """Smallest node of each connected component: ``key, node, label``.

    Edges are contracted within tasks first. In a round every node with a smaller neighbour goes over to the smallest one, chains of
    such steps are walked by doubling jumps, and edges then join the nodes that are left. What is left of a component with
    several nodes halves in two rounds, whatever its shape, so rounds grow with the logarithm of its nodes; only nodes that
    have an edge take part.
    """
    left, moves = saved(contracted(edges, key).distinct()), []
    for _ in range(most):
        if not left.limit(1).count():
            break
        both = left.select(key, F.col("a").alias("node"), F.col("b").alias("label")).unionByName(left.select(key, F.col("b").alias("node"), F.col("a").alias("label")))
        new = now = saved(both.groupBy(key, "node").agg(F.min("label").alias("label")).filter("label < node"))
        while True:
            ahead = now.select(key, F.col("node").alias("label"), F.col("label").alias("over"))
            before, new = new, saved(now.join(ahead, [key, "label"], "left").select(key, "node", F.coalesce("over", "label").alias("label"), F.col("over").isNotNull().alias("moved")))
            discard(before)
            now = new.drop("moved")
            if not new.filter("moved").limit(1).count():
                break
        moves.append((new, now))
        rest = left
        for end in ("a", "b"):
            rest = rest.join(now.select(key, F.col("node").alias(end), "label"), [key, end], "left").withColumn(end, F.coalesce("label", end)).drop("label")
        before, left = left, saved(rest.filter("a <> b").select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(before)
    else:
        raise RuntimeError(f"components need more than {most} rounds")
    discard(left)
    if not moves:
        return nodes.select(key, "node", F.col("node").alias("label"))
    labels = moves[-1][1]
    for table, now in reversed(moves[:-1]):  # where a node went, and where that one went in later rounds
        later = labels.select(key, F.col("node").alias("label"), F.col("label").alias("last"))
        labels = now.join(later, [key, "label"], "left").select(key, "node", F.coalesce("last", "label").alias("label")).unionByName(labels)
        labels = saved(labels)
        discard(table)
    return nodes.select(key, "node").join(labels, [key, "node"], "left").select(key, "node", F.coalesce("label", "node").alias("label"))
