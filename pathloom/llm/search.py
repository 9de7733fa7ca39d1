"""Exact top-k search by inner product: cover trees over queries and over data, walked together.

The upper levels of the tree are Spark's: in rounds, every node with too many rows draws a few of them as centres and
deals its rows to the nearest, until nodes are blocks. Queries keep the places that they have as data, so both sides
share the nodes, whose balls are merged upwards from the blocks. Each block has an in-memory cover tree below.

A first pass searches each block's queries in their own block. The kth scores found there prune the walk over pairs of
nodes, which goes down level by level from the pair of roots: only pairs whose balls can still reach the worst kth
score of the query node are opened, so pairs of blocks are never all made. In a pair of blocks the two trees are
walked the same way.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import discard, spread_join, written

#: Children of a node, rows in a block, rows for each centre of an in-memory tree.
FAN, BLOCK_ROWS, LEAF = 16, 8192, 48
#: Rows of a node that a task deals to its children at a time.
ROWS_A_SALT = 100_000
#: Query blocks that meet one copy of a data block.
CHUNK = 64
#: Below every score.
LOWEST = -(2**62)


@dataclass
class Node:
    """Rows [lo, hi) of the tree's order, all within ``radius`` of ``center``, which is row ``at``.

    ``level`` l: the children's centres are within 2^(l + 1) of this one, farther than 2^l from each other and from
    those of all other nodes of that level, and this one is the first of them.
    """

    lo: int
    hi: int
    center: np.ndarray
    radius: float
    level: int = 0
    at: int = 0
    children: list[Node] = field(default_factory=list)

    def fan(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centres, radii and the centres' lengths of the children, kept once made."""
        if self.made is None:
            centers = np.stack([c.center for c in self.children])
            self.made = centers, np.array([c.radius for c in self.children]), np.sqrt((centers**2).sum(axis=1))
        return self.made

    made: tuple | None = None


class CoverTree:
    """A cover tree over the rows of a matrix; ``order`` puts the rows of each node side by side.

    Centres are taken farthest first. Those taken while the largest distance to a centre exceeds 2^l are the nodes of
    level l: they are separated by more than 2^l, cover all rows within it, and stay centres on all levels below. A
    new centre's parent is the nearest one of the level above. There is a centre for about every ``LEAF`` rows, more
    where they crowd, and below the last level each row belongs to its nearest centre.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int | None = None):
        self.leaf = leaf or LEAF
        x = rows.astype(np.float64)
        chosen, reach, parent = self._centers(x)
        levels = [1 << 40 if np.isinf(r) else int(np.ceil(np.log2(r))) - 1 for r in reach]
        kids: list[list[int]] = [[] for _ in chosen]
        for k in range(1, len(chosen)):
            kids[parent[k]].append(k)
        members = np.split(np.argsort(self.owner, kind="stable"), np.cumsum(np.bincount(self.owner, minlength=len(chosen)))[:-1])
        order: list[np.ndarray] = []

        def grow(k: int, mine: list[int], lo: int) -> Node:
            """The node of centre ``k`` with the children ``mine`` and, on lower levels, itself."""
            node = Node(lo, lo, x[chosen[k]], 0.0, -(1 << 40), chosen[k])
            if not mine:
                order.append(members[k])
                node.hi += len(members[k])
                return node
            node.level = max(levels[c] for c in mine)
            for c, below in [(k, [c for c in mine if levels[c] < node.level])] + [(c, kids[c]) for c in mine if levels[c] == node.level]:
                node.children.append(grow(c, below, node.hi))
                node.hi = node.children[-1].hi
            return node

        def measure(node: Node) -> None:
            node.radius = float(np.sqrt(((x[self.order[node.lo : node.hi]] - node.center) ** 2).sum(axis=1)).max(initial=0.0))
            for c in node.children:
                measure(c)

        self.root = grow(0, kids[0], 0) if chosen else Node(0, 0, np.zeros(x.shape[1]), 0.0)
        self.order = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        measure(self.root)
        self.ids, self.rows = ids[self.order], rows[self.order]

    def _centers(self, x: np.ndarray) -> tuple[list[int], list[float], list[int]]:
        """Rows taken as centres, their distances from those before, and their parents; ``owner`` is each row's nearest."""
        n = len(x)
        self.owner = np.zeros(n, dtype=np.int64)
        if not n:
            return [], [], []
        square = (x**2).sum(axis=1)
        best, upper = np.full(n, np.inf), np.zeros(n, dtype=np.int64)  # nearest centre now, and nearest of the level above
        chosen, reach, parent, far, distance = [], [], [], 0, np.inf
        level = None
        while True:
            now = None if np.isinf(distance) else int(np.ceil(np.log2(distance))) - 1
            if now != level:
                upper, level = self.owner.copy(), now
            chosen.append(far)
            reach.append(float(distance))
            parent.append(int(upper[far]))
            d = np.sqrt(np.maximum(square - 2 * (x @ x[far]) + square[far], 0.0))
            d[far] = 0.0
            nearer = d < best
            best[nearer], self.owner[nearer] = d[nearer], len(chosen) - 1
            far = int(best.argmax())
            distance = best[far]
            small = len(chosen) * self.leaf >= n and np.bincount(self.owner).max() <= 4 * self.leaf
            if distance == 0.0 or small or len(chosen) * self.leaf >= 4 * n:
                return chosen, reach, parent


def _pad(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


class Best:
    """The k best (score, id) of each query so far: higher scores first, smaller ids among equal ones."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((n, k), LOWEST)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, lo: int, hi: int) -> float:
        """A score that some query of [lo, hi) still has to reach; below it nothing matters to the group."""
        return float(np.maximum(self.score[lo:hi, -1], self.floor[lo:hi]).min())

    def limits(self, lo: int, hi: int) -> np.ndarray:
        """For each query of [lo, hi) the score that still matters to it."""
        return np.maximum(self.score[lo:hi, -1], self.floor[lo:hi])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores of the queries ``rows``, whose ids are ``own``, with the data ``ids``."""
        same = ids[None, :] == own[:, None]
        if same.any():
            scores = np.where(same, LOWEST, scores)
        limit = np.maximum(self.score[rows, -1], self.floor[rows])
        for i in np.flatnonzero((scores >= limit[:, None]).any(axis=1)):
            take, at = np.flatnonzero(scores[i] >= limit[i]), rows[i]
            s, d = np.r_[self.score[at], scores[i, take]], np.r_[self.id[at], ids[take]]
            top = np.lexsort((d, -s))[: self.k]
            self.score[at], self.id[at] = s[top], d[top]


def dual_search(queries: CoverTree, data: CoverTree, best: Best) -> None:
    """Walk both trees together; a pair of nodes is left when its largest possible score is below the group's worst kth."""
    width = max(queries.rows.shape[1], data.rows.shape[1])
    q, c = _pad(queries.rows, width), _pad(data.rows, width)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width < 2**52
    qf, cf = (q.astype(np.float64), c.astype(np.float64)) if exact else (q, c)

    length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))

    def bounds(a: Node, centers: np.ndarray, radii: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Largest possible scores of the rows of ``a`` with those of other nodes."""
        n = min(len(a.center), centers.shape[1])
        reach = centers[:, :n] @ a.center[:n] + np.linalg.norm(a.center) * radii + lengths * a.radius + a.radius * radii
        return reach + 1e-6 * (np.abs(reach) + 1.0)

    first = data.root
    stack = [(float(bounds(queries.root, first.center[None, :], np.array([first.radius]), np.array([np.linalg.norm(first.center)]))[0]), queries.root, first)]
    while stack:
        reach, a, b = stack.pop()
        worst = best.worst(a.lo, a.hi)
        if reach < worst:
            continue
        if not a.children and not b.children:
            # Each query of the group for itself: what the ball can reach against its own kth score.
            n = len(b.center)
            most = q[a.lo : a.hi, :n].astype(np.float64) @ b.center + length[a.lo : a.hi] * b.radius
            rows = a.lo + np.flatnonzero(most + 1e-6 * (np.abs(most) + 1.0) >= best.limits(a.lo, a.hi))
            if len(rows):
                scores = np.rint(qf[rows] @ cf[b.lo : b.hi].T).astype(np.int64) if exact else qf[rows] @ cf[b.lo : b.hi].T
                best.add(rows, scores, data.ids[b.lo : b.hi], queries.ids[rows])
            continue
        # The wider ball is opened, so that both sides come down together; the most promising pair is taken first.
        if a.children and (a.radius > b.radius or not b.children):
            found, pairs = bounds(b, *a.fan()), [(x, b) for x in a.children]
        else:
            found, pairs = bounds(a, *b.fan()), [(a, y) for y in b.children]
        stack += [(float(found[i]), *pairs[i]) for i in np.argsort(found, kind="stable") if found[i] >= worst]


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component; rows that are null or hold null or non-finite ones are left out."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    width = max(map(len, column), default=0)
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _dump(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _placed(rows: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """``vec_id, v, block``: the leaf of each row in a tree of ``FAN`` children a node, and the tree's depth.

    A round deals the rows of every node with more than ``block_rows`` to the nearest of ``FAN`` of them, drawn by a
    hash; ties go in turn, so that repeated vectors and rows are dealt over all. Numbers of children are appended to
    that of the node. Rows of one node are many tasks.
    """
    now, depth = written(rows.withColumn("block", F.lit(0).cast("long"))), 0
    total = now.count()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers = np.zeros((0, 0))
        for batch in batches:
            heads = np.flatnonzero(batch["centers"].notna())
            for lo, hi in zip(np.r_[0, heads], np.r_[heads, len(batch)]):
                if lo < hi and batch["centers"].iloc[lo] is not None:
                    centers, lo = _matrix(pd.Series(list(batch["centers"].iloc[lo]))).astype(np.float64), lo + 1
                if lo == hi:
                    continue
                part = batch.iloc[lo:hi]
                x = _matrix(part["v"]).astype(np.float64)
                width = max(x.shape[1], centers.shape[1])
                c = _pad(centers, width)
                away = (c**2).sum(axis=1)[None, :] - 2 * _pad(x, width) @ c.T
                tied = away == away.min(axis=1, keepdims=True)
                rank = np.cumsum(tied, axis=1)
                pick = np.arange(lo, hi) % rank[:, -1] + 1
                yield pd.DataFrame({"vec_id": part["vec_id"].astype("int64"), "v": part["v"], "block": part["block"] * FAN + (tied & (rank == pick[:, None])).argmax(axis=1)})

    while True:
        sizes = written(now.groupBy("block").agg(F.count(F.lit(1)).alias("n")))
        big = sizes.filter(F.col("n") > block_rows)
        if not big.limit(1).count():
            discard(sizes)
            return now, depth
        if depth == 14:
            raise RuntimeError("the tree of blocks is deeper than 64-bit numbers allow")
        draw = F.xxhash64(F.lit(depth), "vec_id", "v")
        mine = spread_join(now, written(big.select("block", F.col("n").alias("size"), F.col("n").alias("weight"))), ["block"], "weight", total)
        # About FAN of each node by hash, exactly FAN by rank, so that no node's rows meet in one task.
        some = mine.withColumn("draw", draw).filter(F.pmod("draw", F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / F.lit(8 * FAN)))) == 0)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("draw", "vec_id"))).filter(F.col("rank") <= FAN)
        salts = (F.col("size") / ROWS_A_SALT).cast("long") + 1
        centers = written(ranked.groupBy("block").agg(F.sort_array(F.collect_list("v")).alias("centers"), F.first("size").alias("size")))
        # Every (node, salt) is a run of rows behind its centres, so these are sent once to each.
        heads = centers.select("block", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<long>").alias("v"), "centers")
        runs = mine.select("block", F.pmod(F.xxhash64("v", "vec_id"), salts).alias("salt"), "vec_id", "v", F.lit(None).cast("array<array<bigint>>").alias("centers"))
        runs = heads.unionByName(runs).repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("centers").isNull())
        opened = runs.mapInPandas(nearest, "vec_id long, v array<long>, block long")
        closed = now.join(centers.select("block"), "block", "left_anti").select("vec_id", "v", (F.col("block") * FAN).alias("block"))
        done, now = now, written(opened.unionByName(closed))
        discard(done, sizes, centers)
        depth += 1


def _bounds() -> str:
    return "block long, n long, center array<double>, radius double, worst double, data binary"


def _blocks(rows: DataFrame, with_floor: bool) -> DataFrame:
    """A row for each block: its ball, the smallest floor of its queries, and its vectors."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        x = _matrix(group["v"])
        center = x.mean(axis=0)
        radius = float(np.sqrt(((x - center) ** 2).sum(axis=1)).max())
        floor = group["floor"].to_numpy(np.int64) if with_floor else np.zeros(0, dtype=np.int64)
        blob = _dump(ids=group["vec_id"].to_numpy(np.int64), rows=x, floor=floor)
        return pd.DataFrame({"block": [key[0]], "n": [len(x)], "center": [center], "radius": [radius], "worst": [float(floor.min()) if with_floor else 0.0], "data": [blob]})

    return rows.groupBy("block").applyInPandas(build, _bounds())


def _searched(pairs: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Search every pair (``block, chunk, queries``) of a data block and a block of queries: ``query_id, vec_id, score``."""
    copies = pairs.select("block", "chunk").distinct().join(data.select("block", "data"), "block").toDF("data_block", "copy", "data")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            d = np.load(io.BytesIO(left["data"].iloc[0]))
            tree = CoverTree(d["ids"], d["rows"])
            for blob in right["queries"]:
                b = np.load(io.BytesIO(blob))
                asked = CoverTree(b["ids"], b["rows"])
                best = Best(len(asked.ids), k, b["floor"][asked.order])
                dual_search(asked, tree, best)
                row, col = np.nonzero(best.id != np.iinfo(np.int64).max)
                out.append(pd.DataFrame({"query_id": asked.ids[row], "vec_id": best.id[row, col], "score": best.score[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return copies.groupBy("data_block", "copy").cogroup(pairs.groupBy("block", "chunk")).applyInPandas(search, "query_id long, vec_id long, score long")


def _reach(q: str, c: str) -> Column:
    """Largest possible inner product of vectors in two balls."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with(f"{q}.center", f"{c}.center", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    qr, cr = F.col(f"{q}.radius"), F.col(f"{c}.radius")
    reach = dot + norm(F.col(f"{q}.center")) * cr + norm(F.col(f"{c}.center")) * qr + qr * cr
    return reach + F.lit(1e-6) * (F.abs(reach) + F.lit(1.0))


def _balls(blocks: DataFrame, depth: int) -> list[DataFrame]:
    """Balls of the nodes of every level, the root first: ``block, center, radius, worst``, merged upwards from blocks."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")  # at most FAN rows
        width = max(map(len, group["center"]))
        c = np.stack([np.pad(np.asarray(x), (0, width - len(x))) for x in group["center"]])
        center = np.average(c, axis=0, weights=group["n"])
        radius = float((np.sqrt(((c - center) ** 2).sum(axis=1)) + group["radius"].to_numpy()).max())
        return pd.DataFrame({"block": [key[0]], "n": [int(group["n"].sum())], "center": [center], "radius": [radius], "worst": [float(group["worst"].min())]})

    schema = "block long, n long, center array<double>, radius double, worst double"
    levels = [blocks.select("block", "n", "center", "radius", "worst")]
    for _ in range(depth):
        up = F.floor(F.col("block") / FAN).alias("up")
        levels.append(written(levels[-1].select(up, "*").groupBy("up").applyInPandas(merge, schema)))
    return levels[::-1]


def _open_pairs(asked: list[DataFrame], data: list[DataFrame]) -> DataFrame:
    """Pairs ``query_block, block`` of blocks, not their own, that can hold scores as good as the worst kth ones."""
    side = lambda df, key, name: df.select(F.col("block").alias(key), F.struct("center", "radius", "worst").alias(name))
    pairs = asked[0].select(F.col("block").alias("query_block"), "block")  # both roots have the number 0
    for i in range(len(data)):
        if i:
            below = lambda key: F.explode(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda j: F.col(key) * FAN + j)).alias(key)
            pairs = pairs.select("query_block", below("block")).join(side(data[i], "block", "c"), "block")
            pairs = pairs.select("block", "c", below("query_block"))
        else:
            pairs = pairs.join(side(data[i], "block", "c"), "block")
        pairs = pairs.join(side(asked[i], "query_block", "q"), "query_block")
        pairs = written(pairs.filter(_reach("q", "c") >= F.col("q.worst")).select("query_block", "block"))
    return pairs.filter("query_block <> block")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` best other rows of each query of ``vectors(vec_id, embedding)``: ``query_id, rank, vec_id, score``.

    All of them, if there are fewer; ties go to the smaller vec_id. Shorter vectors count as padded with zeros. A
    query never finds rows of its own vec_id; of a repeated query id the smallest vector is asked, and repeated rows
    are candidates once each. Null and non-finite vectors and those with null components take no part as queries or
    candidates, nor do rows without a vec_id; an empty vector scores 0 everywhere. Extra columns are ignored. No rows
    give no rows.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed, depth = _placed(quantised(vectors, scale), block_rows)
    data = written(_blocks(placed, False))
    asked = written(placed.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "block")).alias("s")).select("vec_id", "s.v", "s.block"))
    if not asked.limit(1).count():
        return empty
    lowest = F.lit(LOWEST + 1).cast("long")
    first = _blocks(asked.withColumn("floor", lowest), True).select("block", F.lit(0).alias("chunk"), F.col("data").alias("queries"))
    found = written(_searched(first, data, k))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    better = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", lowest))
    queries = written(_blocks(better, True))
    pairs = written(_open_pairs(_balls(queries, depth), _balls(data, depth)))
    # A data block that meets many query blocks is copied for each CHUNK of them.
    meets = written(pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"), F.count(F.lit(1)).alias("weight")))
    dealt = spread_join(pairs, meets, ["block"], "weight", pairs.count()).withColumn("chunk", F.pmod(F.xxhash64("query_block"), F.col("chunks")).cast("int"))
    sent = dealt.join(queries.select(F.col("block").alias("query_block"), F.col("data").alias("queries")), "query_block")
    rest = _searched(sent.select("block", "chunk", "queries"), data, k)
    best = found.unionByName(rest).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _op6(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.pmod("vec_id", F.lit(50)) == 0)


_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
 FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

QUERIES = {"op6_search": _op6}
ORACLE_SQL = {"op6_search": _SQL}
