"""N-gram Jaccard join by PartEnum signatures, and the groups of near duplicates that its links make.

Sets of word shingles fall into size bands. Two sets that are similar enough differ in at most k shingles, k being
known for each band, so if the domain of shingles is cut into partitions, the two agree on some subset of them; every
set sends a signature for each of the enumerated subsets. Equal signatures make candidates, which a parity sketch
(a lower bound of the difference) and then the texts themselves confirm or refute.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.llm.common import discard, share_of, small_batches, spread_join, written

N_WORDS = 5
#: Similarity as a fraction: links have 100 * intersection >= 80 * union.
PERCENT = 80
#: 64-bit words of the parity sketch.
SKETCH = 16
#: A signature should hold about so many shingles, to be shared by chance only.
WIDE = 2.5
#: A link is missed with a probability below exp(-SAFE), where partitions are fewer than the differences. The exact
#: setting never has fewer, so it misses none; it sends about twice the signatures of long texts.
SAFE, EXACT = 28.0, math.inf
#: Components in a bucket from which it is searched by its rare shingles instead of by pairs.
CROWD = 64
#: Documents that tell frequent signatures and shingles, and how many of these are dealt over many tasks or come last.
PROBE, HOT_SIGNATURES, LATE_PROBE, LATE_SHINGLES = 20_000, 2048, 1000, 16_384
#: Partners that meet one copy of a hub's set.
HUB_PARTNERS = 64
#: Sets that a task remembers, so that copies are sent once; beyond, it forgets all and starts anew.
REMEMBERED = 500_000
#: Ids up to this number (8 bytes each) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_U = np.uint64
_BASE = 0x5851F42D4C957F2D
_TURN = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray, turn: int = 0) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _TURN[turn]
    x = (x ^ (x >> _U(29))) * _TURN[(turn + 1) % 5]
    return x ^ (x >> _U(32))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _U(_BASE)), np.full(n, _U(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word; A-Z count as a-z, words end at the bytes 32 and 9 to 13."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = np.concatenate([[False], ~gap, [False]])
    first, after = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    low = raw.astype(np.uint64) + np.where((raw >= 65) & (raw <= 90), _U(33), _U(1))
    size = 1 << max(16, (len(raw) + 1).bit_length())
    up, down = _powers(size)
    sums = np.concatenate([[_U(0)], np.cumsum(low * up[: len(raw)])])
    return _mix((sums[after] - sums[first]) * down[first] + (after - first).astype(np.uint64), 1), first


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (64 bits) of each whole text; empty without words."""
    group: list[bytes] = []

    def flush() -> Iterator[np.ndarray]:
        raw = np.frombuffer(b"\n".join([*group, b""]), dtype=np.uint8)
        words, first = _word_hashes(raw)
        runs = words * _TURN[0]
        for j in range(1, N_WORDS):
            runs[:-j] += words[j:] * (_TURN[j] + _U(2 * j))
        runs = _mix(runs, 2)
        lo = 0
        for hi in np.searchsorted(first, np.cumsum([len(g) + 1 for g in group])):
            if hi - lo >= N_WORDS:
                out = np.sort(runs[lo : hi - N_WORDS + 1])
                new = np.empty(len(out), dtype=bool)
                new[0] = True
                np.not_equal(out[1:], out[:-1], out=new[1:])
                yield out[new]
            else:
                one = [sum((int(x) * int(t) for x, t in zip(words[lo:hi], _TURN)), 7 * int(hi - lo)) % (1 << 64)] if hi > lo else []
                yield _mix(np.array(one, dtype=np.uint64), 2)
            lo = hi

    held = 0
    for t in texts:
        group.append(t.encode("utf-8", "surrogatepass"))
        held += len(group[-1])
        if held >= 1 << 18:
            yield from flush()
            group, held = [], 0
    if group:
        yield from flush()


class Scheme:
    """Signatures of one band: pairs whose smaller set has ``low`` to ``high`` shingles.

    ``kind`` subsets: the finest partition, single shingles in hash order; any ``t`` of a set's first ones. ``kind``
    groups: ``n1`` groups of ``n2`` partitions (equal ranges of the hashed domain), in each all subsets of n2 - k2 of
    them. With n1 * (k2 + 1) > k some group has at most k2 differences, so one of its subsets agrees; as there are
    ``spare`` more groups, at least spare + 1 agree. So signatures of frequent shingles only (``late``) are left out, unless
    a set has more groups with such than spare ones; then those without any shingle, under the same condition. Content
    tells which these are, so of the agreeing groups one at least is left that both sets send.
    For large k fewer partitions than differences do: at least one agrees but for a chance below exp(-safe). There only
    signatures without any shingle are left out.
    """

    def __init__(self, number: int, low: int, high: int, safe: float = SAFE):
        self.low, self.high, self.number = low, high, number
        most = high * 100 // PERCENT
        self.k = (high + most) * (100 - PERCENT) // (100 + PERCENT)
        self.kind, self.n1, self.n2, self.k2, self.spare, self.t = "none", 0, 1, 0, 0, 0
        if not self.k:
            return  # only equal sets are similar enough
        if low < 48:
            self.kind = "subsets"
            room = most - -(-most * PERCENT // 100)
            self.t = max(t for t in range(1, 5) if t <= max(1, low * PERCENT // 100) and (t == 1 or math.comb(room + t, t) <= 72))
            return
        self.kind = "groups"
        choices = []
        for k2, n2 in ((0, 1), (1, 3), (2, 4), (2, 5)):
            base = self.k // (k2 + 1) + 1
            spare = max(2, -(-base // 10))
            n1 = base + spare
            wide = low * (n2 - k2) / (n2 * n1)
            choices.append((wide < WIDE, n1 * math.comb(n2, k2) if wide >= WIDE else -wide, n1, n2, k2, spare))
        n = next((n for n in range(1, self.k + 2) if n * math.exp(-self.k / n) >= safe), None)
        if n:
            choices.append((low / n < WIDE, n if low / n >= WIDE else -low / n, n, 1, 0, n))
        _, _, self.n1, self.n2, self.k2, self.spare = min(choices)
        self.bounds = np.array([i * (1 << 64) // (self.n1 * self.n2) for i in range(1, self.n1 * self.n2)], dtype=np.uint64)
        self.subsets = [list(c) for c in combinations(range(self.n2), self.n2 - self.k2)]
        salts = np.arange(self.n1 * len(self.subsets), dtype=np.uint64).reshape(len(self.subsets), self.n1)
        self.salts = _mix(salts * _U(1 << 20) + _U(number * 2 + 1), 3)

    def signatures(self, s: np.ndarray, mixed: np.ndarray, order: np.ndarray | None = None, rare: np.ndarray | None = None) -> np.ndarray:
        """Signatures of the sorted set; ``order`` of its first shingles, and ``rare``: which of its shingles are not frequent."""
        if self.kind == "subsets":
            size = len(s)
            first = size - -(-size * PERCENT // 100) + self.t
            if first > size:
                return np.zeros(0, dtype=np.uint64)
            own = mixed[:first] if order is None else mixed[order[:first]]
            return _mix(own[_choices(first, self.t)].sum(axis=1) + _U(self.number), 4)
        if self.kind == "none":
            return np.zeros(0, dtype=np.uint64)
        cuts = np.searchsorted(s, self.bounds)
        ends = np.concatenate([[0], cuts, [len(s)]])
        sums = np.concatenate([[_U(0)], np.cumsum(mixed)])
        part = (sums[ends[1:]] - sums[ends[:-1]]).reshape(self.n1, self.n2)
        content = part.T if self.n2 == 1 else np.stack([part[:, c].sum(axis=1) for c in self.subsets])
        signs = _mix(content + self.salts, 4)

        def counted(upto: np.ndarray) -> np.ndarray:
            size = np.diff(upto[ends]).reshape(self.n1, self.n2)
            return (size.T if self.n2 == 1 else np.stack([size[:, c].sum(axis=1) for c in self.subsets])) > 0

        if rare is not None and self.spare < self.n1:
            telling = counted(np.concatenate([[0], np.cumsum(rare)]))
            if (~telling).any(axis=0).sum() <= self.spare:
                return signs[telling]
        filled = counted(np.arange(len(s) + 1))
        return signs.ravel() if (~filled).any(axis=0).sum() > self.spare else signs[filled]


@lru_cache(64)
def _choices(n: int, t: int) -> np.ndarray:
    return np.array(list(combinations(range(n), t)), dtype=np.int64)


@lru_cache(4096)
def _scheme(number: int, safe: float = SAFE) -> Scheme:
    low = 1
    for _ in range(number):
        low = low * 100 // PERCENT + 1
    return Scheme(number, low, low * 100 // PERCENT, safe)


def band(size: int) -> int:
    """Number of the band of sets of ``size`` shingles; partners of a pair are in the same or in neighbouring bands."""
    number = 0
    while _scheme(number).high < size:
        number += 1
    return number


def is_late(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Which of the set's shingles are among the sorted ``late``."""
    return late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s if len(late) else np.zeros(len(s), dtype=bool)


def late_order(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Places of the set's shingles in the order of their hashes, those among the sorted ``late`` behind all others."""
    frequent = is_late(s, late)
    return np.concatenate([np.flatnonzero(~frequent), np.flatnonzero(frequent)])


def signatures(s: np.ndarray, safe: float = SAFE, late: np.ndarray | None = None) -> np.ndarray:
    """All signatures of a set: those of its own band, and those of the band before, for smaller partners there.

    First shingles are those in the order of ``late_order``; any order will do that is the same for all sets.
    """
    if not len(s):
        return np.zeros(0, dtype=np.uint64)
    mixed, own = _mix(s, 0), band(len(s))
    small = any(_scheme(b, safe).kind == "subsets" for b in (own, max(0, own - 1)))
    order = late_order(s, late) if small and late is not None else None
    rare = ~is_late(s, late) if late is not None and len(late) else None
    out = [_scheme(own, safe).signatures(s, mixed, order, rare)]
    if own and len(s) * PERCENT <= _scheme(own - 1).high * 100:
        out.append(_scheme(own - 1, safe).signatures(s, mixed, order, rare))
    return np.concatenate(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the shingles that fall on each of 1,024 bits, as signed 64-bit words."""
    bits = np.bincount((_mix(s, 3) >> _U(64 - 10)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < max(len(a), len(b)) * PERCENT:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _texts(batch: pd.DataFrame, name: str = "text") -> list[str]:
    return [t if isinstance(t, str) else "" for t in batch[name]]


def profiles(docs: DataFrame) -> DataFrame:
    """``doc_id, n, h1, h2, s0..s15``: size, 128-bit identity and parity sketch of every document's set."""
    names = ["doc_id", "n", "h1", "h2", *[f"s{i}" for i in range(SKETCH)]]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s in shingle_sets(_texts(batch)):
                h1, h2 = (int(_mix(s, j).sum(dtype=np.uint64).astype(np.int64)) for j in (1, 4))
                rows.append((len(s), h1, h2, *sketch(s).tolist()))
            out = pd.DataFrame(rows, columns=names[1:], dtype="int64")
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    schema = ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(measure, schema)


def signature_rows(docs: DataFrame, safe: float = SAFE, late: np.ndarray | None = None) -> DataFrame:
    """``sig, doc_id``: signatures of every set; of the last ``REMEMBERED`` sets a task sends none again."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[tuple[int, int]] = set()
        for batch in batches:
            sigs, ids, held = [], [], 0
            for doc_id, s in zip(batch["doc_id"].tolist(), shingle_sets(_texts(batch))):
                key = (len(s), int(s.sum(dtype=np.uint64)) ^ int(_mix(s, 1).sum(dtype=np.uint64)) << 64) if len(s) else None
                if key is None or key in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(key)
                sigs.append(signatures(s, safe, late))
                ids.append(doc_id)
                held += len(sigs[-1])
                if held > 200_000:
                    yield frame(sigs, ids)
                    sigs, ids, held = [], [], 0
            if sigs:
                yield frame(sigs, ids)

    def frame(sigs: list[np.ndarray], ids: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"sig": np.concatenate(sigs).view(np.int64), "doc_id": np.repeat(np.asarray(ids, dtype=np.int64), [len(x) for x in sigs])})

    named = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInPandas(send, "sig long, doc_id long")


def _near_enough(a: str, b: str) -> Column:
    """Sizes and sketches allow the similarity: differing parities are at least so many differing shingles."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    odd = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT) & (odd * (100 + PERCENT) <= (na + nb) * (100 - PERCENT))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids(doc_id)``: few ids are broadcast, so that the other texts are not shuffled."""
    few = ids.count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (``a, b``) of ids whose texts are similar enough by their sets.

    Partners of ``a`` are dealt over salts of about ``HUB_PARTNERS``; the text of ``a`` is sent once to each salt, and that
    of ``b`` once to each pair. Within a salt sets are read as a stream, the hub's first, so memory holds two of them.
    """
    pairs = written(pairs)
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    texts = _texts_of(docs, ids)
    room = written(pairs.groupBy("a").agg((F.count(F.lit(1)) / HUB_PARTNERS).cast("int").alias("salts")))
    dealt = pairs.join(room, "a")
    right = dealt.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts") + 1)).select("a", "salt", "b").join(texts.toDF("b", "text"), "b")
    left = room.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long"))).alias("salt"), F.lit(None).cast("long").alias("b")).join(texts.toDF("a", "text"), "a")
    both = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, hubs = None, []
        for batch in batches:
            keep = []
            for key, partner, s in zip(zip(batch["a"].tolist(), batch["salt"].tolist()), batch["b"].notna().tolist(), shingle_sets(_texts(batch))):
                if key != at:
                    at, hubs = key, []
                if partner:
                    keep.append(any(similar(h, s) for h in hubs))
                else:
                    hubs.append(s)
                    keep.append(False)
            yield batch.loc[keep, ["a", "b"]].astype("int64")

    return written(both.mapInPandas(compare, "a long, b long").distinct())


def frequent_shingles(docs: DataFrame, total: int) -> np.ndarray:
    """At most ``LATE_SHINGLES`` shingles that are frequent among about ``LATE_PROBE`` of ``total`` documents, sorted.

    They come last where first shingles are taken, so that a passage of many documents makes no bucket of them. They
    order shingles only: results are the same whatever the sample holds.
    """
    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in shingle_sets(_texts(batch)):
                yield pd.DataFrame({"g": s.view(np.int64)})

    some = docs.filter(share_of(F.xxhash64(F.lit(37), F.col("doc_id")), F.lit(min(1.0, LATE_PROBE / max(1, total)))))
    often = some.select(F.col("text").cast("string").alias("text")).mapInPandas(shingles, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 4")
    return np.sort(np.asarray([r["g"] for r in often.orderBy(F.desc("c"), "g").limit(LATE_SHINGLES).collect()], dtype=np.int64).view(np.uint64))


def _by_rare_shingles(docs: DataFrame, members: DataFrame, late: np.ndarray) -> DataFrame:
    """Pairs of ``members(doc_id, component)`` of different components that share one of their first shingles.

    Two sets that are similar enough share a shingle among the n - ceil(0.8 n) + 1 first ones of each in any order
    that is the same for all, here that of ``late_order``. Sketches are compared in the join.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(members) if members.count() <= BROADCAST_IDS else members, "doc_id")
    names = ["doc_id", "component", "n", *[f"s{i}" for i in range(SKETCH)]]

    def first_ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams, rows, held = [], [], 0
            for doc_id, component, s in zip(batch["doc_id"].tolist(), batch["component"].tolist(), shingle_sets(_texts(batch))):
                n = len(s)
                grams.append(s[late_order(s, late)[: n - -(-n * PERCENT // 100) + 1]])
                rows.append((doc_id, component, n, *sketch(s).tolist()))
                held += len(grams[-1])
                if held > 50_000:
                    yield frame(grams, rows)
                    grams, rows, held = [], [], 0
            if rows:
                yield frame(grams, rows)

    def frame(grams: list[np.ndarray], rows: list[tuple]) -> pd.DataFrame:
        each = np.repeat(np.asarray(rows, dtype=np.int64), [len(g) for g in grams], axis=0)
        return pd.DataFrame({"g": np.concatenate(grams).view(np.int64), **{n: each[:, i] for i, n in enumerate(names)}})

    first = written(texts.select("doc_id", "component", "text").mapInPandas(first_ones, "g long, " + ", ".join(f"{n} long" for n in names)))
    x, y = first.alias("x"), first.alias("y")
    apart = (F.col("x.g") == F.col("y.g")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component"))
    return x.join(y, apart & _near_enough("x", "y")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every id in ``links(a, b)``: large and small stars in turn."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.filter("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u <> v").distinct()
        done, edges = edges, written(small)
        discard(large, done)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def joined(docs: DataFrame, safe: float = SAFE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Texts are lower-cased (A-Z), words are runs of other than white space; a text with fewer than five words is one
    shingle. Null and empty texts and those without words have no shingle and no link. Equal sets are one class and
    cost one set of signatures; classes are linked at a Jaccard similarity of 0.8 or more. Rows without a doc_id are
    counted but not linked (component null). Rows that share a doc_id are one node. Ties go to the smallest doc_id.
    Texts of any length are read whole; extra columns are ignored; an empty table gives no rows. ``safe=EXACT`` never
    uses fewer partitions than sets may differ in.

    In a bucket of equal signatures every set is first compared with the smallest id only, and only sets that are
    still in different components after that with each other; where these are many, by their rare shingles. So
    neither groups of copies nor passages that many documents share make all pairs.
    """
    sets = written(profiles(docs))
    named = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    total = sets.count()
    # Copies that a task of ``profiles`` meets are counted before the shuffle; a large class is broadcast.
    classes = written(named.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    member = written(spread_join(sets.select("doc_id", "n", "h1", "h2"), classes, ["n", "h1", "h2"], "copies", total, "left").select("doc_id", "n", "rep"))
    sketches = named.drop("h1", "h2")
    late = frequent_shingles(docs, total)
    shared = _shared(docs, total, safe, late)
    stars = shared.filter("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    side = lambda name: sketches.withColumnRenamed("doc_id", name).alias(name)
    stars = stars.join(side("a"), "a").join(side("b"), "b").filter(_near_enough("a", "b")).select("a", "b").distinct()
    copies = member.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    first = _confirmed(docs, stars)
    known = written(components(first.union(copies)))
    # What is left: buckets that hold several components.
    labelled = shared.join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labelled = written(labelled.select("sig", "doc_id", "component", "low"))
    mix = labelled.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    mix = written(mix.filter("lo < hi").select("sig", "size", F.col("size").alias("weight")))
    mixed = written(spread_join(labelled, mix, ["sig"], "weight", labelled.count()))
    crowd = written(mixed.filter(F.col("size") > CROWD).select("doc_id", "component").distinct())
    small = written(mixed.filter(F.col("size") <= CROWD).drop("size").join(sketches, "doc_id"))
    x, y = small.alias("x"), small.alias("y")
    apart = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component"))
    apart = apart & (F.col("x.doc_id") != F.col("x.low")) & (F.col("y.doc_id") != F.col("x.low"))
    rest = x.join(y, apart & _near_enough("x", "y")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    second = _confirmed(docs, rest.union(_by_rare_shingles(docs, crowd, late)).distinct())
    groups = written(components(first.union(copies).union(second)))
    discard(shared, labelled, mixed, small)
    # A class without links is a component of its own.
    out = member.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _shared(docs: DataFrame, total: int, safe: float, late: np.ndarray) -> DataFrame:
    """``sig, doc_id, low``: rows of signatures that several documents have, with the smallest doc_id among these.

    Signatures that are frequent in a sample of about ``PROBE`` documents are dealt over many tasks each, and what
    these found is put together again. The sample shapes the tasks only, never the result.
    """
    probe = signature_rows(docs.filter(share_of(F.xxhash64(F.lit(31), F.col("doc_id")), F.lit(min(1.0, PROBE / max(1, total))))), safe, late)
    often = probe.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter((F.col("c") * 512 > min(total, PROBE)) & (F.col("c") > 4))
    hot = written(often.orderBy(F.desc("c"), "sig").limit(HOT_SIGNATURES).select("sig", F.lit(True).alias("hot")))
    rows = signature_rows(docs, safe, late).join(F.broadcast(hot), "sig", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(256))))
    own = Window.partitionBy("sig", "salt")
    local = rows.withColumn("low", F.min("doc_id").over(own)).withColumn("high", F.max("doc_id").over(own))
    local = written(local.filter("hot or low < high").select("sig", "doc_id", "low", "high", "hot"))
    lowest = local.filter("hot").groupBy("sig").agg(F.min("low").alias("lowest"), F.max("high").alias("highest")).filter("lowest < highest").drop("highest")
    met = local.join(F.broadcast(written(lowest)), "sig", "left").filter("hot is null or lowest is not null")
    out = written(met.select("sig", "doc_id", F.coalesce("lowest", "low").alias("low")))
    discard(local)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each group of near duplicates; rows without an id stay.

    Of rows that repeat this doc_id one stays; only these rare ids take part in the shuffle that drops the others.
    """
    kept = written(joined(docs).filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")))

    def rows_of(ids: DataFrame) -> DataFrame:
        few = ids.count() <= BROADCAST_IDS
        return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    once, more = (rows_of(kept.filter(c).select("doc_id")) for c in ("times = 1", "times > 1"))
    return once.unionByName(more.dropDuplicates(["doc_id"])).unionByName(docs.filter(F.col("doc_id").isNull()))


def _op4(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
 HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id FROM s JOIN m ON m.a = s.doc_id"""

QUERIES = {"op4_jaccard": _op4}
ORACLE_SQL = {"op4_jaccard": _SQL}
