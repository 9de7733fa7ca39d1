"""Repeated strings of a fixed number of bytes in whole documents, by suffix arrays of shards.

Every window of ``window`` bytes of a text belongs to the smallest hash of the ``MARK``-byte strings inside it, so equal
windows belong to equal hashes. Neighbouring windows of one hash are a piece: rows of numbers, no text. Hashes seen once
have no repeated window, unless they are there twice within the one piece, as in periodic text. Those whose pieces are all the same text repeat as a whole. Only pieces of the others are cut
from their documents, each different one once, and dealt by hash to shards of a bounded size. A shard sorts its
suffixes by induced sorting, reads the common prefixes of neighbours in text order, and marks every window whose
neighbour agrees with it on all its bytes. A hash with too many different pieces for a shard has its windows counted by
their digests instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pathloom.functions.loops import HOT_KEYS
from pathloom.llm.common import discard, set_aside, small_batches, spread_join, written

#: Bytes of a string that counts as repeated, and of the strings whose smallest hash a window belongs to.
WINDOW, MARK = 400, 128
#: Windows of a piece at most, and bytes that are hashed at a time.
PIECE, CHUNK = 4096, 1 << 19
#: Bytes of a shard, and bytes of different pieces of one hash beyond which its windows are counted instead.
SHARD_BYTES, HASH_BYTES = 2 << 20, 1 << 20
#: A byte that UTF-8 never has ends each piece in a shard.
STOP = 0xFF
#: Symbols of an alphabet that is sorted bucket by bucket; names beyond are written as two digits.
SYMBOLS = 2048
#: Places of a shard whose common prefixes are compared at a time.
COMPARED = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_ZERO = np.zeros(1, np.int64)


# Suffix arrays ------------------------------------------------------------------------------------------------------


class Induction:
    """Places all suffixes of a string of small whole numbers, given an order of its leftmost smaller (LMS) ones.

    A suffix is smaller (S) if it sorts before the one after it, else larger (L); the end sorts before everything. The
    suffixes of a symbol form a bucket, larger ones first. A bucket is worked off at once: its known suffixes place
    those in front of them into other buckets, and runs of its own symbol follow in order of their length.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        self.text, n = text, len(text)
        wide, place = text.astype(np.int32), np.arange(n, dtype=np.int32)
        step = np.full(n, -1, np.int32)
        np.subtract(wide[1:], wide[:-1], out=step[:-1])
        at = np.where(step != 0, place, np.int32(n))
        self.smaller = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
        self.lms = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]) + 1
        first = np.ones(n, bool)
        first[1:] = text[1:] != text[:-1]
        self.run = place - np.maximum.accumulate(np.where(first, place, np.int32(0)))
        self.before = np.concatenate([np.array([-1], np.int16), text[:-1].astype(np.int16)])
        self.counts = np.bincount(text, minlength=symbols)
        self.large = np.bincount(text[~self.smaller], minlength=symbols)
        self.starts = np.cumsum(self.counts) - self.counts

    def _deal(self, out: np.ndarray, free: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray) -> None:
        """Put ``suffixes`` behind those that their buckets hold so far, keeping their order."""
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        edge = np.concatenate([_ZERO, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1, [len(order)]])
        sizes, met = edge[1:] - edge[:-1], symbols[edge[:-1]]
        at = free[met]
        out[np.repeat(at - edge[:-1], sizes) + np.arange(len(order))] = suffixes[order]
        free[met] = at + sizes

    def _runs(self, out: np.ndarray, free: np.ndarray, symbol: int, lo: int) -> np.ndarray:
        """Add the suffixes that lengthen a run of ``symbol`` before those of the bucket so far; all of them."""
        known = out[lo : free[symbol]]
        longer = self.run[known]
        total = int(longer.sum())
        if total:
            back = np.arange(total) - np.repeat(np.cumsum(longer) - longer, longer) + 1
            order = np.argsort(back, kind="stable")
            out[free[symbol] : free[symbol] + total] = (np.repeat(known, longer) - back)[order]
            free[symbol] += total
        return out[lo : free[symbol]]

    def array(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes in the order that ``lms`` induces."""
        n = len(self.text)
        out, free = np.empty(n, np.int32), self.starts.copy()
        ends = np.split(lms[np.argsort(self.text[lms].astype(np.uint16), kind="stable")], np.cumsum(np.bincount(self.text[lms], minlength=len(self.counts)))[:-1])
        last = int(self.text[-1])
        out[free[last]] = n - 1
        free[last] += 1
        present = np.flatnonzero(self.counts)
        for symbol in present:
            found = self._runs(out, free, symbol, self.starts[symbol]) if self.large[symbol] else out[:0]
            found = np.concatenate([found, ends[symbol]])
            ahead = self.before[found]
            if (more := ahead > symbol).any():
                self._deal(out, free, found[more] - 1, ahead[more])
        down = np.empty(n, np.int32)  # smaller suffixes, largest first in each bucket
        low = self.starts.copy()
        free = low.copy()
        for symbol in present[::-1]:
            small = self.counts[symbol] - self.large[symbol]
            found = self._runs(down, free, symbol, low[symbol]) if small else down[:0]
            large = out[self.starts[symbol] : self.starts[symbol] + self.large[symbol]][::-1]
            both = np.concatenate([found, large])
            ahead = self.before[both]
            if (more := (ahead >= 0) & (ahead < symbol)).any():
                self._deal(down, free, both[more] - 1, ahead[more])
            if small:
                out[self.starts[symbol] + self.large[symbol] : self.starts[symbol] + self.counts[symbol]] = found[::-1]
        return out

    def names(self) -> tuple[np.ndarray, int]:
        """A number for each LMS substring in text order, equal for equal ones and rising in their order; how many there are.

        A substring reaches to the next LMS suffix, that one's symbol included, the last one to the end of the text. Its
        symbols are packed into words, the last words are ranked first. One that another one continues sorts behind it:
        where it ends, its suffix is a smaller one, and the other's with the same symbol is a larger one.
        """
        n, bits = len(self.text), int(len(self.counts) + 2).bit_length()
        each, full = 63 // bits, (1 << bits) - 1
        size = np.concatenate([self.lms[1:], [n]]) - self.lms + 1
        ahead = np.zeros(n + 1, np.int16)  # 0 is the end of the text
        np.add(self.text, 1, out=ahead[:n], dtype=np.int16, casting="unsafe")
        tail, count = np.zeros(len(size), np.int64), 1
        for k in range(int((size.max() - 1) // each), -1, -1):
            own = np.flatnonzero(size > k * each)
            at, left = self.lms[own] + k * each, size[own] - k * each
            word = np.zeros(len(own), np.int64)
            for i in range(each):
                word = (word << bits) | np.where(left > i, ahead[np.minimum(at + i, n)], full)
            rank, goes_on = word, left > each
            if goes_on.any():
                rank = np.unique(word, return_inverse=True)[1] * (count + 1) + np.where(goes_on, tail[own], count)
            values, rank = np.unique(rank, return_inverse=True)
            tail[own], count = rank, len(values)
        return tail, count


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes of ``text``, whole numbers below ``symbols``, in order; a suffix sorts before those it begins."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    induction = Induction(text, symbols)
    if not len(induction.lms):
        return induction.array(induction.lms)
    line, count = induction.names()
    if count == len(line):
        rank = np.argsort(line)
    elif count <= SYMBOLS:
        rank = suffix_array(line.astype(np.int16), count)
    else:  # two digits a name keep alphabets small; suffixes at even places are those of names
        digits = int(np.ceil(np.sqrt(count)))
        line = np.stack([(line // digits).astype(np.int16), (line % digits).astype(np.int16)], axis=1).ravel()
        rank = suffix_array(line, digits)
        rank = rank[rank % 2 == 0] // 2
    return induction.array(induction.lms[rank])


def common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """By place in the text: bytes that its suffix shares with the one before it in the array.

    Where the byte in front of both is equal too, the value is that of the place before less one. Only the other places
    are compared, eight bytes at a time; their values sum to n log n at most.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[array[1:]] = array[:-1]
    fresh, shared = np.ones(n, bool), np.zeros(n, np.int32)
    np.not_equal(text[:-1], text[before[1:] - 1], out=fresh[1:])
    fresh[1:] |= before[1:] <= 0
    padded = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    for lo in range(0, n, COMPARED):
        a = np.flatnonzero(fresh[lo : lo + COMPARED] & (before[lo : lo + COMPARED] >= 0)) + lo
        b, k = before[a].astype(np.int64), np.zeros(len(a), np.int64)
        while len(a):
            room = n - np.maximum(a, b) - k
            differ = words[np.minimum(a + k, n)] ^ words[np.minimum(b + k, n)]
            low = differ & (~differ + np.uint64(1))
            step = np.where(differ == 0, 8, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) >> 3)
            step = np.minimum(step, room)
            k += step
            shared[a] = k
            on = step == 8
            a, b, k = a[on], b[on], k[on]
    place = np.arange(n, dtype=np.int32)
    head = np.maximum.accumulate(np.where(fresh, place, np.int32(0)))
    place -= head
    out = shared[head]
    out -= place
    np.maximum(out, 0, out=out)
    out[before < 0] = 0
    return out


def repeated_windows(pieces: list[bytes], window: int) -> list[np.ndarray]:
    """For each piece, which of its windows also start elsewhere in the pieces."""
    stop = bytes([STOP])
    text = np.frombuffer(stop.join(pieces) + stop, np.uint8)
    array = suffix_array(text, 256)
    close = common_prefixes(text, array) >= window
    hit = close.copy()
    partner = np.flatnonzero(close[array])  # ranks whose suffix shares a window with the one before
    hit[array[partner - 1]] = True
    lengths = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
    starts = np.cumsum(lengths + 1) - lengths - 1
    return [hit[s : s + max(0, size - window + 1)] for s, size in zip(starts, lengths, strict=True)]


# Pieces -------------------------------------------------------------------------------------------------------------


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS: dict[str, np.ndarray] = {}


def _sliding(values: np.ndarray, span: int, pick: np.ufunc, idle: int) -> np.ndarray:
    """The smallest or largest of every ``span`` neighbours: from both ends of blocks of that length."""
    blocks = np.full(-(-len(values) // span) * span, idle, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, span)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - span + 1
    return pick(back[:count], ahead[span - 1 : span - 1 + count])


def smallest_marks(data: np.ndarray, window: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``mark``-byte strings of ``data``, and for each window the smallest of its own."""
    n = len(data)
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, CHUNK + window)
        _POWERS.update(up=_powers(size, _BASE), down=_powers(size, pow(_BASE, -1, 1 << 64)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS["up"][:n], out=sums[1:])
    h = (sums[mark:] - sums[:-mark]) * _POWERS["down"][: n - mark + 1]
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(32)
    return h, _sliding(h, window - mark + 1, np.minimum, np.iinfo(np.uint64).max)


def _twice(h: np.ndarray, least: np.ndarray, starts: np.ndarray, sizes: np.ndarray, span: int) -> np.ndarray:
    """Which pieces have their smallest hash at more than one place; only their windows can repeat within them.

    A place is one of the smallest of some window if the largest of the windows' smallest hashes there is its own.
    """
    wide = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    places = np.flatnonzero(h == _sliding(wide, span, np.maximum, 0))
    lo, hi = np.searchsorted(places, starts), np.searchsorted(places, starts + sizes + span - 1)
    each = hi - lo
    piece = np.repeat(np.arange(len(starts)), each)
    at = places[np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(lo, each)]
    return np.bincount(piece[h[at] == least[starts][piece]], minlength=len(starts)) > 1


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _long(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def pieces_of(offsets: np.ndarray, data: np.ndarray, window: int, mark: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of documents that lie end to end: number of the document, start in ``data``, windows, hash, and whether the hash is there
    twice; a chunk at a time.

    Where a chunk or ``PIECE`` ends, a piece is cut; its windows keep their hash, so results are the same.
    """
    for lo in range(int(offsets[0]), int(offsets[-1]) - window + 1, CHUNK):
        part = data[lo : min(lo + CHUNK + window - 1, int(offsets[-1]))]
        h, least = smallest_marks(part, window, mark)
        cut = np.ones(len(least), bool)
        cut[1:] = least[1:] != least[:-1]
        for edge in (offsets - lo, offsets[1:] - window + 1 - lo):
            cut[edge[(edge >= 0) & (edge < len(cut))]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=len(least))
        whole = -(-sizes // PIECE)
        if whole.max() > 1:
            inner = np.arange(int(whole.sum())) - np.repeat(np.cumsum(whole) - whole, whole)
            sizes = np.minimum(np.repeat(sizes, whole) - inner * PIECE, PIECE)
            starts = np.repeat(starts, whole) + inner * PIECE
        number = np.searchsorted(offsets, starts + lo, side="right") - 1
        kept = starts + lo + window <= offsets[number + 1]
        starts, sizes = starts[kept], sizes[kept]
        yield number[kept], starts + lo, sizes, least[starts].view(np.int64), _twice(h, least, starts, sizes, window - mark + 1)


def _piece_rows(window: int, mark: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, (offsets, data) = batch.column("doc"), _buffers(batch.column("body"))
            view = memoryview(data)
            for number, start, size, key, loop in pieces_of(offsets, data, window, mark):
                content = [_long(hashlib.blake2b(view[s : s + n + window - 1], digest_size=8).digest()) for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                names = ["doc", "start", "n", "key", "content", "loop"]
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(number)), pa.array(start - offsets[number]), pa.array(size), pa.array(key), pa.array(content, pa.int64()), pa.array(loop)], names)

    return rows


_PART = "array<struct<key:bigint,content:bigint,times:bigint,shard:bigint,start:bigint,n:bigint>>"
_CUT = "key bigint, content bigint, times bigint, shard bigint, piece binary"
_MARKED = "key bigint, content bigint, times bigint, lo array<bigint>, hi array<bigint>"


def _cut(window: int):
    """Rows ``body, parts`` to a row for each part, with its bytes."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (offsets, data), parts = _buffers(batch.column("body")), batch.column("parts")
            view = memoryview(data)
            for at in range(len(parts)):
                found = parts[at].values
                start, size = found.field("start").to_numpy() + offsets[at], found.field("n").to_numpy() + window - 1
                for lo in range(0, len(found), 2000):
                    own = found.slice(lo, 2000)
                    texts = [bytes(view[s : s + n]) for s, n in zip(start[lo : lo + 2000].tolist(), size[lo : lo + 2000].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(own.field(c) for c in ("key", "content", "times", "shard")), pa.array(texts, pa.binary())], ["key", "content", "times", "shard", "piece"])

    return rows


def _ranges(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def _marked(window: int):
    """A shard's pieces to the ranges of windows that also start elsewhere in it, or whose piece does."""

    def rows(shard: pa.Table) -> pa.Table:
        seen = {(k, c): (t, p) for k, c, t, p in zip(*(shard.column(n).to_pylist() for n in ("key", "content", "times", "piece")), strict=True)}
        hits = repeated_windows([p for _, p in seen.values()], window)
        spans = [([0], [len(hit)]) if times > 1 else _ranges(hit) for hit, (times, _) in zip(hits, seen.values(), strict=True)]
        out = [(*k, times, *span) for (k, (times, _)), span in zip(seen.items(), spans, strict=True) if span[0]]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], ["key", "content", "times", "lo", "hi"])

    return rows


def _windows(window: int):
    """Pieces to a row for each window: its digest and place."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content, times, piece in zip(*(batch.column(n).to_pylist() for n in ("key", "content", "times", "piece")), strict=True):
                view, n = memoryview(piece), len(piece) - window + 1
                digests = [hashlib.blake2b(view[i : i + window], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([_long(d) for d in digests]), pa.array([_long(d[8:]) for d in digests]), *(pa.array([v] * n, pa.int64()) for v in (key, content, times)), pa.array(range(n), pa.int64())], ["h0", "h1", "key", "content", "times", "at"])

    return rows


# Documents ----------------------------------------------------------------------------------------------------------


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def _named(docs: DataFrame, text: str, least: int) -> DataFrame:
    """``doc``, a digest that equal texts share, and ``body`` of documents of at least ``least`` bytes."""
    body = docs.select(_bytes(text).alias("body")).filter(F.octet_length("body") >= least)
    return body.select(F.substring(F.unhex(F.sha2("body", 256)), 1, 16).alias("doc"), "body")


def _one_copy(named: DataFrame, copies: DataFrame, total: int) -> DataFrame:
    """``named`` with texts that hold at least 1/HOT_KEYS of all rows once each; others may be there several times."""
    hot = F.broadcast(copies.filter(F.col("copies") * F.lit(HOT_KEYS) >= F.lit(total)).select("doc"))
    once = named.join(hot, "doc", "left_semi").groupBy("doc").agg(F.first("body").alias("body"))
    return named.join(hot, "doc", "left_anti").unionByName(once)


def removed_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, mark: int = MARK) -> DataFrame:
    """For every different text with a repeated string: ``doc`` (the first 16 bytes of its SHA-256), ``copies`` and
    ``spans``, the maximal runs of bytes ``lo`` to ``hi`` that strings of ``window`` bytes cover which also start elsewhere.

    ``mark`` is at most ``window``. Texts shorter than ``window`` bytes, null and empty ones have no span.
    """
    named = _named(docs, text, window)
    copies = written(named.groupBy("doc").agg(F.count(F.lit(1)).alias("copies")))
    rows = copies.agg(F.sum("copies")).first()[0] or 0
    pieces = written(named.mapInArrow(_piece_rows(window, mark), "doc binary, start bigint, n bigint, key bigint, content bigint, loop boolean"))
    keys = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("seen"), (F.min("content") != F.max("content")).alias("mixed"), F.max("loop").alias("loop")).filter("seen > 1 or loop")
    keys = written(keys.select("key", "seen", (F.col("mixed") | (F.col("seen") == 1)).alias("mixed")))
    met = written(spread_join(pieces.drop("loop"), keys, ["key"], "seen", pieces.count()))
    discard(pieces, keys)
    mixed = met.filter("mixed")
    contents = mixed.groupBy("key", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "start", "n")).alias("s")).select("key", "content", "times", "s.*")
    contents = written(contents)
    size = F.sum(F.col("n") + (window - 1))
    large = contents.groupBy("key").agg(size.alias("bytes")).filter(F.col("bytes") > HASH_BYTES).select("key", F.lit(True).alias("large"))
    shards = max(1, -(-(contents.agg(size).first()[0] or 0) // SHARD_BYTES))
    dealt = contents.join(large, "key", "left").withColumn("shard", F.when(F.col("large"), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))))
    parts = dealt.groupBy("doc").agg(F.collect_list(F.struct("key", "content", "times", "shard", "start", "n")).cast(_PART).alias("parts"))
    cut = _one_copy(named, copies, rows).join(parts.hint("shuffle_hash"), "doc").select("body", "parts").mapInArrow(_cut(window), _CUT)
    cut = written(cut)
    sorted_ = cut.filter("shard >= 0").groupBy("shard").applyInArrow(_marked(window), _MARKED)
    marked = written(sorted_.unionByName(_counted(cut.filter("shard < 0").dropDuplicates(["key", "content"]), window)))
    ranges = spread_join(mixed.select("doc", "start", "key", "content"), marked, ["key", "content"], "times", mixed.count())
    ranges = ranges.select("doc", "start", F.inline(F.arrays_zip("lo", "hi")))
    plain = met.filter("not mixed").select("doc", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (window - 1)).alias("hi"))
    all_ = plain.unionByName(ranges.select("doc", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + (window - 1)).alias("hi")))
    per = all_.distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))
    out = written(per.join(copies, "doc").select("doc", "copies", _united(F.col("r")).alias("spans")))
    discard(met, contents, cut, marked, copies)
    return out


def _united(ranges: Column) -> Column:
    """Sorted ranges with those that overlap or touch made one."""
    first = F.struct(F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"))
    start = F.struct(first.alias("open"), F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("done"))

    def add(acc: Column, x: Column) -> Column:
        wider = F.struct(acc["open"]["lo"].alias("lo"), F.greatest(acc["open"]["hi"], x["hi"]).alias("hi"))
        joins = x["lo"] <= acc["open"]["hi"]
        return F.struct(F.when(joins, wider).otherwise(x).alias("open"), F.when(joins, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"))

    return F.aggregate(ranges, start, add, lambda acc: F.filter(F.array_append(acc["done"], acc["open"]), lambda s: s["lo"] >= 0))


def _counted(cut: DataFrame, window: int) -> DataFrame:
    """The same ranges for pieces of hashes that no shard can hold, by counting each window."""
    windows = written(cut.mapInArrow(_windows(window), "h0 bigint, h1 bigint, key bigint, content bigint, times bigint, at bigint"))
    again = windows.groupBy("h0", "h1").agg(F.sum("times").alias("starts"), F.count(F.lit(1)).alias("seen")).filter("starts > 1").drop("starts")
    hit = spread_join(windows, again, ["h0", "h1"], "seen", windows.count())
    per = hit.groupBy("key", "content", "times").agg(F.array_sort(F.collect_list("at")).alias("a"))
    edge = lambda step: F.filter("a", lambda v: ~F.array_contains("a", v + step))
    return per.select("key", "content", "times", edge(-1).alias("lo"), F.transform(edge(1), lambda v: v + 1).alias("hi"))


@F.pandas_udf(BinaryType())
def _kept(body: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(text: bytes, gone: list | None) -> bytes:
        if gone is None:
            return text
        ends = [0, *(v for s in gone for v in (s["lo"], s["hi"])), len(text)]
        return b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))

    return pd.Series([cut(*x) for x in zip(body, spans, strict=True)], dtype=object)


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, mark: int = MARK) -> DataFrame:
    """``docs`` with ``spans``, the runs of bytes of the text that repeat, and ``kept``, its other bytes.

    A byte repeats if a string of ``window`` bytes covers it that also starts anywhere else, in the same document too.
    Null texts are empty. Every row stays, repeated ones too (they repeat each other); extra columns stay, and those
    named ``spans`` or ``kept`` become ``spans_given`` and ``kept_given``. Texts of any length are read whole.
    """
    spans = removed_spans(docs, text, window, mark)
    given = set_aside(docs, "spans", "kept")
    row = given.select(F.struct(*given.columns).alias("__row"), _bytes(text).alias("body"))
    row = row.withColumn("doc", F.substring(F.unhex(F.sha2("body", 256)), 1, 16))
    both = spread_join(row, spans.hint("shuffle_hash"), ["doc"], "copies", docs.count(), "left")
    return both.select("__row.*", "spans", _kept("body", "spans").alias("kept"))


def _op13(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"]), F.lit(0).cast("long"))
    spans = F.coalesce(F.size("spans"), F.lit(0)).cast("long")
    return rows.select("doc_id", F.octet_length(_bytes("text")).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.when(F.col("spans").isNull(), 0).otherwise(spans).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op13_suffix_dedup": _op13}
