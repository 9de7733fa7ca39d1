"""Web archives: WARC files written from pages, read back, and an index merged from locally sorted runs.

Files live in the shared folder of the session. A task writes under a name of its own attempt and moves the file to
its final name when it is whole, so a retried or repeated task leaves one good file.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import shared_dir, small_batches, spread_join, written

#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
#: First capture time; a page's time is this plus its id in seconds, as the table has no dates.
EPOCH = 1_600_000_000
INDEX = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("at", pa.int64())])
#: Captures in a run; ranges in which the index is cut at most, and keys drawn for each, of so many letters.
RUN_ROWS, MOST_RANGES, KEYS_A_RANGE, KEY_LETTERS = 50_000, 4096, 16, 200
#: Shared digests up to this number (72 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 1_000_000
RECORD_ID = "urn:x-page:"


def _stamp(seconds: int) -> str:
    return pd.Timestamp(seconds, unit="s").strftime("%Y%m%d%H%M%S")


def url_key(url: str | None) -> str:
    """Sort key of a url: host labels reversed, then path and query, lower case; empty for null."""
    rest = (url or "").lower().partition("://")[2] or (url or "").lower()
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.split("."))) + ")" + slash + path.partition("#")[0]


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, digest: str) -> bytes:
    """One WARC record as its own gzip member; a revisit keeps the digest and length of its payload but no payload."""
    payload = (html or "").encode()
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD_ID}{name}>",
        f"WARC-Date: {pd.Timestamp(EPOCH + (page_id or 0), unit='s').isoformat()}Z",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    body = ("\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""])).encode() + payload + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(body) + pack.flush()


def record_types(pages: DataFrame) -> DataFrame:
    """``pages`` with ``payload_digest`` and ``refers_to``: the smallest page_id of an equal payload, null for responses.

    Digests that several rows share have one row each. Where these are few, they are broadcast and no payload is
    shuffled; where they are many, only the digests that a large share of all rows has are.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("payload_digest"), F.length(payload).alias("__n"))
    many = rows.filter(F.col("__n") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
    many = written(many.filter("c > 1"))
    if many.count() <= BROADCAST_DIGESTS:
        found = rows.join(F.broadcast(many.drop("c")), "payload_digest", "left")
    else:
        found = spread_join(rows, many, ["payload_digest"], "c", pages.count(), "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return found.select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _File:
    """A file that appears under its final name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.store, base = _store(folder)
        self.store.create_dir(base, recursive=True)
        self.final, self.temp = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.out = self.store.open_output_stream(self.temp)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.store.move(self.temp, self.final)
        else:
            self.store.delete_file(self.temp)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html, payload_digest, refers_to)``; one file a task: ``file, records``."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with _File(folder, name) as out:
            for batch in batches:
                for page_id, url, html, digest, refers in zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in ("page_id", "url", "html", "payload_digest", "refers_to"))):
                    out.write(record(None if page_id is None else int(page_id), url, html, None if refers is None else int(refers), digest))
                    n += 1
        yield pd.DataFrame({"file": [name], "records": [n]})

    return pages.mapInPandas(write, "file string, records long")


def read_records(source) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of every record of a stream of gzip members, one member in memory at a time."""
    at, used, buffer, member = 0, 0, b"", zlib.decompressobj(31)
    parts: list[bytes] = []
    while True:
        if not buffer:
            buffer = source.read(1 << 20)
            if not buffer:
                if parts or used:
                    raise ValueError("the archive ends inside a record")
                return
        parts.append(member.decompress(buffer))
        used += len(buffer) - len(member.unused_data)
        buffer = member.unused_data
        if member.eof:
            head, _, body = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            yield at, fields, body[: int(fields["Content-Length"])]
            at, used, parts, member = at + used, 0, [], zlib.decompressobj(31)


def _page(value: str) -> int | None:
    text = value.strip("<>").removeprefix(RECORD_ID)
    return None if text == "null" else int(text)


def sorted_runs(files: DataFrame, folder: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """Read archives back and write their index as sorted runs: ``run, rows, keys``, the last a few keys for the ranges.

    A response's size and digest are those of its payload as read; the digest must be the one in its header. A revisit
    has no payload, so its header tells both.
    """

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                store, base = _store(folder)
                rows, part = [], 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for at, head, payload in read_records(source):
                        page, kind, digest = _page(head["WARC-Record-ID"]), head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: the payload at {at} does not have its digest")
                        refers = _page(head["WARC-Refers-To"]) if kind == "revisit" else None
                        key = f"{url_key(head['WARC-Target-URI'])} {_stamp(EPOCH + (page or 0))} {(page or 0):020d}"
                        size = len(payload) if kind == "response" else int(head["X-Payload-Length"])
                        rows.append((key, page, size, digest, kind, refers, name, at))
                        if len(rows) >= run_rows:
                            yield run(rows, name, part)
                            rows, part = [], part + 1
                if rows:
                    yield run(rows, name, part)

    def run(rows: list[tuple], name: str, part: int) -> pd.DataFrame:
        rows.sort(key=lambda r: r[0])
        run_name = f"{name.removesuffix('.warc.gz')}-{part:04d}.run"
        with _File(folder, run_name) as out, pq.ParquetWriter(out, INDEX) as writer:
            table = pa.table([pa.array(x, t.type) for x, t in zip(zip(*rows), INDEX)], schema=INDEX)
            writer.write_table(table, row_group_size=4096)
        step = max(1, len(rows) // 16)
        return pd.DataFrame({"run": [run_name], "rows": [len(rows)], "keys": [[r[0][:KEY_LETTERS] for r in rows[step // 2 :: step]]]})

    return files.mapInPandas(index, "run string, rows long, keys array<string>")


class LoserTree:
    """Merge of k sorted iterators: an inner node keeps the loser of its match, so the next row costs log k comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def __iter__(self) -> Iterator[tuple]:
        while (row := self.heads[self.winner]) is not None:
            yield row
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _segment(store: fs.FileSystem, path: str, lo: str | None, hi: str | None) -> Iterator[tuple]:
    """Rows of a run with lo <= key < hi, one row group at a time; groups outside are not read.

    Parquet keeps no bounds of a group with very long keys; such a group is read and filtered.
    """
    with store.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        for g in range(file.num_row_groups):
            stats = file.metadata.row_group(g).column(0).statistics
            if stats is not None and stats.has_min_max and ((hi is not None and stats.min >= hi) or (lo is not None and stats.max < lo)):
                continue
            table = file.read_row_group(g)
            keys = table["key"]
            keep = pc.and_(pc.greater_equal(keys, lo or ""), pc.less(keys, hi)) if hi is not None else pc.greater_equal(keys, lo or "")
            yield from zip(*(c.to_pylist() for c in table.filter(keep).columns))


def _merge_rows(folder: str, names: list[str], lo: str | None, hi: str | None) -> Iterator[list[tuple]]:
    """Blocks of the merged rows of some runs with lo <= key < hi; one row group of each run is in memory."""
    store, base = _store(folder)
    tree = iter(LoserTree([_segment(store, f"{base}/{n}", lo, hi) for n in names]))
    while block := list(itertools.islice(tree, 20_000)):
        yield block


def _spans(runs: DataFrame, cuts: list[str], stride: int) -> DataFrame:
    """A row for each run and each span of ``stride`` ranges that the run's own ranges cover: adds ``span, lo_key, hi_key``."""
    bounds = [None, *cuts, None]
    at = F.explode(F.sequence(F.floor(F.col("lo") / stride), F.floor((F.col("hi") - 1) / stride))).alias("span")
    keys = runs.sparkSession.createDataFrame([(i // stride, bounds[i], bounds[min(i + stride, len(bounds) - 1)]) for i in range(0, len(bounds) - 1, stride)], "span long, lo_key string, hi_key string")
    return runs.select("*", at).join(F.broadcast(keys), "span")  # at most MOST_RANGES keys


def merge_pass(runs: DataFrame, folder: str, cuts: list[str], fan_in: int, stride: int) -> DataFrame:
    """Merge groups of at most ``fan_in`` runs; every span of ``stride`` key ranges of a group is a task and a file.

    ``runs``: ``run`` (a number), ``file``, and ``lo, hi``, the ranges that the file covers, ``rows``.
    """
    listed = _spans(runs.withColumn("group", F.floor(F.col("run") / fan_in)), cuts, stride)
    listed = listed.groupBy("group", "span", "lo_key", "hi_key").agg(F.collect_list("file").alias("files"))
    n_ranges = len(cuts) + 1

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, span, lo, hi, names in zip(*(batch[c] for c in ("group", "span", "lo_key", "hi_key", "files"))):
                name, n = f"{uuid.uuid4().hex}.run", 0
                with _File(folder, name) as out, pq.ParquetWriter(out, INDEX) as writer:
                    for block in _merge_rows(folder, sorted(names), lo, hi):
                        writer.write_table(pa.table([pa.array(x, t.type) for x, t in zip(zip(*block), INDEX)], schema=INDEX), row_group_size=4096)
                        n += len(block)
                yield pd.DataFrame({"run": [group], "file": [name], "lo": [span * stride], "hi": [min(n_ranges, (span + 1) * stride)], "rows": [n]})

    return written(listed.repartition("group", "span").mapInPandas(merge, "run long, file string, lo long, hi long, rows long"))


def merged(runs: DataFrame, folder: str, fan_in: int = 64, range_rows: int = 20_000) -> DataFrame:
    """All captures in the order of url key, time and page: ``range`` and ``position`` in it, then the index columns.

    Passes merge ``fan_in`` runs at a time until no more than so many are left. Every pass is split by key range as
    far as its runs are longer than ``range_rows``, so tasks stay equally small from the first pass to the last.
    Ranges are cut at quantiles of a bounded sample of keys (at most ``MOST_RANGES * KEYS_A_RANGE`` of ``KEY_LETTERS``
    letters come to the driver), which only balance the work. Times and pages are part of the key, so a url with very
    many captures spans several ranges. Equal keys (repeated rows) come in the order of their runs.
    """
    rows, n_runs = runs.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = min(MOST_RANGES, max(1, -(-rows // range_rows)))
    keys = runs.select(F.explode("keys").alias("key")).orderBy(F.xxhash64("key")).limit(KEYS_A_RANGE * ranges)
    drawn = sorted(r[0] for r in keys.collect())
    cuts = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    n_ranges = len(cuts) + 1
    number = F.row_number().over(Window.partitionBy("part").orderBy("run")) - 1
    # Runs are numbered densely by a count of each part first, so that no task holds them all.
    parted = runs.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(max(1, n_runs // 4096))))
    heads = parted.groupBy("part").count().withColumn("head", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    now = parted.withColumn("run_number", number).join(F.broadcast(heads), "part")
    now = written(now.select((F.col("run_number") + F.coalesce("head", F.lit(0))).cast("long").alias("run"), F.col("run").alias("file"), F.lit(0).cast("long").alias("lo"), F.lit(n_ranges).cast("long").alias("hi"), "rows"))
    stride = 1
    while stride < n_ranges:
        stride *= 2
    while n_runs > fan_in:
        n_runs = -(-n_runs // fan_in)
        wanted = max(1, rows // n_runs // range_rows)  # spans of each merged run
        while stride > 1 and -(-n_ranges // stride) < wanted:
            stride //= 2
        now = merge_pass(now, folder, cuts, fan_in, stride)
    last = _spans(now, cuts, 1).groupBy("span", "lo_key", "hi_key").agg(F.collect_list("file").alias("files"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, lo, hi, names in zip(batch["span"], batch["lo_key"], batch["hi_key"], batch["files"]):
                at = 0
                for block in _merge_rows(folder, sorted(names), lo, hi):
                    out = pd.DataFrame(block, columns=INDEX.names)
                    out.insert(0, "range", number)
                    out.insert(1, "position", range(at, at + len(block)))
                    out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
                    yield out
                    at += len(block)

    return last.repartition(n_ranges, "span").mapInPandas(merge, "range long, position long, key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, at long")


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC files, read them back and return their globally ordered index.

    Null html is an empty payload, null url an empty target. Of equal payloads of at least 100 bytes those with the
    smallest page_id are responses (all of them, where rows repeat that id) and the others revisit it. Rows with a
    null page_id are always responses. Ties of url and time are in the order of pages; payloads and urls of any length
    are kept whole. Extra columns are ignored. An empty table gives no rows.
    """
    folder = shared_dir(pages.sparkSession)
    files = written(write_archives(record_types(pages), folder))
    runs = written(sorted_runs(files.repartition(max(1, files.count()), "file"), folder))
    return merged(runs, folder)


def _op8(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

QUERIES = {"op8_warc": _op8}
ORACLE_SQL = {"op8_warc": _SQL}
