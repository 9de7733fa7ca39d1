"""Media columns: Ogg streams written from and read back into samples.

Bytes of a column are mono 8-bit samples. A stored file has two logical streams that take turns: packet 0, 2, ... in
one, 1, 3, ... in the other. The reader verifies page checksums, reassembles packets from lacing values, keeps the
streams apart by serial number and derives times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import set_aside, small_batches



#: Samples in a packet, and the nominal rate that turns granule positions into seconds.
PACKET, RATE, UNIT = 3072, 8000, 192
MAGIC = b"\x01pcm8u"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The container's checksum (polynomial 0x04C11DB7, no reflection, no inversion) by the reflected one of zlib.

    Both use the same polynomial, so the bits of each byte are reversed before and those of the result after.
    """
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "big").translate(_REVERSED), "little")


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one logical stream with the granule each ends at; the first packet has a page of its own."""
    pages, lacing, body, sequence, granule, carried = [], bytearray(), bytearray(), 0, -1, False
    starts_inside = False

    def close(last: bool) -> None:
        nonlocal lacing, body, sequence, granule, starts_inside
        flags = (1 if starts_inside else 0) | (2 if sequence == 0 else 0) | (4 if last else 0)
        head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + bytes(lacing)
        page = bytearray(head + bytes(body))
        page[22:26] = struct.pack("<I", page_crc(bytes(page)))
        pages.append((granule, bytes(page)))
        starts_inside, sequence, granule = carried, sequence + 1, -1
        lacing, body = bytearray(), bytearray()

    for i, (data, at) in enumerate(packets):
        pos, left = 0, len(data)
        while True:
            if len(lacing) == 255:
                close(False)
            step = min(255, left)
            lacing.append(step)
            body += data[pos : pos + step]
            pos, left, carried = pos + step, left - step, True
            if step < 255:
                break
        carried, granule = False, at
        if i == 0 and len(packets) > 1:
            close(False)
    close(True)
    return pages


def encode(payload: bytes) -> bytes:
    """An Ogg file that holds ``payload``; serial numbers depend on the payload alone."""
    base = zlib.crc32(payload) & 0xFFFFFFFE
    streams = []
    for parity in (0, 1):
        packets, at = [(MAGIC + struct.pack("<BIQ", parity, RATE, len(payload)), 0)], 0
        for start in range(parity * PACKET, len(payload), 2 * PACKET):
            data = payload[start : start + PACKET]
            at += len(data)
            packets.append((data, at))
        streams.append(_pages(base + parity, packets))
    first = [s.pop(0)[1] for s in streams]  # beginnings come first, then the streams' pages in turn
    rest = sorted(((i, k, page) for k, s in enumerate(streams) for i, (_, page) in enumerate(s)), key=lambda x: x[:2])
    return b"".join(first + [page for _, _, page in rest])


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """Verified pages: (serial, sequence, flags, granule, lacing, body). Raises ValueError on damage."""
    at, n = 0, len(media)
    while at < n:
        if n - at < 27 or media[at : at + 4] != b"OggS":
            raise ValueError(f"no page at byte {at}")
        _, _, flags, granule, serial, sequence, crc, count = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if end > n or page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        yield serial, sequence, flags, granule, lacing, media[at + 27 + count : end]
        at = end


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, float | None]]]:
    """Packets of each logical stream with the time in seconds at which they end, where a page tells it."""
    packets: dict[int, list[tuple[bytes, float | None]]] = {}
    parts: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    for serial, sequence, flags, granule, lacing, body in pages(media):
        if sequence != expected.get(serial, 0) or bool(flags & 1) != bool(parts.get(serial)):
            raise ValueError("a page is missing")
        expected[serial] = sequence + 1
        out, open_parts, at = packets.setdefault(serial, []), parts.setdefault(serial, []), 0
        start = 0
        for size in lacing:
            at += size
            if size < 255:
                open_parts.append(body[start:at])
                out.append((b"".join(open_parts), None))
                open_parts.clear()
                start = at
        if start < at or (lacing and lacing[-1] == 255):
            open_parts.append(body[start:at])
        if granule >= 0 and out:
            out[-1] = (out[-1][0], granule / RATE)
    if any(parts.values()):
        raise ValueError("the last packet is incomplete")
    return packets


def decode(media: bytes) -> tuple[bytes, float]:
    """Samples and the end time of the longer stream."""
    streams: dict[int, list[bytes]] = {}
    size, last = 0, 0.0
    for found in demultiplex(media).values():
        head = found[0][0]
        if not head.startswith(MAGIC):
            raise ValueError("unknown stream")
        parity, _, size = struct.unpack_from("<BIQ", head, len(MAGIC))
        streams[parity] = [p for p, _ in found[1:]]
        last = max([last, *(t for _, t in found if t is not None)])
    even, odd = streams.get(0, []), streams.get(1, [])
    turns = [b""] * (len(even) + len(odd))
    turns[0::2], turns[1::2] = even, odd
    payload = b"".join(turns)
    if len(payload) != size:
        raise ValueError("samples are missing")
    return payload, last


def feature(payload: bytes, end: float) -> str:
    """Samples, end time of a stream, mean, mean square about the mid level 128 and sign changes about it."""
    x = np.frombuffer(payload, dtype=np.uint8)
    total, square, turns = 0, 0, 0
    for at in range(0, len(x), 1 << 20):
        part = x[at : at + (1 << 20) + 1].astype(np.int64) - 128
        total += int(part[: 1 << 20].sum())
        square += int((part[: 1 << 20] ** 2).sum())
        turns += int(((part[1:] < 0) != (part[:-1] < 0)).sum())
    n = max(1, len(x))
    return f"n={len(x)};end={end:.6f};mean={total / n:.6f};power={square / n:.6f};turns={turns}"


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``media``: the text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as Ogg.

    Null and empty texts are one unit of spaces; ``n_bytes`` is the length before padding. Equal texts give equal media,
    repeated rows too. A caller's own ``n_bytes`` or ``media`` gets the suffix ``_given``. An empty table gives no rows.
    """

    @F.pandas_udf("n_bytes long, media binary")
    def write(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            raw = (t or "").encode()
            rows.append((len(raw), encode(raw + b" " * ((-len(raw)) % UNIT or (0 if raw else UNIT)))))
        return pd.DataFrame(rows, columns=["n_bytes", "media"])

    plain = set_aside(docs.withColumn("__stored", write(F.col(text).cast("string"))), "n_bytes", "media")
    return plain.withColumn("n_bytes", F.col("__stored.n_bytes")).withColumn("media", F.col("__stored.media")).drop("__stored")


def read_back(rows: DataFrame, media: str = "media") -> DataFrame:
    """``rows`` with ``__read``, what their Ogg column holds: sizes, digests and the feature string.

    Damage and nulls fail the job, as a stored payload must come back whole.
    """

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def read(column: pd.Series) -> pd.DataFrame:
        out = []
        for m in column:
            payload, end = decode(m)
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(payload, end)))
        return pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return rows.withColumn("__read", read(F.col(media)))


def _op9(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_back(stored(docs).select("doc_id", "n_bytes", "media")).select("doc_id", "n_bytes", "__read.*")


QUERIES = {"op9_ogg": _op9}
