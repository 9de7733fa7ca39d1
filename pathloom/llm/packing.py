"""Packing token sequences: first-fit decreasing with a tournament tree, in random groups of documents."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import small_batches



PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces in a group on average, and sequence numbers kept for each group.
GROUP_PIECES = 4096
ID_SPAN = 1 << 32
#: Words whose ids a Python worker remembers.
MEMO_WORDS = 200_000


class _Words(dict):
    """Little-endian ids of pieces that no token crosses, filled as they come."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        ids = np.asarray(self.encode(piece), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts by one vocabulary, given as a tokenizers file and the same vocabulary as ranks.

    The vocabulary's pattern always breaks a text before a space that follows a non-space, so a text is the list of
    its space-separated words and each word's ids can be remembered. Texts with white space before a space are
    encoded whole, and texts that name a special token are left to the tokenizers library.
    """

    def __init__(self, tokenizer_file: str, rank_file: str, pattern: str):
        import json
        import re

        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.file, self.full = tokenizer_file, None
        with open(tokenizer_file, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.spaced = re.compile(r"\s ")
        self.words = _Words(self.plain.encode_ordinary)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            if self.full is None:  # such texts are rare, and the library's vocabulary takes memory in every worker
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.file)
            return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.spaced.search(text):
            return np.asarray(self.plain.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        get = self.words.__getitem__
        return get(first) + b"".join([get(" " + w) for w in rest]) if rest else get(first)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(files: tuple[str, str, str] | None) -> Encoder:
    """One encoder for each Python worker; ``files``: tokenizers file, rank file and pattern, by default byte_bpe_50k."""
    if files not in _ENCODERS:
        import public_tokenizers as public

        _ENCODERS[files] = Encoder(*(files or (public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)))
    return _ENCODERS[files]


class TournamentTree:
    """Room left in bins 0..n-1 as a complete binary tree of maxima: the first bin with enough room in log n steps."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1
        while self.leaves < n:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bin_no = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return bin_no


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: largest items first, each into the first bin that has room."""
    tree = TournamentTree(max(1, len(sizes)), capacity)
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bins[i] = tree.place(sizes[i])
    return bins


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 0, files: tuple[str, str, str] | None = None, keep_ids: bool = True) -> DataFrame:
    """Documents ``(doc_id, text)`` as pieces of at most ``capacity`` ids: full pieces, then the rest, which is never empty.

    Each document is its ids and one ``end_id``. Columns: ``doc_id, start, length, ids_crc32, doc_tokens`` and, with
    ``keep_ids``, ``ids`` (little-endian unsigned 32-bit).
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(files), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"]):
                ids = (enc.ids(text) if text else b"") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n) + ((piece,) if keep_ids else ()))
                    held += len(piece)
                if held > 8 << 20:  # a very long text is handed on before the next one
                    yield frame(rows)
                    rows, held = [], 0
            yield frame(rows)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def pack(pieces: DataFrame, n_pieces: int, capacity: int = 1024, group_pieces: int = GROUP_PIECES, seed: int = 5) -> DataFrame:
    """Put pieces into sequences: full pieces are sequences of their own, shorter ones are packed first-fit decreasing.

    Groups are drawn by a hash of the document and the piece, so neither a hot source nor a very long document fills
    one group, and a retried task packs the same way. Adds ``sequence_id`` (unique over all groups) and ``offset``
    (gapless from 0).
    """
    groups = max(1, round(n_pieces / group_pieces))
    columns = pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins = np.asarray(first_fit_decreasing(group["length"].tolist(), capacity), dtype=np.int64)
        order = np.argsort(bins, kind="stable")
        length = group["length"].to_numpy()[order]
        before = np.cumsum(length) - length
        heads = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = before - np.maximum.accumulate(np.where(heads, before, 0))
        out = group.iloc[order].copy()
        out["sequence_id"], out["offset"] = int(key[0]) * ID_SPAN + bins[order], offset
        return out[columns + ["sequence_id", "offset"]]

    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups))
    return pieces.withColumn("__group", draw).groupBy("__group").applyInPandas(fill, schema)


def packed(docs: DataFrame, capacity: int = 1024, keep_ids: bool = True, files: tuple[str, str, str] | None = None) -> DataFrame:
    """Sequences of ``docs(doc_id, text)``: one row per piece with its place.

    Null and empty texts are the end id alone. Repeated rows are packed once each. Of a null doc_id the pieces keep
    null. Texts of any length are cut into as many pieces as needed, and groups follow the number of pieces as
    estimated from the texts' lengths, so a table of very long texts has no larger groups. Ties of length go by
    doc_id and place. Extra columns are ignored. An empty table gives no rows.
    """
    pieces = F.sum(F.ceil((F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1) / F.lit(3.0 * capacity)))
    return pack(token_pieces(docs, capacity, files=files, keep_ids=keep_ids), docs.agg(F.coalesce(pieces, F.lit(0))).first()[0], capacity)


def padding(placed: DataFrame, capacity: int = 1024) -> DataFrame:
    """Tokens, padding and sequences; a sequence whose length is a power of two is not padded."""
    per = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    spare = F.when(F.bit_count("n") == 1, 0).otherwise(F.lit(capacity) - F.col("n"))
    return per.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(spare).alias("padding"))


def _op7(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs, keep_ids=False)


QUERIES = {"op7_packing": _op7}
