"""Suffix arrays of shards, and repeated strings of documents, against plain versions."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import suffixes

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("seed", range(3))
def test_suffix_arrays_and_common_prefixes(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(300):
        symbols = rng.choice((1, 2, 3, 5, 200))
        text = [rng.randrange(symbols) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.3:  # repeats make many levels
            text = (text * 5)[: rng.randint(1, 120)]
        monkeypatch.setattr(suffixes, "SYMBOLS", rng.choice((2, 4, 2048)))
        array = suffixes.suffix_array(np.array(text), max(text) + 1)
        assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffixes.common_prefixes(np.array(text, np.uint8), array)
        for a, b in zip(array[1:], array[:-1], strict=True):
            n = next((k for k in range(len(text) - max(a, b)) if text[a + k] != text[b + k]), len(text) - max(a, b))
            assert shared[a] == n


def plain(texts: list[str | None], window: int) -> list[tuple]:
    """Every window of every text counted."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in bodies for i in range(len(b) - window + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i + 1 : i + window + 1] = True
        edges = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((len(b), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_repeats(seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passages = [prose(14) for _ in range(4)]
    texts: list[str | None] = [None, "", "short", "short", "z" * 500, "z" * 41 + "y", prose(3000)]
    for _ in range(60):
        parts = [prose(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng.randint(0, 12))]
        texts.append(" ".join(parts))
    base = prose(120)
    for _ in range(25):  # near copies, each with its own change
        at = rng.randrange(len(base))
        texts.append(base[:at] + rng.choice("xyz") + base[at + 1 :])
    texts += [base] * 30 + [texts[9]] * 3
    inside = prose(20)
    return [*texts, inside + " and " + inside, "ab" * 300, "ab" * 30 + "c" + "ab" * 40]


def digest(df) -> list[tuple]:
    rows = df.select("doc_id", "text", "spans", "kept").orderBy("doc_id").collect()
    return [(len((r["text"] or "").encode()), sum(s["hi"] - s["lo"] for s in r["spans"] or []), len(r["spans"] or []), hashlib.sha256(r["kept"]).hexdigest()) for r in rows]


@pytest.mark.parametrize("settings", [{}, {"HASH_BYTES": 600, "SHARD_BYTES": 2000}, {"CHUNK": 300, "PIECE": 16}])
def test_repeated_strings_are_those_of_a_plain_count(spark, monkeypatch, settings):
    """Also where hashes are too large for a shard, shards are many, and pieces are cut."""
    for name, value in settings.items():
        monkeypatch.setattr(suffixes, name, value)
    texts = texts_with_repeats()
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    # workers read the module anew, so the settings of tasks go through the functions' closures
    piece_rows = suffixes._piece_rows
    if "PIECE" in settings:
        monkeypatch.setattr(suffixes, "_piece_rows", lambda w, m: _with(settings, piece_rows, w, m))
    assert digest(suffixes.without_repeats(docs, window=40, mark=8)) == plain(texts, 40)


def _with(settings, make, window, mark):
    def rows(batches):
        from pathloom.llm import suffixes as own

        for name, value in settings.items():
            setattr(own, name, value)
        yield from make(window, mark)(batches)

    return rows


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a" * 450), (1, "a" * 450), (None, None), (2, "b" * 399)], SCHEMA)
    given = docs.withColumns({c: F.lit("x") for c in ("spans", "kept", "doc", "body", "copies", "key", "content")})
    rows = {(r["doc_id"], len(r["kept"])) for r in suffixes.without_repeats(given).collect()}
    assert rows == {(1, 0), (None, 0), (2, 399)}
    assert {"spans_given", "kept_given", "doc", "copies"} <= set(suffixes.without_repeats(given).columns)
    assert suffixes.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["z" * 41, "abcdefg" * 30, "x" + "0123456789abcdefghijklm" * 4 + "y", "q" * 39 + "w" + "q" * 39])
def test_a_text_that_repeats_within_itself_only(spark, text):
    """Its hash is in one piece of all documents."""
    docs = spark.createDataFrame([(0, text), (1, "another text that has nothing in common with it, and is long enough")], SCHEMA)
    assert digest(suffixes.without_repeats(docs, window=40, mark=8)) == plain([text, "another text that has nothing in common with it, and is long enough"], 40)


def test_a_shard_takes_little_memory():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), np.uint8)) for _ in range(3000)]
    pieces = [b" ".join(words[i] for i in rng.integers(0, 3000, 300)) for _ in range(600)]
    size = sum(map(len, pieces))
    tracemalloc.start()
    try:
        suffixes.repeated_windows(pieces, 400)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 65 * size
