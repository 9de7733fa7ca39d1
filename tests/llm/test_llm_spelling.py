"""Spelling variants against every pair of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.llm import spelling

SCHEMA = "doc_id long, text string"
LOWER = {i: i + 32 for i in range(65, 91)}


def one_change(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def plain(docs) -> dict:
    counts: Counter = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{word}".encode())
            if i is not None and h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_change(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root)
    return out


def random_docs(seed: int, letters: str) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(3, 12))) for _ in range(60)]
    for _ in range(250):  # chains of changes, of falling frequency
        w = rng.choice([w for w in words if len(w) > 3])
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        words.append(w[:at] + ("" if kind == 0 else rng.choice(letters)) + w[at + (kind != 1) :])
    weights = [1 / (1 + i) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 120)))) for i in range(150)]
    return rows + [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, ""), (902, "1 2 3 – ÷×÷×÷ ÷×÷×÷ ÷×÷×÷ STRAßE Straße straße"), (902, "Łódź straßen naïveté… naïveté naïveté 日本naïveté語"), (903, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 3000 + " " + ("a" * 2999 + " ") * 7)]


@pytest.mark.parametrize(("seed", "letters"), [(1, "abc"), (2, "abcdefghij"), (3, "aéÉàbßÿ"), (4, "ab")])
def test_words_are_those_of_all_pairs(spark, seed, letters):
    rows = random_docs(seed, letters)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("word", "n", "root", "key", "doc")}).repartition(5)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(docs).collect()}
    assert got == plain(rows)


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(7)
    for _ in range(300):
        word = "".join(rng.choices("abcd", k=rng.randint(5, 12)))
        frequency = {a + b: rng.randint(1, 20) for a in "abcd" for b in "abcd"}
        prefix = spelling.gram_prefix(word, frequency)
        a, b = spelling.pivots(prefix)
        cost = {at: n for n, _, at in prefix}
        assert cost[a] + cost[b] == min(cost[x] + cost[y] for x in cost for y in cost if y - x >= 2) and b - a >= 2


def test_counts_leave_tasks_in_parts(spark):
    rows = [(1, " ".join(f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}" for i in range(300)))]
    make, most, part = spelling._counts, spelling.COUNTED, spelling.PART
    spelling.COUNTED, spelling.PART = 7, 100
    try:
        parts = [b for batch in spark.createDataFrame(rows, "doc string, text string").toArrow().to_batches() for b in make([batch])]
    finally:
        spelling.COUNTED, spelling.PART = most, part
    total: Counter = Counter()
    for b in parts:
        total.update(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True)))
    assert len(parts) > 5 and sum(total.values()) == 300


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
