"""Spelling variants: words that one inserted, deleted or replaced character turns into each other.

Pairs are found by pivotal bigrams. Bigrams are ordered by the number of words that have them, rarest first, and a
word's gram prefix is its first three, with all repeats of the third. One change spoils at most two bigrams at touching
places, so of two disjoint bigrams of a prefix, the word's pivots, one is untouched. It is in the other word too, and in
that one's gram prefix if this word's prefix ends no later in the order. A dynamic programme picks the two disjoint
bigrams of the prefix that the fewest words have.

A change is right of the first pivot, or left of the second one. In the first case the words agree from their start
through that pivot, so its place is the same, else from the second pivot to their end, so its place from the end is. What
remains is cut once more at a place that both lengths tell: the change spares one of its halves. So each key holds a
pivot, its place, both lengths and about half of what is left of the word, and keys are met by few words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import discard, small_batches, written

#: Letters are A to Z, lower-cased, a to z and the characters from 192 to 255; of so many runs one loses a letter.
TYPO_OF = 97
#: Of each byte in Latin-1 its letter, or a space.
LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 192 else 32 for i in range(256))
#: Code points and occurrences of a word, and how many times as frequent a word's form is.
SHORTEST, LEAST, RATIO = 5, 3, 2
#: Different words that a task counts before it sends their counts on, and rows that it sends at a time.
COUNTED, SENT = 200_000, 20_000
#: Characters of a text that are split into runs at a time, and on to the end of a run.
PART = 1 << 20


# Words --------------------------------------------------------------------------------------------------------------


def runs_of(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters of a text, as Latin-1, a part of the text at a time. Other characters are not letters."""
    line = text.encode("latin-1", "replace").translate(LETTERS)
    lo = 0
    while lo < len(line):
        hi = line.find(b" ", lo + PART)
        hi = len(line) if hi < 0 else hi
        yield line[lo:hi].split()
        lo = hi


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts, with deletions made, counted within the task."""
    found: dict[bytes, int] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        words = list(found)
        for lo in range(0, len(words), SENT):
            own = words[lo : lo + SENT]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in own]), pa.array([found[w] for w in own], pa.int64())], ["word", "n"])
        found.clear()

    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
            head = zlib.crc32(f"{doc}:".encode()) if doc is not None else None
            for runs in runs_of(text.as_py()):
                for run, n in Counter(runs).items():
                    if head is not None:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
                        if h % TYPO_OF == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                    if len(run) >= SHORTEST:
                        found[run] = found.get(run, 0) + n
                if len(found) >= COUNTED:
                    yield from sent()
    yield from sent()


def counted_words(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: words of at least ``SHORTEST`` code points with at least ``LEAST`` occurrences in all texts."""
    rows = docs.select(F.col(id).cast("string").alias("doc"), F.col(text).alias("text")).filter(F.col(text).isNotNull())
    words = rows.mapInArrow(_counts, "word string, n bigint")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


# Pivots and prefixes ------------------------------------------------------------------------------------------------


def gram_prefix(word: str, frequency: dict[str, int]) -> list[tuple[int, str, int]]:
    """``(frequency, bigram, place)`` of the three rarest bigrams and of all repeats of the last one, rarest first."""
    grams = sorted((frequency[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
    k = 3
    while k < len(grams) and grams[k][1] == grams[2][1]:
        k += 1
    return grams[:k]


def pivots(prefix: list[tuple[int, str, int]]) -> tuple[int, int]:
    """Places of the two disjoint bigrams of a gram prefix with the smallest sum of frequencies.

    From left to right: the best bigram so far that ends before this one begins, and the best pair so far.
    """
    line = sorted((at, n) for n, _, at in prefix)
    best_pair, behind, ended = (float("inf"), -1, -1), (float("inf"), -1), 0
    for at, n in line:
        while line[ended][0] + 2 <= at:
            behind = min(behind, (line[ended][1], line[ended][0]))
            ended += 1
        if behind[1] >= 0:
            best_pair = min(best_pair, (behind[0] + n, behind[1], at))
    return best_pair[1], best_pair[2]


def keys(word: str, at: int, left: bool, own_length: int, other_length: int) -> tuple[str, str]:
    """The two keys of ``word`` for a bigram at ``at`` and partners of ``other_length``; equal words of a pair share one.

    ``left``: the words agree from their start through the bigram, else from the bigram to their end. Of the rest,
    as long as in the shorter word, its nearer part or its farther part agrees too.
    """
    least = min(own_length, other_length)
    if left:
        fixed, rest = word[: at + 2], word[at + 2 :]
        room = least - at - 2
        near, far = rest[: (room + 1) // 2], rest[len(rest) - room // 2 :]
    else:
        fixed, rest = word[at:], word[:at]
        room = least - (own_length - at)
        near, far = rest[len(rest) - (room + 1) // 2 :], rest[: room // 2]
    side = "l" if left else "r"
    return f"{side}n{fixed}|{near}", f"{side}f{fixed}|{far}"


_KEYS = "key bigint, role boolean, word string, n bigint, end int"


def _key_rows(frequency: dict[str, int]):
    """Words to digests of their keys as pivots (``role`` true) and as gram prefixes; ``end`` is where the prefix ends in the order of bigrams.

    A key also holds the lengths of the pivots' word and of the other one. What digests confuse is checked later.
    """
    place = {gram: i for i, (_, gram) in enumerate(sorted((n, g) for g, n in frequency.items()))}

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[int] = []
        own: list[tuple] = []  # (rows, role, word, n, end)

        def sent() -> pa.RecordBatch:
            times = np.array([t for t, *_ in own], np.int64)
            role, word, n, end = (list(c) for c in zip(*[o[1:] for o in own], strict=True)) if own else ([], [], [], [])
            at = pa.array(np.repeat(np.arange(len(own)), times))
            columns = [pa.array(c, kind).take(at) for c, kind in ((role, pa.bool_()), (word, pa.string()), (n, pa.int64()), (end, pa.int32()))]
            batch = pa.RecordBatch.from_arrays([pa.array(np.array(digests, np.uint64).view(np.int64)), *columns], ["key", "role", "word", "n", "end"])
            digests.clear()
            own.clear()
            return batch

        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                size, prefix = len(word), gram_prefix(word, frequency)
                first, second = pivots(prefix)
                for role, places in ((True, ((True, first), (False, second))), (False, [(left, at) for _, _, at in prefix for left in (True, False)])):
                    before = len(digests)
                    for left, at in places:
                        for other in (size - 1, size, size + 1):
                            if (at + 2 if left else size - at) > other:
                                continue  # the partner is too short to agree
                            lengths = f"{size},{other}" if role else f"{other},{size}"
                            for key in keys(word, at, left, size, other):
                                digests.append(xxhash.xxh3_64_intdigest(lengths + key))
                    own.append((len(digests) - before, role, word, n, place[prefix[-1][1]]))
                if len(digests) >= SENT:
                    yield sent()
        yield sent()

    return rows


def near_words(words: DataFrame) -> DataFrame:
    """Each pair of words one change apart, in both directions: ``word, n, other, other_n``.

    ``words`` are ``word, n`` of at least ``SHORTEST`` code points. The driver holds the frequency of bigrams: at most
    the square of the alphabet, 8,100. Large keys are split by Spark's skew join; every found pair is checked.
    """
    grams = words.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr("word", i, F.lit(2))))).alias("g"))
    frequency = {r["g"]: r["k"] for r in grams.groupBy("g").agg(F.count(F.lit(1)).alias("k")).collect()}
    rows = written(words.mapInArrow(_key_rows(frequency), _KEYS))
    its = rows.filter("not role").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("end").alias("other_end"))
    later = (F.col("end") < F.col("other_end")) | (F.col("end") == F.col("other_end")) & (F.col("word") < F.col("other"))
    found = rows.filter("role").join(its, "key").filter(later & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n").distinct()
    pairs = written(found)
    discard(rows)
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


# Forms and roots ----------------------------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the chain of forms ``word, form``, by jumps of doubling length.

    Occurrences at least double along a chain, so chains are short and never close; words that others lead to may be
    many words' form, where Spark splits the join.
    """
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, now = now, written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(before)
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all texts with their forms: ``word, n, n_near, form, form_n, root``.

    Words are runs of letters, A to Z lower-cased, counted over whole texts; one run in ``TYPO_OF`` of a document, by
    a checksum of id and run, loses a letter. Null texts have no words; a null id's runs lose none. Documents that repeat
    count each. Ties for the form go to the first word in the order of code points. Extra columns are left behind; an
    empty table gives no rows.
    """
    words = written(counted_words(docs, id, text))
    pairs = near_words(words)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), "other")).alias("s"), F.first("n").alias("n"))
    fits = -F.col("s.k") >= RATIO * F.col("n")
    best = written(best.select("word", "n_near", F.when(fits, F.col("s.other")).alias("form"), F.when(fits, -F.col("s.k")).alias("form_n")))
    roots = _roots(best.filter("form is not null"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def _op12(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op12_spelling": _op12}
