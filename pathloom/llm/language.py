"""Language ID by a linear-chain conditional random field over the words of code-switched text.

A word's features are its character pairs, triples and quadruples, with the word's ends as characters (so that they
hold prefixes and suffixes of up to three letters), and the word itself. Emission weights of hashed features and
transition weights between the languages of neighbouring words are learned together by maximum likelihood;
forward-backward labels the words, and a document's language is the one with the largest sum of word marginals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import held_out, set_aside, share_of, small_batches

#: Bits of the hashed tables: pairs, triples, quadruples, whole words.
BITS = (13, 15, 15, 16)
#: Bound of the learning sample: passages of each language, and code points of a passage.
PASSAGES, PASSAGE = 300, 1000
#: Code points handled at a time.
BLOCK = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_WORDISH = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _WORDISH.finditer(text))


def _letters(codes: np.ndarray) -> np.ndarray:
    """Code points that words are made of; ASCII signs, digits and general punctuation are not."""
    ascii_letter = (codes >= 97) & (codes <= 122)
    other = (codes >= 0xAA) & (codes != 0xD7) & (codes != 0xF7) & ((codes < 0x2000) | (codes > 0x206F)) & ((codes < 0x3000) | (codes > 0x303F)) & (codes != 0xBB) & (codes != 0xAB) & (codes != 0xBF)
    return ascii_letter | other


def _hash(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def word_features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Words of lower-cased code points: (first position, position after the last, hashed n-grams by position, word hash).

    N-grams end at their position; the position after a word holds those that end with the word's end.
    """
    c = np.zeros(len(codes) + 4, dtype=np.uint64)
    c[3:-1] = np.where(_letters(codes), codes, 0)
    inside = c != 0
    first = np.flatnonzero(inside[3:-1] & ~inside[2:-2])
    after = np.flatnonzero(~inside[3:] & inside[2:-1])
    c0, c1, c2, c3 = c[3:], c[2:-1], c[1:-2], c[:-3]
    c2 = np.where(c1 == 0, 0, c2).astype(np.uint64)
    c3 = np.where(c2 == 0, 0, c3).astype(np.uint64)
    two = c0 + (c1 << np.uint64(21))
    three = two + c2 * np.uint64(0xD6E8FEB86659FD93)
    four = three + c3 * np.uint64(0xA0761D6478BD642F)
    grams = [_hash(two, BITS[0]), _hash(three, BITS[1]), _hash(four, BITS[2])]
    powers = np.full(len(c0), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(c0 * powers)])
    inverse = np.full(len(c0), _BASE_INVERSE)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    whole = (sums[after] - sums[first]) * inverse[first]
    return first, after, grams, _hash(whole ^ (whole >> np.uint64(29)), BITS[3])


class Model:
    """Languages, hashed emission tables, transitions and beginnings (log potentials)."""

    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages = languages
        self.tables = [np.zeros((1 << b, n), dtype=np.float32) for b in BITS]
        self.transition, self.start = np.zeros((n, n)), np.zeros(n)

    def emissions(self, first, after, grams, whole) -> np.ndarray:
        if not len(first):
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        by_place = self.tables[0].take(grams[0], axis=0)
        by_place += self.tables[1].take(grams[1], axis=0)
        by_place += self.tables[2].take(grams[2], axis=0)
        cuts = np.empty(2 * len(first), dtype=np.int64)
        cuts[0::2], cuts[1::2] = first, np.minimum(after + 1, len(by_place) - 1)
        return np.add.reduceat(by_place, cuts, axis=0)[::2] + self.tables[3].take(whole, axis=0)


def marginals(emission: np.ndarray, begins: np.ndarray, transition: np.ndarray, start: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over many sequences laid end to end: word marginals and, on demand, expected transition counts.

    ``begins`` marks first words. The stream is cut into columns that advance together; each column's product of
    transfer matrices tells what flows into and out of it, so cuts change nothing. Any length costs the same a word.
    Messages are scaled every few steps only.
    """
    n, k = emission.shape
    steps = int(min(128, max(8, np.sqrt(n))))
    columns = -(-n // steps)
    e = np.ones((columns * steps, k))
    np.exp(np.maximum(emission - emission.max(axis=1, keepdims=True), -30.0), out=e[:n])
    b = np.ones(columns * steps, dtype=bool)
    b[:n] = begins
    e = np.ascontiguousarray(e.reshape(columns, steps, k).transpose(1, 0, 2))
    at = [np.flatnonzero(row) for row in b.reshape(columns, steps).T]
    a, pi = np.exp(transition), np.exp(start)
    product = np.broadcast_to(np.eye(k), (columns, k, k)).copy()
    for t in range(steps):
        total = product[at[t]].sum(axis=2)
        product = (product.reshape(-1, k) @ a).reshape(columns, k, k)
        product[at[t]] = total[:, :, None] * pi
        product *= e[t][:, None, :]
        if t % 8 == 7:
            product /= product.max(axis=(1, 2), keepdims=True)
    into, out = np.ones((columns, k)), np.ones((columns, k))
    for c in range(1, columns):
        v = into[c - 1] @ product[c - 1]
        into[c] = v / v.sum()
    for c in range(columns - 2, -1, -1):
        v = product[c + 1] @ out[c + 1]
        out[c] = v / v.sum()
    alpha, beta = np.empty((steps, columns, k)), np.empty((steps, columns, k))
    v = into
    for t in range(steps):
        v = v @ a
        v[at[t]] = pi
        v *= e[t]
        if t % 8 == 7:
            v /= v.sum(axis=1, keepdims=True)
        alpha[t] = v
    v = out
    for t in range(steps - 1, -1, -1):
        beta[t] = v
        v = (e[t] * v) @ a.T
        v[at[t]] = 1.0
        if t % 8 == 0:
            v /= v.sum(axis=1, keepdims=True)
    expected = None
    if counts:
        left = np.concatenate([into[None], alpha[:-1]])
        right = e * beta
        inner = ~b.reshape(columns, steps).T
        left, right = left[inner], right[inner]
        expected = a * (left.T @ (right / ((left @ a) * right).sum(axis=1, keepdims=True)))
    alpha *= beta
    alpha /= alpha.sum(axis=2, keepdims=True)
    return alpha.transpose(1, 0, 2).reshape(columns * steps, k)[:n], expected


def fit(texts: list[str], labels: list[str], rounds: int = 30, rate: float = 0.3, seed: int = 3) -> Model | None:
    """Learn from texts with one language each; spans of different texts are joined, so that switches are learned too."""
    languages = sorted(set(labels))
    if not languages:
        return None
    model, rng = Model(languages), np.random.default_rng(seed)
    firsts, afters, wholes, gold, parts, at, spans, n_words = [], [], [], [], [[], [], []], 0, [], 0
    for text, label in zip(texts, labels):
        codes = np.frombuffer((text.lower() + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first, after, grams, whole = word_features(codes)
        firsts.append(first + at)
        afters.append(after + at)
        wholes.append(whole)
        for i, g in enumerate(grams):
            parts[i].append(g)
        gold.append(np.full(len(first), languages.index(label)))
        cuts = sorted({0, len(first), *rng.integers(0, len(first) + 1, size=len(first) // 30).tolist()})
        spans += [np.arange(n_words + i, n_words + j) for i, j in zip(cuts, cuts[1:])]
        at += len(grams[0])
        n_words += len(first)
    if not n_words:
        return model
    first, after, whole, y = (np.concatenate(x) for x in (firsts, afters, wholes, gold))
    grams = [np.concatenate(p) for p in parts]
    order = rng.permutation(len(spans))
    words = np.concatenate([spans[i] for i in order])
    begins = np.zeros(n_words, dtype=bool)
    begins[np.cumsum([0] + [len(spans[i]) for i in order])[:-1:4]] = True  # four spans make a sequence
    y = y[words]
    truth = np.zeros_like(model.transition)
    np.add.at(truth, (y[:-1][~begins[1:]], y[1:][~begins[1:]]), 1)
    owner = np.repeat(np.arange(n_words), after + 1 - first)
    places = np.concatenate([np.arange(i, j) for i, j in zip(first, after + 1)])
    squares = [np.full_like(t, 1e-6) for t in model.tables]
    sq_a, sq_s = np.full_like(model.transition, 1e-6), np.full_like(model.start, 1e-6)
    for _ in range(rounds):
        emission = model.emissions(first, after, grams, whole)[words]
        found, expected = marginals(emission, begins, model.transition, model.start, counts=True)
        found[np.arange(n_words), y] -= 1.0
        miss = np.empty_like(found)
        miss[words] = found
        for i, (table, square) in enumerate(zip(model.tables, squares)):
            index, of = (grams[i][places], owner) if i < 3 else (whole, np.arange(n_words))
            step = np.stack([np.bincount(index, weights=miss[of, j], minlength=len(table)) for j in range(len(languages))], axis=1) / n_words + 1e-7 * table
            square += step**2
            table -= (rate * step / np.sqrt(square)).astype(np.float32)
        step = (expected - truth) / n_words + 1e-4 * model.transition
        sq_a += step**2
        model.transition -= rate * step / np.sqrt(sq_a)
        step = found[begins].sum(axis=0) / n_words + 1e-4 * model.start
        sq_s += step**2
        model.start -= rate * step / np.sqrt(sq_s)
    return model


def _blocks(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of about ``BLOCK`` code points that end at a sign between words, where there is one."""
    at = 0
    while at < len(codes):
        end = at + BLOCK
        if end < len(codes):
            gaps = np.flatnonzero(~_letters(codes[at:end]))
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        yield codes[at:end]
        at = end


def label_texts(model: Model | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, mean marginal) of each text; ("und", 0.0) for texts that are null or have no letter."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if model is None:
        return out
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        parts, counts = [], []
        lowered = [texts[i].lower() + "\n" for i in group]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(t) for t in lowered])
        at, starts = 0, []
        for block in _blocks(codes):
            first, after, grams, whole = word_features(block)
            parts.append(model.emissions(first, after, grams, whole))
            starts.append(first + at)
            at += len(block)
        emission, place = np.concatenate(parts), np.concatenate(starts)
        counts = np.diff(np.concatenate([[0], np.searchsorted(place, ends)]))
        if len(emission):
            begins = np.zeros(len(emission), dtype=bool)
            heads = np.cumsum(counts) - counts
            begins[heads[counts > 0]] = True
            sums = np.add.reduceat(marginals(emission, begins, model.transition, model.start)[0], heads[counts > 0], axis=0)
            best = sums.argmax(axis=1)
            mean = sums[np.arange(len(best)), best] / counts[counts > 0]
            for i, j, m in zip(np.asarray(group)[counts > 0], best, mean):
                out[i] = (model.languages[j], float(min(1.0, max(0.0, m))))
        likely = int(model.start.argmax())
        for i in np.asarray(group)[counts == 0]:  # letters, but none that words are made of here
            out[i] = (model.languages[likely], 1.0 / len(model.languages))
        group.clear()
        held = 0

    for i, text in enumerate(texts):
        if has_letter(text):
            group.append(i)
            held += len(text)
            if held >= BLOCK:
                flush()
    if group:
        flush()
    return out


def learn(docs: DataFrame, per_language: int = PASSAGES, size: int = PASSAGE) -> Model | None:
    """Fit on a bounded sample of labelled rows: about ``per_language`` passages of each language.

    Whole texts are cut into passages of ``size`` code points, and every passage of every document that is not held
    out and has text and lang is as likely to be drawn, by a hash of doc_id and place. A first scan counts passages by
    language (a model has its languages on the driver anyway), a second one cuts the drawn ones on the executors.
    """
    named = docs.filter(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    named = named.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    passages = F.ceil(F.length("text") / F.lit(size)).cast("long")
    counts = [(r[0], r[1]) for r in named.groupBy("lang").agg(F.sum(passages)).collect()]
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for value, n in counts for x in (value, min(1.0, per_language / max(1, n)))])
    places = F.filter(F.sequence(F.lit(0).cast("long"), passages - 1), lambda i: share_of(F.xxhash64("doc_id", i, F.lit(13)), F.element_at(share, F.col("lang"))))
    drawn = named.filter(passages > 0).withColumn("place", F.explode(places))
    rows = drawn.select("lang", F.col("text").substr((F.col("place") * size + 1).cast("int"), F.lit(size)).alias("passage")).orderBy("lang", "passage").collect()
    return fit([r["passage"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (mean marginal of that language over the words).

    Whole texts are labelled. Null texts and texts without a letter are ``und`` with score 0; without any learned
    language all are. Of languages with equal sums the first in code point order wins. Repeated rows are labelled alike,
    and an empty table gives no rows. Only the text is an input. A caller's own ``lang_pred`` or ``score`` gets the
    suffix ``_given``.
    """

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(label_texts(model, [t if isinstance(t, str) else None for t in texts]), columns=["lang_pred", "score"])

    named = set_aside(docs.withColumn("__label", label(F.col(text).cast("string"))), "lang_pred", "score")
    return named.withColumn("lang_pred", F.col("__label.lang_pred")).withColumn("score", F.col("__label.score")).drop("__label")


def _op2(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = identify(docs.select("doc_id", "text"), learn(docs))
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language": _op2}
