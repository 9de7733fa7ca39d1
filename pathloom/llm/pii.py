"""Personal data by patterns and a skip-chain conditional random field.

Patterns with checks give the base spans. Around them a random field over the document's tokens with digits or ``@``
finds more: unary potentials of hashed token features, chain potentials between neighbours, and skip potentials
between repeated or similar tokens however far apart: each is linked to the first observed one of every label, or to
the first of all where none is observed. Base tokens are observed, all others are not, matches that fail their check
included; loopy message passing, until no message moves, carries labels to tokens that look or read like them. Tokens
without digits and ``@`` cannot be part of an entity, so they need no node.

Weights are learned by pseudo-likelihood on a bounded sample of documents, in which entities are mentioned once more in
forms that no pattern finds, beside decoys of the same forms with other digits, and a share of the base entities is
hidden from their neighbours. So form alone does not make an entity, and links to one do. Tokens that repeat a base
entity without being one are not taught as anything.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import set_aside, share_of, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Hash bits of token features; bound of the learning sample: documents, and nodes drawn from all of one document.
BITS, SAMPLE_DOCS, SAMPLE_NODES = 14, 3000, 100
#: Learning: share of base entities hidden from their neighbours, further mentions of each on average, decoys for each mention.
HIDE, MENTIONS, DECOYS = 0.3, 2.0, 2
#: A token that no pattern found becomes a span from this marginal on.
SURE = 0.8
#: A message's updates at full step, later ones shrink so that loops that swing settle; a message or node rests below STILL.
ROUNDS, DAMPING, STILL = 100, 0.3, 1e-7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_HEAD, _ALNUM = re.compile(r"[@\[({<]"), re.compile(r"[^a-z0-9]")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&="


def _luhn(digits: list[int]) -> bool:
    double = sum(d * 2 - 9 * (d > 4) for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + double) % 10 == 0


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def patterns(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind, end) in order, and spans that matched a pattern but failed its check.

    Each scan is linear in the text: an address is sought from its ``@``, dotted numbers are taken run by run.
    """
    found, failed = [], []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, done := m.end()))
        at = text.find("@", m.end() if m else at + 1)
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() >= 7 and text.count(".", m.start(), m.end()) >= 3:
            at, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found.append((at, 1, end))
                else:
                    failed.append((at, end))
                at = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
            else:
                failed.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
            else:
                failed.append(m.span())
    return sorted(found), failed


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans between white space that hold a digit or ``@``, without signs at their ends."""
    out, end = [], 0
    while m := _MARK.search(text, end):
        at = m.start()
        start = max(text.rfind(c, end, at) for c in " \n\t\r\x0b\x0c") + 1
        start = max(start, end)
        stop = at + 1
        while stop < len(text) and text[stop] not in " \n\t\r\x0b\x0c":
            stop += 1
        end = stop
        while text[start] in _EDGE:
            start += 1
        while text[stop - 1] in _EDGE:
            stop -= 1
        out.append((start, stop))
    return out


def _shape(token: str) -> str:
    out = []
    for c in token[:40]:
        k = "9" if c.isdigit() else "a" if c.isalpha() else c
        if len(out) < 3 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)


def similar_as(token: str) -> list[str]:
    """Keys under which differently written tokens are similar: their last seven digits, their letters and digits.

    Letters and digits count up to ``@`` or a bracket, so that an address and its spelled-out form share a key.
    """
    digits = "".join(c for c in token if "0" <= c <= "9")
    head = _ALNUM.sub("", _HEAD.split(token.lower(), maxsplit=1)[0])
    keys = [digits[-7:]] if len(digits) >= 7 else []
    return keys + ["a" + head] if len(head) >= 4 and not head.isdigit() and not head.isalpha() else keys


def _features(text: str, start: int, stop: int, failing: bool, previous: int, following: int) -> list[int]:
    token = text[start:stop]
    before, after = text[max(0, start - 24) : start].split(), text[stop : stop + 24].split()
    n = sum(c.isdigit() for c in token[:64])
    names = (
        "bias", f"s:{failing}:{_shape(token)}", f"l:{failing}:{min(24, len(token))}:{min(n, 20)}", "b:" + (before[-1][-12:].lower() if before else ""),
        "a:" + (after[0][:12].lower() if after else ""), "p:" + _shape(token[:4]), "e:" + _shape(token[-4:]), f"f:{failing}", f"@:{'@' in token}",
        f"+:{text[max(0, start - 1) : start + 1]}"[:4], f"d:{token.count('.')}:{token.count('-')}", f"g:{min(previous, 3)}:{min(following, 3)}",
    )
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


#: Features of a node, and kinds of edges: next token with only white space or signs between, next token near by, same token, similar token
#: (a repeat of a long token has both of the last two).
N_FEATURES, NEXT, NEAR, SAME, ALIKE = 12, 0, 1, 2, 3


class Graph:
    """Nodes and edges of some documents: features, observed labels (-1: hidden), and edges (from, to, kind)."""

    def __init__(self):
        self.spans, self.features, self.label, self.hidden, self.edges, self.documents = [], [], [], [], [], []

    def add(self, text: str, base: list[tuple[int, int, int]], failed: list[tuple[int, int]]) -> None:
        nodes = tokens(text)
        offset = len(self.spans)
        self.documents.append((offset, offset + len(nodes)))
        starts, stops = [a for a, _ in nodes], [b for _, b in nodes]

        def under(start: int, end: int) -> range:
            return range(bisect_right(stops, start), bisect_left(starts, end))

        label, failing = [0] * len(nodes), [False] * len(nodes)
        for start, kind, end in reversed(base):  # the first one counts
            for i in under(start, end):
                label[i] = kind + 1
        for start, end in failed:
            for i in under(start, end):
                failing[i] = not label[i]
        names = []
        for i, (start, stop) in enumerate(nodes):
            gap = start - nodes[i - 1][1] if i else 99
            ahead = nodes[i + 1][0] - stop if i + 1 < len(nodes) else 99
            self.spans.append((start, stop))
            self.features.append(_features(text, start, stop, failing[i], gap.bit_length(), ahead.bit_length()))
            self.label.append(label[i])
            self.hidden.append(not label[i])
            if i and gap <= 40:
                self.edges.append((offset + i - 1, offset + i, NEXT if gap <= 3 else NEAR))
            token = text[start:stop].lower()
            names.append([(token, SAME), *((k, ALIKE) for k in similar_as(token))])
        hubs: dict = {}
        for i, keys in enumerate(names):
            for key in keys:
                hubs.setdefault(key, {}).setdefault(label[i], i)
        found = set()
        for i, keys in enumerate(names):
            for key in keys:
                firsts = hubs[key]
                for kind, hub in firsts.items():
                    twice = firsts[label[i]] == i and label[i] and hub > i and kind
                    if hub != i and not twice and (kind or len(firsts) == 1):
                        found.add((offset + min(hub, i), offset + max(hub, i), key[1]))
        self.edges += sorted(found)


class Field:
    """Unary weights of hashed features and a table of label pairs for each kind of edge."""

    def __init__(self):
        self.unary = np.zeros((1 << BITS, len(LABELS)))
        self.pair = np.zeros((4, len(LABELS), len(LABELS)))

    def fit(self, features: np.ndarray, label: np.ndarray, edges: np.ndarray, rounds: int = 600, rate: float = 0.3) -> Field:
        """``learned`` from a graph with all nodes."""
        around = np.zeros((len(label), self.pair.size * 2 // len(LABELS)))
        if len(edges):
            np.add.at(around, neighbours(label, edges)[:2], 1)
        return self.learned(features, label, around, rounds, rate)

    def learned(self, features: np.ndarray, label: np.ndarray, around: np.ndarray, rounds: int = 600, rate: float = 0.3) -> Field:
        """Pseudo-likelihood: each label given its features and its neighbours' labels; AdaGrad over all nodes.

        ``around`` counts a node's neighbours by ``neighbours``, so a node needs no other node's row.
        """
        n, k = len(label), len(LABELS)
        if not n:
            return self
        gold = np.eye(k)[label]
        sq_u, sq_p = np.full_like(self.unary, 1e-6), np.full_like(self.pair, 1e-6)
        for _ in range(rounds):
            z = self.unary[features].sum(axis=1)
            z += around @ np.stack([self.pair, self.pair.transpose(0, 2, 1)], axis=1).reshape(-1, k)
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p = p / p.sum(axis=1, keepdims=True) - gold
            step = 1e-4 * self.unary
            for j in range(k):
                step[:, j] += np.bincount(features.ravel(), weights=np.repeat(p[:, j], features.shape[1]), minlength=len(step)) / n
            sq_u += step**2
            self.unary -= rate * step / np.sqrt(sq_u)
            push = (around.T @ p).reshape(-1, 2, k, k) / n
            step = 1e-6 * self.pair + push[:, 0] + push[:, 1].transpose(0, 2, 1)
            sq_p += step**2
            self.pair -= 3 * rate * step / np.sqrt(sq_p)
        return self

    def beliefs(self, graph: Graph) -> np.ndarray:
        """Marginals of all nodes by damped loopy message passing; observed nodes send their label alone."""
        n, k = len(graph.spans), len(LABELS)
        if not n:
            return np.zeros((0, k))
        unary = self.unary[np.asarray(graph.features)].sum(axis=1)
        observed = ~np.asarray(graph.hidden)
        clamp = np.where(np.eye(k, dtype=bool)[np.asarray(graph.label)], 0.0, -50.0)
        unary[observed] = clamp[observed]
        if not graph.edges:
            return _normal(unary)
        u, v, kind = np.asarray(graph.edges).T
        m = len(u)
        source, target = np.concatenate([u, v]), np.concatenate([v, u])
        table = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])
        message, updates, total, live = np.zeros((2 * m, k)), np.zeros(2 * m), unary.copy(), ~observed[target]
        sent, active = total.copy(), np.flatnonzero(live)
        while len(active):
            updates[active] += 1
            step = (1 - DAMPING) * np.minimum(1, ROUNDS / updates[active])
            moved = step[:, None] * (_pass(total[source[active]] - message[(active + m) % (2 * m)], table[active]) - message[active])
            message[active] += moved
            np.add.at(total, target[active], moved)
            touched = np.abs(total - sent).max(axis=1) > STILL
            sent[touched] = total[touched]
            again = touched[source] & live
            again[active[np.abs(moved).max(axis=1) > STILL]] = True
            active = np.flatnonzero(again)
        return _normal(total)


def rewritten(kind: int, entity: str, form: int) -> str:
    """An entity in another form, which patterns do not find as a rule."""
    digits = "".join(c for c in entity if "0" <= c <= "9")
    if kind == 0:
        return entity.replace("@", ("[at]", "(at)", "{at}")[form % 3])
    if kind == 1:
        return (entity.replace(".", "-"), "[.]".join(entity.rsplit(".", 1)), entity.replace(".", "_"))[form % 3]
    if kind == 2:
        return (".", "/", "_")[form % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, middle, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    return (f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}", area + middle + last, f"{area}/{middle}{last}")[form % 5]


def exercised(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """``text`` with rewritten mentions of its entities and decoys at random places, and their (start, label, end).

    Decoys are the same forms with other digits, and single pieces of entities; addresses have none, as a
    spelled-out address is one also where it stands alone.
    """
    extra: list[tuple[int, str, int]] = []

    used: set[int] = set()

    def put(mention: str, label: int) -> None:
        """At a space between letters, as signs and digits next to an entity can change what patterns find."""
        for _ in range(20):
            at = text.find(" ", int(rng.integers(0, len(text))))
            if at > 0 and at not in used and text[at - 1].isalpha() and text[at + 1 : at + 2].isalpha():
                used.add(at)
                extra.append((at, mention, label))
                return

    def other(entity: str) -> str:
        return "".join(str(rng.integers(0, 10)) if "0" <= c <= "9" else c for c in entity)

    for start, kind, end in patterns(text)[0]:
        entity = text[start:end]
        for _ in range(int(rng.poisson(MENTIONS))):
            form = int(rng.integers(0, 60))
            put(rewritten(kind, entity, form), kind + 1)
            if not kind:
                continue
            for _ in range(DECOYS):
                put(rewritten(kind, other(entity), form), 0)
            pieces = [t for t in re.split(r"[^0-9]+", entity if kind != 2 else entity[:4]) if t]
            put(pieces[int(rng.integers(0, len(pieces)))], 0)
    out, marks, at, size = [], [], 0, 0
    for where, mention, label in sorted(extra):
        out += [text[at:where], " ", mention]
        size += where - at + 1 + len(mention)
        marks.append((size - len(mention), label, size))
        at = where
    return "".join([*out, text[at:]]), marks


def neighbours(label: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For both ends of each edge: the node, a number of edge kind, side and label of the other end, and the other end."""
    u, v, kind = edges.T
    number = np.concatenate([2 * kind * len(LABELS) + label[u], (2 * kind + 1) * len(LABELS) + label[v]])
    return np.concatenate([v, u]), number, np.concatenate([u, v])


def _pass(send: np.ndarray, table: np.ndarray) -> np.ndarray:
    x = send[:, :, None] + table
    top = x.max(axis=1, keepdims=True)
    m = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
    return m - m.max(axis=1, keepdims=True)


def _normal(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def spans_of(texts: list[str], field: Field, sure: float = SURE) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Per text: base spans and all spans, each (start, kind, end) in order."""
    graph, bases = Graph(), []
    for text in texts:
        base, failed = patterns(text)
        bases.append(base)
        graph.add(text, base, failed)
    belief, out = field.beliefs(graph), []
    for text, base, (lo, hi) in zip(texts, bases, graph.documents):
        best = belief[lo:hi].argmax(axis=1)
        new: list[tuple[int, int, int]] = []
        for i in np.flatnonzero((best > 0) & (belief[lo:hi].max(axis=1, initial=0.0) >= sure) & np.asarray(graph.hidden[lo:hi], dtype=bool)):
            start, stop = graph.spans[lo + i]
            if new and new[-1][1] == best[i] - 1 and start - new[-1][2] <= 3:
                new[-1] = (new[-1][0], new[-1][1], stop)
            else:
                new.append((start, int(best[i]) - 1, stop))
        out.append((base, sorted(base + new)))
    return out


def learn(docs: DataFrame, most: int = SAMPLE_DOCS, nodes: int = SAMPLE_NODES) -> Field:
    """Fit on at most about ``most`` documents drawn by a hash of their ids, ``nodes`` tokens drawn from all of each.

    Graphs of whole documents are built on the executors; the driver gets features, labels and counted neighbours of
    the drawn nodes, so edges count however far they reach.
    """
    marked = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    share = min(1.0, most / max(1, marked.count()))
    drawn = marked.filter(share_of(F.xxhash64(F.lit(17), "doc_id"), F.lit(share)))

    def nodes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([sampled(text, nodes) for text in batch["text"]], columns=["features", "label", "around"])

    rows = drawn.mapInPandas(nodes_of, "features array<int>, label array<int>, around array<int>").collect()
    rows.sort(key=lambda r: (r["features"], r["label"], r["around"]))
    features, label, around = [], [], []
    for r in rows:
        near = np.asarray(r["around"], dtype=np.int64).reshape(-1, 3)
        near[:, 0] += len(label)
        around.append(near)
        features += r["features"]
        label += r["label"]
    field = Field()
    counts = np.zeros((len(label), field.pair.size * 2 // len(LABELS)))
    if around:
        at, what, n = np.concatenate(around).T
        counts[at, what] = n
    return field.learned(np.asarray(features, dtype=np.int64).reshape(-1, N_FEATURES), np.asarray(label, dtype=np.int64), counts)


def sampled(text: str, most: int, exercise: bool = True) -> tuple[list[int], list[int], list[int]]:
    """Features and labels of at most ``most`` nodes drawn from the whole text, and (node, neighbour number, count)."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    given: list[tuple[int, int, int]] = []
    if exercise:
        text, given = exercised(text, rng)
    graph, base = Graph(), patterns(text)
    graph.add(text, *base)
    n, label = len(graph.spans), np.asarray(graph.label, dtype=np.int64)
    starts, stops = [a for a, _ in graph.spans], [b for _, b in graph.spans]
    edges = np.asarray(graph.edges, dtype=np.int64).reshape(-1, 3)
    known = np.ones(n, dtype=bool)
    for u, v, kind in graph.edges:  # repeats of an entity are not taught as anything
        if kind >= SAME and bool(label[u]) != bool(label[v]):
            known[v if label[u] else u] = False
    shown = np.ones(n, dtype=bool)
    for start, kind, end in base[0]:
        if exercise and rng.random() < HIDE:
            shown[bisect_right(stops, start) : bisect_left(starts, end)] = False
    linked = {int(i) for u, v, kind in graph.edges if kind >= SAME for i, j in ((u, v), (v, u)) if shown[j] and not graph.hidden[j]}
    for start, kind, end in given:  # of the mentions those that something tells from decoys
        for i in range(bisect_right(stops, start), bisect_left(starts, end)):
            if graph.hidden[i]:
                label[i], known[i] = kind, kind in (0, 1) or i in linked
    places = np.flatnonzero(known)
    picked = places if len(places) <= most else np.sort(rng.choice(places, most, replace=False))
    place = np.full(n, -1)
    place[picked] = np.arange(len(picked))
    around = np.zeros((0, 3), dtype=np.int64)
    if len(edges):
        node, what, other = neighbours(label, edges)
        held = (place[node] >= 0) & shown[other] & known[other]
        pairs, counts = np.unique(np.stack([place[node[held]], what[held]], axis=1), axis=0, return_counts=True)
        around = np.column_stack([pairs, counts])
    return sum((graph.features[i] for i in picked), []), label[picked].tolist(), around.ravel().tolist()


def _groups(texts: list[str], size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def find(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: an array of (kind, start, end, base) of whole texts, in code points, end exclusive.

    Base spans are always there; those of the random field come besides and never overlap a base span's token.
    Null and empty texts have none. Repeated rows get the same. Texts of any length are read whole. A caller's own
    ``pii`` becomes ``pii_given``. An empty table gives no rows.
    """

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,base:boolean>>")
    def spans(column: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else "" for t in column]
        out = []
        for _, part in _groups(texts):
            for base, every in spans_of(part, field):
                known = set(base)
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": (s, k, e) in known} for s, k, e in every])
        return pd.Series(out, dtype=object)

    plain = set_aside(docs, "pii")
    return plain.withColumn("pii", spans(F.col(text).cast("string")))


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; null texts stay null.

    Of overlapping spans the first is replaced and the rest of the others goes with it. Rows keep all their columns.
    """

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else "" for t in column]
        out = []
        for start, part in _groups(texts):
            for i, (t, (_, every)) in enumerate(zip(part, spans_of(part, field)), start):
                pieces, at = [], 0
                for s, k, e in every:
                    if s >= at:
                        pieces += [t[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                out.append("".join([*pieces, t[at:]]) if isinstance(column.iloc[i], str) else None)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean(F.col("text").cast("string")))


def digest(docs: DataFrame, field: Field) -> DataFrame:
    """Per document the counts of base spans by kind, the digest of the base spans and all spans as text."""
    found = find(docs.select("doc_id", "text"), field)
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("pii", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("pii", line), ",").alias("spans"))


def _op10(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs, learn(docs))


QUERIES = {"op10_pii": _op10}
