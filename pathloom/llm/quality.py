"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Boosted shallow trees are grown on a bounded sample; every path from a root is a conjunctive rule; lasso logistic
regression keeps a few of them. Scoring is a sum of CASE expressions over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import held_out, learning_sample, set_aside, small_batches

#: Bound of the learning sample: rows of each label.
ROWS_PER_LABEL = 3000
STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digits", "marks", "symbols", "pipes", "bangs", "stops",
    "line_ends", "beyond_ascii", "distinct_words", "repeated_next", "short_words", "repeated_lines", "top_word",
)
PREDICT_FROM = 0.7


def _share(counts: np.ndarray, chars: str, n: int) -> float:
    return float(counts[[ord(c) for c in chars]].sum()) / n


def statistics_of(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text in the order of ``STATISTICS``; all 0 for null and for texts without words."""
    words = (text or "").split()
    if not words:
        return (0.0,) * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts, n, w = np.bincount(raw, minlength=256), len(raw), len(words)
    frequency: dict[str, int] = {}
    for x in words:
        frequency[x] = frequency.get(x, 0) + 1
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=w)
    lines = text.split("\n")
    return (
        float(np.log1p(n)), float(np.log1p(w)), float(lengths.mean()), float(np.log1p(lengths.max())),
        float(counts[65:91].sum()) / n, float(counts[48:58].sum()) / n,
        float(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / n,
        _share(counts, "#$%&*@^~", n), _share(counts, "|", n), _share(counts, "!?", n), _share(counts, ".", n) * n / w,
        float(len(lines)) / w, float(counts[128:].sum()) / n, len(frequency) / w,
        sum(map(str.__eq__, words, words[1:])) / w, float((lengths <= 3).mean()), 1.0 - len(set(lines)) / len(lines), max(frequency.values()) / w,
    )


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``__stats`` of the statistics of whole texts."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t if isinstance(t, str) else None) for t in texts], columns=list(STATISTICS))

    return docs.withColumn("__stats", measure(F.col(text).cast("string")))


@dataclass
class Rule:
    """A conjunction of (statistic, above?, threshold), with its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), dtype=bool)
        for j, above, cut in self.terms:
            ok &= (x[:, j] > cut) if above else (x[:, j] <= cut)
        return ok

    def column(self, stats: str) -> Column:
        ok = F.lit(True)
        for j, above, cut in self.terms:
            value = F.col(f"{stats}.{STATISTICS[j]}")
            ok = ok & ((value > F.lit(cut)) if above else (value <= F.lit(cut)))
        return F.when(ok, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass
class Ensemble:
    bias: float = 0.0
    rules: list[Rule] = field(default_factory=list)

    def score(self, stats: str = "__stats") -> Column:
        """The score as one expression over the struct of statistics."""
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column(stats)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, step: np.ndarray, least: int) -> None:
    """Split ``rows`` by the largest gain of second-order boosting; add the paths to ``out`` and the leaves' values to ``step``."""
    if path:
        out.append(path)
    g, h = gradient[rows], hessian[rows]
    best, total_g, total_h = (1e-6, None), g.sum(), h.sum()
    if depth and len(rows) >= 2 * least:
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            index, size = bins[rows, j], len(cut) + 1
            left_g, left_h, left_n = (np.cumsum(np.bincount(index, weights=w, minlength=size))[:-1] for w in (g, h, np.ones(len(rows))))
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            gain[(left_n < least) | (len(rows) - left_n < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if best[1] is None:
        step[rows] = -total_g / (total_h + 1)
        return
    j, k = best[1]
    low = bins[rows, j] <= k
    for above, part in ((False, rows[low]), (True, rows[~low])):
        _grow(x, bins, cuts, gradient, hessian, part, depth - 1, (*path, (j, above, float(cuts[j][k]))), out, step, least)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, rate: float = 0.3, seed: int = 1) -> Ensemble:
    """Boost trees, take their paths as rules, and weigh these by lasso logistic regression (accelerated proximal steps)."""
    if not len(y) or y.min() == y.max():
        return Ensemble(0.0 if not len(y) else (4.0 if y[0] else -4.0))
    rng = np.random.default_rng(seed)
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1], method="lower"))
        cuts.append(q[q < x[:, j].max()])
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    z, paths = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows, step = np.flatnonzero(rng.random(len(y)) < 0.7), np.zeros(len(y))
        if not len(rows):
            continue
        found: list = []
        _grow(x, bins, cuts, p - y, p * (1 - p), rows, depth, (), found, step, max(5, len(y) // 200))
        paths += found
        z += rate * step
    rules = [Rule(t) for t in dict.fromkeys(tuple(sorted(p)) for p in paths)]
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    spread = np.maximum(a.std(axis=0), 0.05)
    a = a / spread
    center = a.mean(axis=0)
    a -= center
    size = np.linalg.norm(a, 2) ** 2 / (4 * len(y)) + 0.25
    w = v = np.zeros(a.shape[1])
    b = c = 0.0
    t = 1.0
    for _ in range(400):
        error = 1 / (1 + np.exp(-(a @ v + c))) - y
        w_new = v - a.T @ error / len(y) / size
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - penalty / size, 0)
        b_new = c - error.mean() / size
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    kept = [Rule(r.terms, float(x)) for r, x in zip(rules, w / spread) if abs(x) > 1e-6]
    return Ensemble(float(b - (center * w).sum()), kept)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = ROWS_PER_LABEL) -> Ensemble:
    """Fit on about ``per_label`` labelled documents of each label value that are not held out.

    The sample's ids are bounded by that parameter, so the documents meet them in a broadcast join; the driver gets
    their statistics only.
    """
    named = labels.filter(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    sample = learning_sample(named, "label", per_label)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).select("doc_id", "label", "__stats.*").toPandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["label"].to_numpy(float))


def classify(docs: DataFrame, model: Ensemble, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; only the text is an input.

    Null and empty texts have statistics of 0 and are scored by the same rules. Repeated rows are scored alike, and
    texts of any length are measured whole. Without labels every score is 0.5. A caller's own ``score`` or
    ``predicted`` gets the suffix ``_given``. An empty table gives no rows.
    """
    scored = set_aside(with_statistics(docs, text), "score", "predicted").withColumn("score", model.score())
    return scored.withColumn("predicted", F.when(F.col("score") >= PREDICT_FROM, 1).otherwise(0)).drop("__stats")


def _op5(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op5_quality": _op5}
