"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one feature at a time, and added up into one lookup table per
feature; then the pairs of features that explain most of what is left get tables of their own. A
text's score is the sum of the table entries of its bins. Fitting takes a bounded sample of labelled rows to
the driver as numbers, never as texts; scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

FEATURES = (
    "bytes", "words", "word_length", "letters", "upper", "digits", "sentence_marks", "exclamation", "bars", "symbols",
    "non_ascii", "lines", "line_words", "distinct_words", "distinct_lines", "short_words", "first_upper", "last_mark")
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[ord(c) for c in ".,;:"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[[ord(c) for c in "|<>{}[]"]] = 6
_CLASS[[ord(c) for c in "#$%&*+/=@\\^_`~"]] = 7
_CLASS[128:] = 8


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; NULL counts as empty. All are finite."""
    text = text or ""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words, lines = text.split(), text.split("\n")
    n, w = max(len(data), 1), max(len(words), 1)
    kinds = np.bincount(_CLASS[data], minlength=9) / n
    return np.array([
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / w, kinds[1] + kinds[2], kinds[2], kinds[3], kinds[4],
        kinds[5], kinds[6], kinds[7], kinds[8], np.log1p(len(lines)), len(words) / len(lines), len(set(words)) / w,
        len(set(lines)) / len(lines), sum(len(x) < 4 for x in words) / w, sum(x[0].isupper() for x in words) / w,
        float(text.rstrip()[-1:] in ("", ".", "!", "?"))])


def _best_tree(gradient: np.ndarray, hessian: np.ndarray, ridge: float) -> np.ndarray:
    """Values by bin of the tree with at most three leaves that fits best."""
    def leaf(a: int, b: int) -> tuple[float, float]:
        g, h = gradient[a:b].sum(), hessian[a:b].sum() + ridge
        return g / h, g * g / h

    def cut(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        g, h = np.cumsum(gradient[a:b]), np.cumsum(hessian[a:b])
        gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge) - g[-1] ** 2 / (h[-1] + ridge)
        at = int(np.argmax(gain))
        return float(gain[at]), a + at + 1

    n = len(gradient)
    gain, first = cut(0, n)
    bounds = {0, n}
    if gain > 0:
        bounds.add(first)
        (left, x), (right, y) = cut(0, first), cut(first, n)
        if max(left, right) > 0:
            bounds.add(x if left >= right else y)
    out, edges = np.zeros(n), sorted(bounds)
    for a, b in zip(edges, edges[1:]):
        out[a:b] = leaf(a, b)[0]
    return out


def _best_quadrants(gradient: np.ndarray, hessian: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, values by pair of bins) of the tree that cuts both features once."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)

    def corners(s: np.ndarray) -> list[np.ndarray]:
        low, rows, cols, all_ = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        return [low, rows - low, cols - low, all_ - rows - cols + low]

    parts = list(zip(corners(g), corners(h)))
    gains = sum(a * a / (b + ridge) for a, b in parts)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    values = [float(a[i, j] / (b[i, j] + ridge)) for a, b in parts]
    out = np.empty(gradient.shape)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = values
    return float(gains[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + ridge)), out


@dataclass
class AdditiveModel:
    """Cut points and lookup tables; ``pairs`` holds (feature, feature, table)."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for i, j, t in self.pairs:
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 150, rate: float = 0.1, pairs: int = 6, ridge: float = 5.0) -> AdditiveModel:
    """Boost on logistic loss. With no rows every score is one half; with one label it is near that."""
    p0 = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    model = AdditiveModel(float(np.log(p0 / (1 - p0))), edges, [np.zeros(len(e) + 1) for e in edges])
    if not len(x):
        return model
    b, total = model.bins(x), np.full(len(x), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _best_tree(np.bincount(b[:, k], g, len(t)), np.bincount(b[:, k], h, len(t)), ridge)
            t += step
            total += step[b[:, k]]

    def square(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        shape = len(model.tables[i]), len(model.tables[j])
        if min(shape) < 2:
            return 0.0, np.zeros(shape)
        cell, n = b[:, i] * shape[1] + b[:, j], shape[0] * shape[1]
        return _best_quadrants(np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape), ridge)

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -square(*ij, g, h)[0])
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for i, j in ranked[:pairs]]
    for _ in range(rounds // 3):
        for i, j, t in model.pairs:
            step = rate * square(i, j, *slopes())[1]
            t += step
            total += step[b[:, i], b[:, j]]
    return model


def feature_column(text: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return F.pandas_udf(run, "array<double>")(F.col(text))


def learn(docs: DataFrame, labels: DataFrame, rows: int = 20_000, doc: str = "doc_id", text: str = "text", label: str = "quality") -> AdditiveModel:
    """A model of at most ``rows`` labelled documents, those whose ids have the smallest hashes.

    Labels that are NULL and labels without a document are passed over.
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col(doc).alias("_doc"), F.col(label).cast("double").alias("_label"))
    # A sample of the labels; it is bounded by the parameter, so it may be sent to all tasks.
    sample = known.orderBy(F.xxhash64(F.col("_doc").cast("string")), "_doc", "_label").limit(rows)
    found = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(sample), "_doc")
    got = found.select("_doc", feature_column("_text").alias("x"), "_label").orderBy("_doc", "_label").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    return fit(x, got["_label"].to_numpy(dtype=float))


def scored(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on), which replace any of that name.

    Every text is scored, also NULL, which counts as empty. Equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(shared.value.score(x))

    kept: Sequence[str] = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, run(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
