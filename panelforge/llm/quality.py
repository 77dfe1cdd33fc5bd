"""Quality by a generalised additive model with pairwise interactions.

Cyclic boosting gives each text feature a lookup table over its bins: round by round, every feature in turn gets a
shallow tree fitted to the current residuals and a small step along it. Then the pairs of features whose joint bins
explain most of what is left get tables of their own in the same way. A score is the sum of looked-up values, added
for whole batches at a time.
"""

from __future__ import annotations

import operator
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_fold, labelled_sample, modest_batches, table

TRAINING_ROWS = 8_000
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 150, 0.15, 6, 8, 50
LEAST_ROWS = 20  # in a leaf
THRESHOLD = 0.7
_UPPER, _DIGITS, _SIGNS, _SPACE = (s.encode() for s in (string.ascii_uppercase, string.digits, "#$%&*|<>{}[]\\^~=_@+", string.whitespace))
_MARKS = b"!?"
FEATURES = ["log_words", "mean_word", "upper", "digits", "signs", "marks", "repeats", "distinct", "top_word", "lone_signs", "same_lines", "words_a_line", "short_words", "stops"]


def features_of(text: str | None) -> list[float]:
    """What a text looks like, as numbers; an empty text has zeros."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    size = len(raw)
    letters = max(1, size - (size - len(raw.translate(None, _SPACE))))
    share = lambda what: (size - len(raw.translate(None, what))) / letters
    counts = Counter(words)
    lines = text.split("\n")
    lengths = Counter(map(len, words))
    return [
        float(np.log1p(n)),
        letters / n,
        share(_UPPER),
        share(_DIGITS),
        share(_SIGNS),
        share(_MARKS),
        sum(map(operator.eq, words, words[1:])) / n,
        len(counts) / n**0.8,
        max(counts.values()) / n,
        sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(c for k, c in lengths.items() if k <= 3) / n,
        (raw.count(b". ") + raw.count(b".\n") + 1) / n,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def document_features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features_of(t) for t in texts])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _shallow(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of the best tree of splits by order over bins with sums of gradients, curvatures and rows."""
    whole = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return whole
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = np.where((nl >= LEAST_ROWS) & (nr >= LEAST_ROWS), gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0), -np.inf)
    k = int(np.argmax(gain))
    if not np.isfinite(gain[k]) or gain[k] <= g.sum() ** 2 / (h.sum() + 1.0):
        return whole
    return np.concatenate([_shallow(g[: k + 1], h[: k + 1], n[: k + 1], depth - 1), _shallow(g[k + 1 :], h[k + 1 :], n[k + 1 :], depth - 1)])


def _cross(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best tree with one split on each axis of a grid, and its gain."""
    best, out = 0.0, np.zeros_like(g)
    cs = lambda x: np.cumsum(np.cumsum(x, 0), 1)
    G, H, N = cs(g), cs(h), cs(n)

    def quarters(x: np.ndarray) -> list[np.ndarray]:
        ll = x[:-1, :-1]
        lr, rl = x[:-1, -1:] - ll, x[-1:, :-1] - ll
        return [ll, lr, rl, x[-1, -1] - ll - lr - rl]

    gq, hq, nq = quarters(G), quarters(H), quarters(N)
    gain = sum(np.where(b >= LEAST_ROWS, a**2 / (c + 1.0), 0.0) for a, c, b in zip(gq, hq, nq, strict=True)) - g.sum() ** 2 / (h.sum() + 1.0)
    if gain.size and gain.max() > best:
        best = float(gain.max())
        i, j = np.unravel_index(np.argmax(gain), gain.shape)
        v = [a[i, j] / (c[i, j] + 1.0) if b[i, j] >= LEAST_ROWS else 0.0 for a, c, b in zip(gq, hq, nq, strict=True)]
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, best


class AdditiveModel:
    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pair_edges: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]) -> None:
        self.base, self.edges, self.tables, self.pair_edges, self.pairs = base, edges, tables, pair_edges, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), values in self.pairs.items():
            total += values[np.searchsorted(self.pair_edges[f], x[:, f], side="right"), np.searchsorted(self.pair_edges[g], x[:, g], side="right")]
        return _sigmoid(total)


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Without rows the score is one half; with one class it is near that class."""
    n, width = len(y), len(FEATURES)
    if not n:
        return AdditiveModel(0.0, [np.empty(0)] * width, [np.zeros(1)] * width, [np.empty(0)] * width, {})
    rate = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate / (1 - rate)))
    edges = [_edges(x[:, f], BINS) for f in range(width)]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    sizes = [len(e) + 1 for e in edges]
    rows_in = [np.bincount(b, minlength=s) for b, s in zip(bins, sizes, strict=True)]
    tables, total = [np.zeros(s) for s in sizes], np.full(n, base)
    for _ in range(ROUNDS):
        for f in range(width):
            p = _sigmoid(total)
            step = RATE * _shallow(np.bincount(bins[f], y - p, sizes[f]), np.bincount(bins[f], p * (1 - p), sizes[f]), rows_in[f])
            tables[f] += step
            total += step[bins[f]]
    pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]
    counts = [len(e) + 1 for e in pair_edges]

    def grids(f: int, g: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell, shape = coarse[f] * counts[g] + coarse[g], (counts[f], counts[g])
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p), np.ones(n)))

    p = _sigmoid(total)
    gains = sorted(((_cross(*grids(f, g, p))[1], -f, -g) for f in range(width) for g in range(f + 1, width)), reverse=True)
    pairs = {(-f, -g): np.zeros((counts[-f], counts[-g])) for gain, f, g in gains[:PAIRS] if gain > 0}
    for _ in range(PAIR_ROUNDS):
        for (f, g), values in pairs.items():
            step = RATE * _cross(*grids(f, g, _sigmoid(total)))[0]
            values += step
            total += step[coarse[f], coarse[g]]
    return AdditiveModel(base, edges, tables, pair_edges, pairs)


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> AdditiveModel:
    """Fitted on a bounded sample of the labelled documents outside the held-out quarter."""
    modest_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", rows, ~in_fold("__id"))
    got = sample.select(document_features("text").alias("f"), "quality").toPandas()
    x = np.array(got["f"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["quality"].to_numpy(float))


def quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts are scored by features that are all 0. Each row has its own result, repeated ones too; a null
    id isn't held out. No rows give no rows. Other columns are ignored."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features_of(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), scored(F.col(text_col)).alias("score"))
    return rows.select("doc_id", F.coalesce(in_fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality(docs, trained(docs, labels))
