"""Toxicity by cumulative-link ordinal regression.

Severity has the grades 0 (not toxic) to 3. P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all ordered
thresholds t_1 < t_2 < t_3; x says which sparse text features a document has: its words, and the beginnings of its
words (inflected and compound forms share them). Grades of labelled toxic documents come from how much toxic
vocabulary they hold, in thirds; the vocabulary is what the labels themselves set apart. The output is the expected
severity, and a document is rejected where P(grade >= 1) is at least one half.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, in_fold, labelled_sample, modest_batches, table

TRAINING_ROWS = 8_000
PREFIXES = (4, 5)
GRADES = 3
EVIDENCE, LEAST_DOCS, MOST_FEATURES = 25.0, 4, 20_000  # chi-square of a feature, its documents, the model's size
MEMO = 120_000
WORD = re.compile(r"\w+")


def features_of(word: str) -> list[int]:
    """Signed 64-bit hashes of a word's features."""
    names = [word, *(f"{word[:k]}^{k}" for k in PREFIXES if len(word) >= k)]
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in names]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@F.pandas_udf(T.ArrayType(T.LongType()))
def document_features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([np.unique([f for w in words_of(t) for f in features_of(w)] or [0]) for t in texts])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class OrdinalModel:
    def __init__(self, names: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights = dict(zip(names.tolist(), weights.tolist(), strict=True))
        self.thresholds = thresholds

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds[None, :])


def fit(documents: list[np.ndarray], toxic: np.ndarray, l2: float = 1e-3, steps: int = 1500) -> OrdinalModel:
    """documents: each one's features. Without toxic or without other documents, the model rejects nothing."""
    toxic = np.asarray(toxic, bool)
    n, n1 = len(toxic), int(toxic.sum())
    if not n1 or n1 == n:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), np.arange(1.0, GRADES + 1) + 4)
    rows = np.repeat(np.arange(n), [len(d) for d in documents])
    names, cols = np.unique(np.concatenate(documents).astype(np.int64), return_inverse=True)
    v = len(names)
    a, b = np.bincount(cols, toxic[rows], v), np.bincount(cols, ~toxic[rows], v)
    marks = a / n1 > 10 * (b + 0.5) / (n - n1)
    held = np.bincount(rows, marks[cols].astype(float), n)
    cuts = np.quantile(held[toxic], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(toxic, 1 + (held[:, None] > cuts[None, :]).sum(1), 0)
    reached = grade[:, None] >= np.arange(1, GRADES + 1)[None, :]
    # Adam over the weights, the first threshold and the logs of the gaps between thresholds
    theta = np.zeros(v + GRADES)
    theta[v] = 2.0
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, gaps = theta[:v], np.exp(theta[v + 1 :])
        t = theta[v] + np.concatenate([[0.0], np.cumsum(gaps)])
        error = _sigmoid(np.bincount(rows, w[cols], n)[:, None] - t[None, :]) - reached
        by_row, by_t = error.sum(1) / n, -error.sum(0) / n
        grad = np.concatenate([np.bincount(cols, by_row[rows], v) + l2 * w / np.sqrt(n), [by_t.sum()], np.cumsum(by_t[::-1])[::-1][1:] * gaps])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    w, t = theta[:v], theta[v] + np.concatenate([[0.0], np.cumsum(np.exp(theta[v + 1 :]))])
    return OrdinalModel(names, w, t)


class WordMemo(dict):
    """word -> its features that the model weighs."""

    def __init__(self, model: OrdinalModel) -> None:
        super().__init__()
        self.weights = model.weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        out = tuple(f for f in features_of(word) if f in self.weights)
        if len(word) <= 64:
            self[word] = out
        return out


def telling_features(sample: DataFrame) -> DataFrame:
    """Of (f, toxic) rows, the features whose chi-square with the label is high; MOST_FEATURES at most, which bounds
    the model and what the driver gets."""
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    each = sample.select(F.explode("f").alias("feature"), "toxic").groupBy("feature").agg(F.count("*").cast("double").alias("k"), F.sum("toxic").cast("double").alias("a"))
    each = each.where(F.col("k") >= LEAST_DOCS)
    b, c = F.col("k") - F.col("a"), F.lit(float(n1)) - F.col("a")
    d = F.lit(float(n - n1)) - b
    chi = F.lit(float(n)) * F.pow(F.col("a") * d - b * c, 2) / F.greatest(F.col("k") * (c + d) * F.lit(float(n1)) * F.lit(float(n - n1)), F.lit(1.0))
    return each.withColumn("chi", chi).where(F.col("chi") >= EVIDENCE).orderBy(F.desc("chi"), "feature").limit(MOST_FEATURES).select("feature")


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> OrdinalModel:
    """Fitted on a bounded sample of the labelled documents outside the held-out quarter."""
    modest_batches(docs.sparkSession)
    sample = cut(labelled_sample(docs, labels, "toxic", rows, ~in_fold("__id")).select(document_features("text").alias("f"), "toxic"))
    chosen = np.sort(telling_features(sample).toPandas()["feature"].to_numpy(np.int64))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for features in batches:
            yield pd.Series([np.intersect1d(f, chosen, assume_unique=True) for f in features])

    got = sample.select(held("f").alias("f"), "toxic").toPandas()
    return fit([np.asarray(f, np.int64) for f in got["f"]], got["toxic"].to_numpy())


def graded(text: Column, model: OrdinalModel) -> Column:
    """struct(severity, p_toxic, grade) of a text."""

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo, weights = WordMemo(model), model.weights
        for texts in batches:
            score = np.zeros(len(texts))
            for i, text in enumerate(texts):
                found = {f for fs in map(memo.__getitem__, words_of(text)) for f in fs}
                score[i] = sum(weights[f] for f in sorted(found))
            p = model.at_least(score)
            yield pd.DataFrame({"severity": p.sum(1), "p_toxic": p[:, 0], "grade": (p >= 0.5).sum(1).astype("int32")})

    return scored(text)


def toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (0 to 3), p_toxic, grade, toxic for every row.

    Null and empty texts have no features and get the severity that the thresholds alone give. Each row has its own
    result, repeated ones too; ids may be null. No rows give no rows. Other columns are ignored."""
    modest_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), graded(F.col(text_col), model).alias("g"))
    return out.select("doc_id", "g.severity", "g.p_toxic", "g.grade", (F.col("g.grade") >= 1).alias("toxic"))


def without_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns, whatever their names.

    Null and empty texts are judged by the thresholds alone; repeated rows are judged alike, and no rows give no
    rows."""
    modest_batches(docs.sparkSession)
    return docs.where(graded(F.col(f"`{text_col}`"), model)["grade"] == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity(docs, trained(docs, labels))
