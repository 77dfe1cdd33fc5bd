"""Mixing to target weights by soft membership.

A classifier that is trained on the labelled table's documents gives every document posteriors over domains. Document
rates r >= floor are then fitted by projected gradient descent on the least squares of (expected domain tokens - target
tokens), where a document of t tokens with posteriors p adds r*t*p. A step needs the vector of domain totals only, one
number for each domain, so an iteration is one narrow aggregation; a document's rate follows from its own posteriors
and the steps so far, so only every twelfth iteration stores the rates.
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

from .common import cut, modest_batches, table

TRAINING_ROWS = 4_000
BUCKETS = 1 << 14  # of the classifier's features
TEMPERATURE = 0.7  # default targets: shares to this power
FLOOR, CEILING = 0.0, float("inf")
STEPS, TOLERANCE = 200, 2e-3  # the tolerance is relative to each domain's target
KEPT = 12  # steps between two tables of rates
WAVES, TASK_ROWS = 2, 1_000_000  # of a step: tasks for each core, unless a task then has more rows
MEMO = 120_000
WORD = re.compile(r"\w+")


class Buckets(dict):
    """word -> bucket, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word) % BUCKETS
        if len(word) <= 64:
            self[word] = out
        return out


def bag(text: str | None, memo: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's words and their weights, of length one together."""
    ids = np.fromiter(map(memo.__getitem__, WORD.findall(text.lower())), np.int64) if text else np.empty(0, np.int64)
    ids, counts = np.unique(ids, return_counts=True)
    weights = np.sqrt(counts)
    return ids, weights / np.sqrt(max((weights**2).sum(), 1.0))


@F.pandas_udf(T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]))
def document_bag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    memo = Buckets()
    for texts in batches:
        bags = [bag(t, memo) for t in texts]
        yield pd.DataFrame({"ids": [b[0] for b in bags], "weights": [b[1] for b in bags]})


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class DomainModel:
    """Softmax regression over hashed words."""

    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.domains, self.weights, self.bias = domains, weights.astype(np.float32), bias

    def posteriors(self, texts: pd.Series, memo: Buckets) -> np.ndarray:
        z = np.tile(self.bias, (len(texts), 1))
        for i, text in enumerate(texts):
            ids, w = bag(text, memo)
            if len(ids):
                z[i] += w @ self.weights[ids]
        return _softmax(z)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], classes: list[str], steps: int = 150) -> DomainModel:
    """Without rows there is one domain named ''."""
    domains = sorted(set(classes)) or [""]
    k, n = len(domains), len(classes)
    weights, bias = np.zeros((BUCKETS, k)), np.zeros(k)
    if n:
        y = np.eye(k)[[domains.index(c) for c in classes]]
        rows = np.repeat(np.arange(n), [len(b[0]) for b in bags])
        ids, values = np.concatenate([b[0] for b in bags]).astype(np.int64), np.concatenate([b[1] for b in bags])
        for _ in range(steps):
            z = np.stack([np.bincount(rows, values * weights[ids, c], n) for c in range(k)], 1) + bias
            error = (_softmax(z) - y) / n
            bias -= 2.0 * error.sum(0)
            for c in range(k):
                weights[:, c] -= 20.0 * np.bincount(ids, values * error[rows, c], BUCKETS) + 1e-4 * weights[:, c]
    return DomainModel(domains, weights, bias)


def trained(docs: DataFrame, labels: DataFrame, domain_col: str = "lang", rows: int = TRAINING_ROWS) -> DomainModel:
    """Fitted on a bounded sample of the documents in the labelled table. A null domain counts as ''."""
    modest_batches(docs.sparkSession)
    ids = labels.select(F.col("doc_id").cast("long").alias("__id")).where("__id IS NOT NULL").distinct()
    total = ids.count()
    if total > rows:
        ids = ids.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * rows / total))
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").alias("__text"), F.coalesce(F.col(domain_col), F.lit("")).alias("__domain"))
    # the ids are bounded by `rows`, so they are broadcast
    one = texts.join(F.broadcast(ids), F.col("__doc") == F.col("__id")).groupBy("__id").agg(F.min(F.struct("__domain", "__text")).alias("d"))  # repeated ids come once
    got = one.select(document_bag("d.__text").alias("b"), "d.__domain").select("b.ids", "b.weights", "__domain").toPandas()
    bags = [(np.asarray(i, np.int64), np.asarray(w)) for i, w in zip(got["ids"], got["weights"], strict=True)]
    return fit(bags, got["__domain"].tolist())


def memberships(text: Column, model: DomainModel) -> Column:
    """struct(tokens, posteriors)."""

    @F.pandas_udf("tokens long, posteriors array<double>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = Buckets()
        for texts in batches:
            p = np.round(model.posteriors(texts, memo), 9)
            yield pd.DataFrame({"tokens": [len(t.split()) if t else 0 for t in texts], "posteriors": list(p)})

    return judged(text)


def _rate(p: list[Column], steps: list[np.ndarray], floor: float, ceiling: float, start: Column | None = None) -> Column:
    """The rate after the steps so far: each moves it against the gradient and projects it onto [floor, ceiling]. With
    start, the rate that those steps begin from."""
    moves = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps]) if steps else F.array().cast("array<array<double>>")

    def step(r: Column, move: Column) -> Column:
        down = sum((p[d] * move[d] for d in range(len(p))), F.lit(0.0))
        return F.least(F.greatest(r - down, F.lit(floor)), F.lit(ceiling))

    return F.aggregate(moves, F.lit(min(max(1.0, floor), ceiling)) if start is None else start, step)


class Mixture:
    """A fitted mixture: rates of rows follow from their posteriors."""

    def __init__(self, domains: list[str], targets: np.ndarray, reached: np.ndarray, steps: list[np.ndarray], floor: float, ceiling: float) -> None:
        self.domains, self.targets, self.reached, self.steps, self.floor, self.ceiling = domains, targets, reached, steps, floor, ceiling

    def totals(self) -> list[tuple[str, float, float]]:
        """(domain, target tokens, expected tokens): a domain that differs was missed."""
        return [(d, float(t), float(r)) for d, t, r in zip(self.domains, self.targets, self.reached, strict=True)]

    def rate(self, posteriors: Column) -> Column:
        return _rate([posteriors[d] for d in range(len(self.domains))], self.steps, self.floor, self.ceiling)


def fitted(members: DataFrame, domains: list[str], weights: dict[str, float] | None = None, floor: float = FLOOR, ceiling: float = CEILING, steps: int = STEPS) -> Mixture:
    """members: (tokens, posteriors) rows. `weights` are the targets' shares of the tokens; by default, the domains'
    own shares to the power TEMPERATURE. The total is that of the documents; if the floor alone puts a domain above its
    target, it is raised until no domain has too much.

    In the metric that weights a rate by its document's tokens, the step of a document with posteriors p is
    p . (weighted residual), the same for any number of tokens.

    The rows are as few bytes each as the texts were many, so the steps run over them in fewer partitions than the texts
    came in, put together without a shuffle."""
    k = len(domains)
    p = [F.col("posteriors")[d] for d in range(k)]
    t = F.col("tokens")
    first = members.agg(F.count("*").alias("n"), *[F.sum(t * p[d]).alias(f"m{d}") for d in range(k)], *[F.sum(t * p[d] * p[e]).alias(f"g{d}_{e}") for d in range(k) for e in range(d, k)]).first()
    mass = np.array([first[f"m{d}"] or 0.0 for d in range(k)])
    total = mass.sum()
    if weights is None:
        shares = np.where(mass > 0, (mass / max(total, 1.0)) ** TEMPERATURE, 0.0)
    else:
        shares = np.array([weights.get(d, 0.0) for d in domains])
    if total == 0 or shares.sum() == 0:
        return Mixture(domains, np.zeros(k), mass, [], floor, ceiling)
    shares = shares / shares.sum()
    some = shares > 0
    targets = shares * max(total, float((floor * mass[some] / shares[some]).max()))
    gram = np.zeros((k, k))
    for d in range(k):
        for e in range(d, k):
            gram[d, e] = gram[e, d] = first[f"g{d}_{e}"] or 0.0
    # With residuals weighted by the inverse of gram, and rates by their documents' tokens, the gradient's Lipschitz
    # constant is one, so every step of length one goes down.
    weigh = np.linalg.inv(gram + 1e-9 * gram.trace() * np.eye(k))
    history: list[np.ndarray] = []
    reached, loss = mass * min(max(1.0, floor), ceiling), np.inf
    parts = max(WAVES * members.sparkSession.sparkContext.defaultParallelism, -(-first["n"] // TASK_ROWS))
    rated, since = cut(members.coalesce(parts).select("tokens", "posteriors", F.lit(min(max(1.0, floor), ceiling)).alias("r"))), 0
    for _ in range(steps + 1):
        residual = reached - targets
        before, loss = loss, float(residual @ weigh @ residual)
        if (np.abs(residual) <= TOLERANCE * np.maximum(targets, 1.0)).all() or loss > before * (1 - 1e-4) or len(history) == steps:
            break
        history.append(weigh @ residual)
        if len(history) - since > KEPT:  # rates so far are stored, so that a step applies KEPT moves at most
            rated = cut(rated.withColumn("r", _rate(p, history[since:-1], floor, ceiling, F.col("r"))))
            since = len(history) - 1
        row = rated.withColumn("r", _rate(p, history[since:], floor, ceiling, F.col("r"))).agg(*[F.sum(F.col("r") * t * p[d]).alias(f"m{d}") for d in range(k)]).first()
        reached = np.array([row[f"m{d}"] or 0.0 for d in range(k)])
    return Mixture(domains, targets, reached, history, floor, ceiling)


def copies_of(rate: Column, *key: str) -> Column:
    """A whole number with the rate as its mean: the fraction is drawn by a hash of the key."""
    draw = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def rates(docs: DataFrame, model: DomainModel, weights: dict[str, float] | None = None, floor: float = FLOOR, ceiling: float = CEILING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens, domain (the likeliest), posterior (its probability), rate, copies for every row.

    Null and empty texts have no tokens, and posteriors from the classifier's bias. Each row has its own result,
    repeated ones too (the same one); ids may be null. No rows give no rows. Other columns are ignored."""
    members = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), memberships(F.col(text_col), model).alias("m")).select("doc_id", "m.tokens", "m.posteriors"))
    mixture = fitted(members, model.domains, weights, floor, ceiling)
    best = F.array_max(F.transform("posteriors", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    out = members.withColumn("rate", mixture.rate(F.col("posteriors"))).withColumn("best", best)
    names = F.array(*map(F.lit, model.domains))
    return out.select("doc_id", "tokens", F.get(names, -F.col("best.i")).alias("domain"), F.col("best.p").alias("posterior"), "rate", copies_of(F.col("rate"), "doc_id").alias("copies"))


def mixed(docs: DataFrame, model: DomainModel, weights: dict[str, float] | None = None, floor: float = FLOOR, ceiling: float = CEILING, id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None) -> DataFrame:
    """Each row of docs as often as its rate says, with all its columns, whatever their names; `copy_col`, if given, is
    added and numbers a row's copies from 1.

    The fraction of a rate is drawn by a hash of the id, so repeated rows are drawn alike; null ids are one id. Null and
    empty texts have posteriors from the classifier's bias. No rows give no rows. Texts are classified once: rows and
    posteriors are cut together, and the posteriors once more by themselves."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = cut(docs.select(row, F.col(f"`{id_col}`").alias("id"), memberships(F.col(f"`{text_col}`"), model).alias("m")).select("row", "id", "m.tokens", "m.posteriors"))
    members = cut(judged.select("tokens", "posteriors"))  # narrow, as every step of the fit reads it
    mixture = fitted(members, model.domains, weights, floor, ceiling)
    out = judged.select("row", copies_of(mixture.rate(F.col("posteriors")), "id").alias("copies")).where("copies > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select("row.*", *([F.col("copy").alias(copy_col)] if copy_col else []))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rates(docs, trained(docs, labels))
