"""Boosted trees on Spark ML: two-stage search by held-out blocks, age weights, month bootstrap, principal features.

Spark ML has no L2 penalty of leaf values, so a candidate's `reg_lambda` sets the least weight of a leaf instead."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_number
from . import linalg
from .folds import bootstrap_months
from .joins import joined_one_to_one
from .moments import covariance

# The twenty designs of the search as (share of columns in a tree, depth, L2 penalty, share of rows).
DESIGNS = [
    (0.960199004975124, 1, 6.79290624977431, 0.792944552004337),
    (0.119402985074627, 6, 4.36883814483563, 0.839221168868244),
    (0.0124378109452736, 1, 8.95821662650399, 0.281950866617262),
    (0.082089552238806, 6, 33.7013757815395, 0.23539318125695),
    (0.880597014925373, 6, 0.175136472721016, 0.606159858591855),
    (0.308457711442786, 7, 0.0104059298394788, 0.282029826566577),
    (0.487562189054726, 7, 2.69786783063962, 0.273632002435625),
    (0.915422885572139, 3, 0.0161590590154502, 0.536597859859467),
    (0.283582089552239, 2, 4.71612234358155, 0.803678817115724),
    (0.0621890547263682, 7, 0.543820024894272, 0.350324857234955),
    (0.181592039800995, 2, 0.631114491480233, 0.400126792304218),
    (0.380597014925373, 4, 6.07586861650063, 0.422225289791822),
    (0.721393034825871, 4, 0.191837168860237, 0.21493322532624),
    (0.932835820895522, 3, 2.51031514919226, 0.22102674394846),
    (0.977611940298508, 6, 4.12665637626617, 0.988919165730476),
    (0.644278606965174, 3, 97.3280110678184, 0.824435774795711),
    (0.659203980099503, 6, 47.6447723610298, 0.670239540748298),
    (0.885572139303483, 1, 0.168539364780137, 0.302476367726922),
    (0.654228855721393, 5, 88.6329188111331, 0.277405075542629),
    (0.90547263681592, 4, 5.96527272203017, 0.58861793782562),
]
CANDIDATES = [{"maxDepth": depth, "subsamplingRate": rows, "featureSubsetStrategy": str(columns), "minInstancesPerNode": max(1, round(penalty))} for columns, depth, penalty, rows in DESIGNS]
COARSE, FINE = (1_000, 0.15), (10_000, 0.01)  # rounds at most, learning rate

Basis = Callable[[DataFrame, DataFrame], DataFrame]


def assembled(panel: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(panel.fillna(0.0, features))


def age_weights(panel: DataFrame, cutoff_month: int, half: float) -> DataFrame:
    """Rows weigh 1 / (1 + age / half) of their month, with mean 1."""
    w = F.pow(1 + (F.lit(cutoff_month) - month_number(F.col("eom"))) / F.lit(float(half)), F.lit(-1.0))
    mean = panel.agg(F.avg(w)).first()[0] or 1.0
    return panel.withColumn("weight", w / mean)


def _model(params: dict, rounds: int, rate: float, held: str | None, weight: str | None, seed: int) -> GBTRegressor:
    gbt = GBTRegressor(featuresCol="features", labelCol="label", predictionCol="pred", maxIter=rounds, stepSize=rate, seed=seed, validationTol=1e-6, **params)
    if held:
        gbt = gbt.setValidationIndicatorCol(held)
    return gbt.setWeightCol(weight) if weight else gbt


def two_stage(train: DataFrame, fold: str, candidates: list[dict] | None = None, coarse: tuple[int, float] = COARSE, fine: tuple[int, float] = FINE, weight: str | None = None, seed: int = 1, basis: Basis | None = None) -> tuple[GBTRegressionModel, dict]:
    """The candidate with the least mean held-out error at the coarse rate is refitted at the fine one, with as many
    trees as early stopping kept on average. `train` has features, label and the fold; or a basis(fitted_on, rows) gives
    rows their features, and then every fold's basis is fitted without the fold."""
    train, candidates = train.persist(), candidates or CANDIDATES
    ks = [r[0] for r in train.select(fold).distinct().orderBy(fold).collect()]
    sets = []
    for k in ks:
        marked = train.withColumn("__held", F.col(fold) == k)
        sets.append((basis(marked.where("NOT __held"), marked) if basis else marked).persist())

    def held_out(params: dict, rounds: int, rate: float) -> tuple[float, float]:
        errors, sizes = [], []
        for marked in sets:
            model = _model(params, rounds, rate, "__held", weight, seed).fit(marked)
            errors.append(model.transform(marked.where("__held")).agg(F.avg(F.pow(F.col("label") - F.col("pred"), 2))).first()[0])
            sizes.append(model.getNumTrees)
        return float(np.mean(errors)), float(np.mean(sizes))

    try:
        scores = [held_out(p, *coarse)[0] for p in candidates]
        best = candidates[int(np.argmin(scores))]
        trees = max(1, int(held_out(best, *fine)[1]))
        whole = basis(train, train) if basis else train
        return _model(best, trees, fine[1], None, weight, seed).fit(whole), {"params": best, "trees": trees, "scores": scores}
    finally:
        for df in (*sets, train):
            df.unpersist()


def bagged(train: DataFrame, panel: DataFrame, params: dict, trees: int, rate: float, anchor: int, bags: int = 5, seed: int = 1) -> DataFrame:
    """Mean forecast of models fitted on circular month-block bootstraps drawn for the anchor, a month number; a month
    drawn twice counts twice. Settings come from the fit that the bags vary."""
    months = [r[0] for r in train.select("eom").distinct().orderBy("eom").collect()]
    out = panel
    for bag in range(bags):
        drawn = train.sparkSession.createDataFrame([(m,) for m in bootstrap_months(months, anchor, bag, seed=seed)], "eom date")
        model = _model(params, trees, rate, None, None, seed + bag).fit(train.join(F.broadcast(drawn), "eom"))
        out = model.transform(out).withColumnRenamed("pred", f"pred_{bag}")
    mean = sum((F.col(f"pred_{b}") for b in range(1, bags)), F.col("pred_0")) / bags
    return out.select("id", "eom", "excntry", mean.alias("pred"))


def principal_features(train: DataFrame, panel: DataFrame, features: list[str], share: float) -> tuple[DataFrame, list[str]]:
    """Scores on the training rows' leading principal axes, unscaled: K x K products leave the cluster, no rows."""
    vector = F.array(*[F.coalesce(F.col(f), F.lit(0.0)) for f in features])
    rows = covariance(train.select(F.lit(0).alias("g"), vector.alias("f"))).toPandas()
    axes = linalg.principal(linalg.statistics_matrix(rows["i"].to_numpy(), rows["j"].to_numpy(), rows["v"].to_numpy()), share)
    names = [f"pc{k}" for k in range(axes.shape[1])]
    scores = [sum((F.coalesce(F.col(f), F.lit(0.0)) * float(a) for f, a in zip(features, axes[:, k], strict=True)), F.lit(0.0)).alias(names[k]) for k in range(len(names))]
    return panel.select(*[c for c in panel.columns if c not in features], *scores), names


def principal_basis(features: list[str], share: float) -> Basis:
    """A basis for two_stage."""

    def basis(fitted_on: DataFrame, rows: DataFrame) -> DataFrame:
        return assembled(*principal_features(fitted_on, rows, features, share))

    return basis


def blended(*preds: DataFrame) -> DataFrame:
    """Equal parts of forecasts with the same, unique keys."""
    keys, out = ["id", "eom", "excntry"], None
    for k, p in enumerate(preds):
        p = p.select(*keys, F.col("pred").alias(f"__p{k}"))
        out = p if out is None else joined_one_to_one(out, p, keys)
    return out.select(*keys, (sum((F.col(f"__p{k}") for k in range(1, len(preds))), F.col("__p0")) / len(preds)).alias("pred"))
