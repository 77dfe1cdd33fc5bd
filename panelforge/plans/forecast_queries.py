"""Queries of the forecast operators: one feature, for which SQL has closed forms, and whole ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, linalg, moments, ranks, ridge, risk, trees
from ..sources import demo
from ..sources.demo import CELLS_SQL, FEATURES, MONTHLY_SQL
from .queries import _SCORED, forecast_years, query, r, rk1, scored, vectors

_FIT = "(sxy - sx * sy / n) / (sxx - sx * sx / n + n * {q})"
_GRID = "q AS (SELECT unnest([1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0]) AS q)"
_SUMS = "count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy"
_ROWS = f"{MONTHLY_SQL}, p AS (SELECT id, eom, eom_ret, excntry, disc * 10 AS x, label AS y FROM panel), u AS (SELECT * FROM p WHERE y IS NOT NULL)"


def one_feature(spark: SparkSession, sf: str) -> DataFrame:
    return demo.monthly(spark, sf).select("id", "eom", "eom_ret", "excntry", "label", (F.col("disc") * 10).alias("x"))


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("fc3_ridge", f"WITH {_ROWS}, s AS (SELECT excntry, {_SUMS} FROM u GROUP BY excntry) SELECT excntry, round(sy / n - {_FIT.format(q=0.01)} * sx / n, 9) AS intercept, round({_FIT.format(q=0.01)}, 9) AS coef FROM s")
def fc3(spark: SparkSession, sf: str) -> DataFrame:
    of = ridge.matrices(moments.sufficient_statistics(one_feature(spark, sf), ["x"], "label", ["excntry"]), "excntry")
    out = _frame(spark, [(k, *map(float, linalg.ridge(m, 0.01))) for k, m in of.items()], "excntry string, intercept double, coef double")
    return out.select("excntry", r("intercept", 9).alias("intercept"), r("coef", 9).alias("coef"))


_BY_FOLD = f"""{_ROWS}, f AS (SELECT CAST(id % 5 AS INTEGER) AS fold, {_SUMS} FROM u GROUP BY 1), {_GRID},
t AS (SELECT a.fold, sum(b.n) AS n, sum(b.sx) AS sx, sum(b.sy) AS sy, sum(b.sxx) AS sxx, sum(b.sxy) AS sxy FROM f a JOIN f b ON a.fold <> b.fold GROUP BY a.fold),
c AS (SELECT fold, q, {_FIT.format(q='q')} AS c, sy / n - {_FIT.format(q='q')} * sx / n AS a FROM t, q)"""


@query("fc4_validation_error", f"WITH {_BY_FOLD} SELECT fold, q AS penalty, round(avg(power(u.y - c.a - c.c * u.x, 2)), 9) AS mse FROM u JOIN c ON c.fold = u.id % 5 WHERE q = 0.01 GROUP BY ALL")
def fc4(spark: SparkSession, sf: str) -> DataFrame:
    p = one_feature(spark, sf).withColumn("fold", folds.security_fold(F.col("id")))
    of = ridge.matrices(moments.sufficient_statistics(p, ["x"], "label", ["fold"]), "fold")
    total = sum(of.values())
    rows = [(int(k), 0.01, round(float(linalg.mean_squared_error(m, linalg.ridge(total - m, 0.01))), 9)) for k, m in of.items()]
    return _frame(spark, rows, "fold int, penalty double, mse double")


@query("fc6_penalty_path", f"WITH {_BY_FOLD} SELECT fold, q AS penalty, round(avg(power(u.y - c.a - c.c * u.x, 2)), 9) AS mse FROM u JOIN c ON c.fold = u.id % 5 GROUP BY ALL")
def fc6(spark: SparkSession, sf: str) -> DataFrame:
    p = one_feature(spark, sf).withColumn("fold", folds.security_fold(F.col("id")))
    of = ridge.matrices(moments.sufficient_statistics(p, ["x"], "label", ["fold"]), "fold")
    total, grid = sum(of.values()), np.array(ridge.PENALTIES)
    rows = [(int(k), float(q), round(float(e), 9)) for k, m in of.items() for q, e in zip(grid, linalg.ridge_path(total - m, m, grid), strict=True)]
    return _frame(spark, rows, "fold int, penalty double, mse double")


@query(
    "fc5_one_feature",
    f"""WITH {_ROWS}, yr AS (SELECT DISTINCT year(eom) + CASE WHEN month(eom) = 12 THEN 1 ELSE 0 END AS year FROM p), mo AS (SELECT eom_ret, {_SUMS} FROM u GROUP BY eom_ret),
k AS (SELECT year, mo.*, row_number() OVER (PARTITION BY year ORDER BY eom_ret DESC) AS age FROM yr JOIN mo ON year(eom_ret) < year),
b AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY eom_ret) - 1 AS pos, count(*) OVER (PARTITION BY year) AS months FROM k WHERE age <= 120),
f AS (SELECT year, least(least(5, months) - 1, pos * least(5, months) // greatest(1, months - 1)) AS fold, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM b GROUP BY ALL), {_GRID},
t AS (SELECT a.year, a.fold, sum(b.n) AS n, sum(b.sx) AS sx, sum(b.sy) AS sy, sum(b.sxx) AS sxx, sum(b.sxy) AS sxy FROM f a JOIN f b ON a.year = b.year AND a.fold <> b.fold GROUP BY ALL),
c AS (SELECT year, fold, q, {_FIT.format(q='q')} AS c, sy / n - {_FIT.format(q='q')} * sx / n AS a FROM t, q),
e AS (SELECT year, q, avg((f.syy - 2 * a * f.sy - 2 * c * f.sxy + a * a * f.n + 2 * a * c * f.sx + c * c * f.sxx) / f.n) AS mse FROM c JOIN f USING (year, fold) GROUP BY ALL),
w AS (SELECT year, arg_min(q, (mse, q)) AS q FROM e GROUP BY year), s AS (SELECT year, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM f GROUP BY year),
z AS (SELECT s.year, {_FIT.format(q='coalesce(q, 1e-4)')} AS c, sy / n - {_FIT.format(q='coalesce(q, 1e-4)')} * sx / n AS a FROM s LEFT JOIN w USING (year))
SELECT id, eom, excntry, round(a + c * x, 7) AS pred FROM p JOIN z ON z.year = year(eom) + CASE WHEN month(eom) = 12 THEN 1 ELSE 0 END""",
)
def fc5_one(spark: SparkSession, sf: str) -> DataFrame:
    p = one_feature(spark, sf).persist()
    return ridge.walk_forward(p, ["x"], forecast_years(p)).withColumn("pred", r("pred", 7))


@query("fc7_dense_ridge")
def fc7(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["id", "eom", "eom_ret", "excntry", "label"]
    p = ranks.ranked_panel(demo.monthly(spark, sf).select(*keys, *FEATURES), FEATURES).persist()
    return ridge.walk_forward(p, FEATURES, forecast_years(p), dense=True)


_FORWARD = f"""{_ROWS}, m AS (SELECT DISTINCT eom, eom_ret FROM u), o AS (SELECT *, row_number() OVER (ORDER BY eom) - 1 AS pos FROM m), v AS (SELECT eom, ntile(5) OVER (ORDER BY eom) - 1 AS fold FROM o WHERE pos >= 24), st AS (SELECT fold, min(eom) AS start FROM v GROUP BY fold),
t AS (SELECT fold, {_SUMS} FROM u JOIN st ON u.eom < start AND u.eom_ret <= start GROUP BY fold), {_GRID}, c AS (SELECT fold, q, {_FIT.format(q='q')} AS c, sy / n - {_FIT.format(q='q')} * sx / n AS a FROM t, q)"""


@query("fc8_forward_errors", f"WITH {_FORWARD} SELECT q AS penalty, round(avg(mse), 9) AS mse FROM (SELECT v.fold, q, avg(power(u.y - a - c * u.x, 2)) AS mse FROM u JOIN v USING (eom) JOIN c ON c.fold = v.fold GROUP BY ALL) GROUP BY q")
def fc8(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out errors of each penalty where every fold is fitted on the months before it only."""
    p = one_feature(spark, sf).where("label IS NOT NULL").persist()
    pairs = folds.forward_pairs(p.select("eom", "eom_ret").distinct())
    by_month = ridge.matrices(moments.sufficient_statistics(p.withColumn("m", F.col("eom").cast("string")), ["x"], "label", ["m"]), "m")
    of: dict = {}
    for row in pairs.collect():  # a row a month and fold
        key = (row["fold"], row["role"])
        of[key] = of.get(key, 0) + by_month[str(row["eom"])]
    grid = np.array(ridge.PENALTIES)
    errors = np.mean([linalg.ridge_path(of[k, "train"], of[k, "validate"], grid) for k in sorted({k for k, _ in of})], 0)
    return _frame(spark, [(float(q), round(float(e), 9)) for q, e in zip(grid, errors, strict=True)], "penalty double, mse double")


@query("fc15_factor_means", "WITH u AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, i, 21 * avg(x) OVER (PARTITION BY i ORDER BY vec_id ROWS BETWEEN 2519 PRECEDING AND CURRENT ROW) AS v FROM u) SELECT vec_id, CAST(i AS INTEGER) AS i, round(v, 8) AS v FROM m WHERE vec_id % 250 = 249")
def fc15(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf).select(F.col("vec_id").alias("date"), "f")
    out = ridge.factor_means(v, v.where("date % 250 = 249").select("date"))
    return out.select(F.col("date").alias("vec_id"), "i", r("v").alias("v"))


@query("fc15_mean_forecasts")
def fc15_stocks(spark: SparkSession, sf: str) -> DataFrame:
    """Stock forecasts of a year from the factor means at its first formation."""
    b = rk1(spark, sf).persist()
    f = risk.factor_returns(risk.daily_regressions(demo.days(spark, sf), b)).persist()
    return ridge.mean_forecasts(b, f)


@query("fc17_mapped_loss", f"WITH {MONTHLY_SQL} SELECT eom, count(*) AS n, round(avg(power(label - (0.001 * qty / 64 - 0.02 * disc), 2)), 9) AS mse FROM panel WHERE label IS NOT NULL GROUP BY eom")
def fc17(spark: SparkSession, sf: str) -> DataFrame:
    p = demo.monthly(spark, sf).where("label IS NOT NULL")
    b = p.select("id", "eom", F.array(F.col("qty") / 64, F.col("disc")).alias("b"))
    forecasts = p.select("eom").distinct().withColumn("m", F.array(F.lit(0.001), F.lit(-0.02)))
    return ridge.mapped_losses(b, p.select("id", "eom", "label"), forecasts).select("eom", "n", r("mse", 9).alias("mse"))


@query("fc19_tuned_stream_means")
def fc19(spark: SparkSession, sf: str) -> DataFrame:
    """Factor means where daily regressions have each year's searched penalty."""
    days, b = demo.days(spark, sf).persist(), rk1(spark, sf).persist()
    f = risk.factor_returns(risk.daily_regressions(days, b, risk.searched_section_penalties(days, b, forecast_years(days, "date")))).persist()
    return ridge.mean_forecasts(b, f)


@query("fc21_blends", f"WITH {_SCORED}, a AS (SELECT id, eom, excntry, pred AS p, cume_dist() OVER (PARTITION BY excntry, eom ORDER BY pred) - 0.5 AS c FROM scored) SELECT id, eom, excntry, round((p + c + 2 * p) / 3, 8) AS pred FROM a")
def fc21(spark: SparkSession, sf: str) -> DataFrame:
    p = scored(spark, sf).select("id", "eom", "excntry", "pred").persist()
    return trees.blended(p, ranks.forecast_percentiles(p), p.withColumn("pred", 2 * F.col("pred"))).withColumn("pred", r("pred"))


@query("cv3_expanding_folds", f"WITH {CELLS_SQL}, m AS (SELECT DISTINCT eom, year(eom) * 12 + month(eom) - 1 AS m FROM cells), y AS (SELECT DISTINCT year(eom) AS year FROM m) SELECT year, eom, CAST(least(4, (m - (SELECT min(m) FROM m)) * 5 // greatest(1, year * 12 - 1 - (SELECT min(m) FROM m))) AS INTEGER) AS fold FROM y JOIN m ON year(eom) < year")
def cv3(spark: SparkSession, sf: str) -> DataFrame:
    months = demo.cells(spark, sf).select("eom").distinct().persist()
    first = months.agg(F.min(folds.month_number(F.col("eom")))).first()[0]
    years = months.select(F.year("eom").alias("year")).distinct()
    known = months.join(F.broadcast(years), F.year("eom") < F.col("year"))  # a row a month and year
    return known.select("year", "eom", folds.expanding_fold(F.col("eom"), F.col("year") * 12 - 1, first).alias("fold"))


@query("cv8_bootstrap_months")
def cv8(spark: SparkSession, sf: str) -> DataFrame:
    months = [m for (m,) in demo.cells(spark, sf).select("eom").distinct().orderBy("eom").collect()]
    anchor = months[-1].year * 12 + months[-1].month - 1
    return _frame(spark, [(bag, k, m) for bag in range(5) for k, m in enumerate(folds.bootstrap_months(months, anchor, bag))], "bag int, place int, eom date")


# --- trees: few candidates and rounds here, as a fit is a Spark job a round; the defaults are the whole search ----------

_FEW, _SHORT, _LONG = trees.CANDIDATES[8:10], (4, 0.15), (8, 0.1)


def _tree_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    keys = ["id", "eom", "eom_ret", "excntry", "label", "test"]
    p = ranks.ranked_panel(demo.monthly(spark, sf).select(*keys, *FEATURES), FEATURES).persist()
    train = p.where("label IS NOT NULL AND NOT test").withColumn("fold", folds.calendar_fold(F.col("eom"), 1995 * 12, 1997 * 12 + 11, 2))
    return p.where("test"), train


def _predicted(model, rows: DataFrame) -> DataFrame:  # noqa: ANN001
    return model.transform(rows).select("id", "eom", "excntry", "pred")


@query("fc9_two_stage_trees")
def fc9(spark: SparkSession, sf: str) -> DataFrame:
    test, train = _tree_rows(spark, sf)
    model, _ = trees.two_stage(trees.assembled(train, FEATURES), "fold", _FEW, _SHORT, _LONG)
    return _predicted(model, trees.assembled(test, FEATURES))


@query("fc10_principal_trees")
def fc10(spark: SparkSession, sf: str) -> DataFrame:
    test, train = _tree_rows(spark, sf)
    basis = trees.principal_basis(FEATURES, 0.9)
    model, _ = trees.two_stage(train, "fold", _FEW[:1], _SHORT, _LONG, basis=basis)
    return _predicted(model, basis(train, test))


@query("fc11_age_weighted_trees")
def fc11(spark: SparkSession, sf: str) -> DataFrame:
    test, train = _tree_rows(spark, sf)
    weighted = trees.age_weights(trees.assembled(train, FEATURES), 1997 * 12 + 11, 36)
    model, _ = trees.two_stage(weighted, "fold", _FEW[:1], _SHORT, _LONG, weight="weight")
    return _predicted(model, trees.assembled(test, FEATURES))


@query("fc12_bagged_trees")
def fc12(spark: SparkSession, sf: str) -> DataFrame:
    test, train = _tree_rows(spark, sf)
    return trees.bagged(trees.assembled(train, FEATURES), trees.assembled(test, FEATURES), _FEW[0], 4, 0.15, 1997 * 12 + 11)
