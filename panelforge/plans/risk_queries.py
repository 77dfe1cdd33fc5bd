"""Queries of the risk operators: one-factor cross-sections with closed forms in SQL, and whole ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import INDUSTRIES
from ..operators import linalg, moments, risk
from ..sources import demo
from ..sources.demo import DAYS_SQL, FEATURES, MONTHLY_SQL
from .queries import _SIC_SQL, ORACLES, _rank_sql, forecast_years, query, r, rk1, st1, vectors

_SIC = _SIC_SQL.replace(" v ", " CAST(sic AS DOUBLE) ")


def one_factor(spark: SparkSession, sf: str) -> DataFrame:
    """Exposures to one factor, exact in binary."""
    return demo.monthly(spark, sf).select("eom", "eom_ret", "id", F.array(F.col("qty") / 64).alias("b"))


def _exposures_sql(rank: str, z: str) -> str:
    ranks_of = " UNION ALL ".join(f"SELECT id, eom, excntry, sic, {k + len(INDUSTRIES)} AS i, {rank.format(rank=_rank_sql(f, 'excntry, eom'), f=f)} AS x FROM panel" for k, f in enumerate(FEATURES))
    names = ", ".join(f"'{n}'" for n in INDUSTRIES)
    return f"""WITH {MONTHLY_SQL}, x AS ({ranks_of}), z AS (SELECT id, eom, i, CASE WHEN coalesce(round(stddev_samp(x) OVER (PARTITION BY eom, i), 6), 0) <> 0 THEN {z} ELSE 0 END AS b FROM x)
SELECT id, eom, CAST(i AS INTEGER) AS i, round(b, 7) AS b FROM z UNION ALL SELECT id, eom, CAST(k AS INTEGER), CASE WHEN [{names}][k + 1] = {_SIC} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM panel, range({len(INDUSTRIES)}) t(k)"""


_MIN_OBS = "CASE WHEN count({f}) OVER (PARTITION BY excntry, eom) >= 3 THEN {rank} ELSE 0 END"
_Z = "(x - avg(x) OVER (PARTITION BY eom, i)) / stddev_samp(x) OVER (PARTITION BY eom, i)"


def _long(b: DataFrame) -> DataFrame:
    return b.select("id", "eom", F.posexplode("b").alias("i", "b")).select("id", "eom", "i", r("b", 7).alias("b"))


@query("rk1_exposures_long", _exposures_sql(_MIN_OBS, _Z))
def rk1_long(spark: SparkSession, sf: str) -> DataFrame:
    return _long(rk1(spark, sf))


@query("rk26_percentile_exposures", _exposures_sql(_MIN_OBS, "x"))
def rk26(spark: SparkSession, sf: str) -> DataFrame:
    return _long(risk.exposures(demo.monthly(spark, sf), FEATURES, min_obs=3, variant="percentile"))


_PLAIN_RANK = "CASE WHEN {f} = 0 THEN -0.5 WHEN {f} IS NOT NULL THEN count({f}) OVER (PARTITION BY excntry, eom ORDER BY {f} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(count({f}) OVER (PARTITION BY excntry, eom) AS DOUBLE) - 0.5 END"


def _median_sql(industry: bool) -> str:
    names = ", ".join(f"'{n}'" for n in INDUSTRIES)
    parts = " UNION ALL ".join(f"SELECT id, eom, excntry, {_SIC} AS g, {k + len(INDUSTRIES)} AS i, {_PLAIN_RANK.format(f=f)} AS x, count({f}) OVER (PARTITION BY excntry, eom) >= 3 AS fine FROM panel" for k, f in enumerate(FEATURES))
    within = "median(x) OVER (PARTITION BY excntry, eom, i, g), " if industry else ""
    return f"""WITH {MONTHLY_SQL}, o AS ({parts}), x AS (SELECT id, eom, i, CASE WHEN fine THEN coalesce(x, {within}median(x) OVER (PARTITION BY excntry, eom, i), 0) ELSE 0 END AS x FROM o),
z AS (SELECT id, eom, i, CASE WHEN coalesce(round(stddev_samp(x) OVER (PARTITION BY eom, i), 6), 0) <> 0 THEN {_Z} ELSE 0 END AS b FROM x)
SELECT id, eom, CAST(i AS INTEGER) AS i, round(b, 7) AS b FROM z UNION ALL SELECT id, eom, CAST(k AS INTEGER), CASE WHEN [{names}][k + 1] = {_SIC} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM panel, range({len(INDUSTRIES)}) t(k)"""


@query("rk26_country_medians", _median_sql(False))
def rk26_country(spark: SparkSession, sf: str) -> DataFrame:
    return _long(risk.exposures(demo.monthly(spark, sf), FEATURES, min_obs=3, variant="country"))


@query("rk26_industry_medians", _median_sql(True))
def rk26_industry(spark: SparkSession, sf: str) -> DataFrame:
    return _long(risk.exposures(demo.monthly(spark, sf), FEATURES, min_obs=3, variant="industry"))


@query("st9_constant_noise")
def st9(spark: SparkSession, sf: str) -> DataFrame:
    """Exposures where a feature without variation in a month has normal draws."""
    p = demo.monthly(spark, sf).withColumn("returned", F.lit(0.25))
    return _long(risk.exposures(p, FEATURES, min_obs=3, variant="noise"))


_ONE = f"""WITH {MONTHLY_SQL}, {DAYS_SQL}, j AS (SELECT d.id, d.date, p.qty / 64 AS x, d.ret_exc AS y, count(*) OVER (PARTITION BY d.date) AS n FROM days d JOIN panel p ON p.id = d.id AND p.eom_ret = last_day(d.date)),
fit AS (SELECT date, CASE WHEN avg(y * y) > 0 AND max(x) > min(x) THEN sum(x * y) / (sum(x * x) + count(*) * 1e-4 / sqrt(avg(y * y))) ELSE 0 END AS f FROM j WHERE n > 1 GROUP BY date)"""


@query("rk2_one_factor", f"{_ONE} SELECT date, round(f, 9) AS f FROM fit")
def rk2_one(spark: SparkSession, sf: str) -> DataFrame:
    f = risk.factor_returns(risk.daily_regressions(demo.days(spark, sf), one_factor(spark, sf)))
    return f.select("date", r(F.col("f")[0], 9).alias("f"))


@query("rk3_residuals", f"{_ONE} SELECT id, date, round(y - x * f, 9) AS res FROM j JOIN fit USING (date)")
def rk3(spark: SparkSession, sf: str) -> DataFrame:
    return risk.daily_regressions(demo.days(spark, sf), one_factor(spark, sf)).select("id", "date", r("res", 9).alias("res"))


@query("io15_reconstructed_returns", f"{_ONE} SELECT id, date, 0.0::DOUBLE AS error FROM j WHERE n > 1")
def io15(spark: SparkSession, sf: str) -> DataFrame:
    """How far reconstructed returns are from those observed."""
    days, b = demo.days(spark, sf), one_factor(spark, sf)
    fits = risk.daily_regressions(days, b).persist()
    out = risk.reconstructed(b, risk.factor_returns(fits), fits.select("id", "date", "res")).join(days, ["id", "date"])
    return out.select("id", "date", F.abs(r(F.col("ret") - F.col("ret_exc"), 12)).alias("error"))


@query("io16_projected_exposures", f"WITH {MONTHLY_SQL} SELECT id, eom, round(0.6 * qty / 64 + 0.8 * disc, 8) AS b0, round(0.8 * qty / 64 - 0.6 * disc, 8) AS b1 FROM panel")
def io16(spark: SparkSession, sf: str) -> DataFrame:
    b = demo.monthly(spark, sf).select("id", "eom", F.array(F.col("qty") / 64, F.col("disc")).alias("b"))
    out = risk.projected(b, np.array([[0.6, 0.8], [0.8, -0.6]]))
    return out.select("id", "eom", r(F.col("b")[0]).alias("b0"), r(F.col("b")[1]).alias("b1"))


@query(
    "rk5_filled_volatility",
    f"""WITH {MONTHLY_SQL}, st AS ({ORACLES["st1_specific_volatility"]}), mv AS (SELECT id, last_day(date) AS eom, arg_max(vol, date) AS vol FROM st WHERE eligible GROUP BY ALL),
j AS (SELECT p.id, p.eom, p.qty / 64 AS x, vol FROM panel p LEFT JOIN mv USING (id, eom)), o AS (SELECT eom, x, ln(vol) AS y FROM j WHERE vol > 0),
fit AS (SELECT eom, CASE WHEN avg(y * y) > 0 AND max(x) > min(x) THEN sum(x * y) / (sum(x * x) + count(*) * 1e-4 / sqrt(avg(y * y))) ELSE 0 END AS f FROM o GROUP BY eom HAVING count(*) > 1),
m AS (SELECT eom, last_value(f IGNORE NULLS) OVER (ORDER BY eom) AS f FROM (SELECT DISTINCT eom FROM panel) LEFT JOIN fit USING (eom))
SELECT id, eom, round(CASE WHEN vol > 0 THEN vol ELSE exp(x * f) END, 8) AS vol FROM j JOIN m USING (eom)""",
)
def rk5(spark: SparkSession, sf: str) -> DataFrame:
    return risk.filled_volatility(one_factor(spark, sf), risk.last_volatility(st1(spark, sf))).select("id", "eom", r("vol").alias("vol"))


@query("rk25_volatility_penalties")
def rk25(spark: SparkSession, sf: str) -> DataFrame:
    """Filled volatility with each forecast year's searched penalty."""
    b, vols = rk1(spark, sf).persist(), risk.last_volatility(st1(spark, sf)).persist()
    return risk.filled_volatility(b, vols, risk.searched_volatility_penalties(b, vols, forecast_years(b)))


@query("rk24_replay")
def rk24_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Daily regressions under each year's searched penalty, and the volatility state that follows from their
    residuals."""
    days, b = demo.days(spark, sf).persist(), rk1(spark, sf).persist()
    fits = risk.daily_regressions(days, b, risk.searched_section_penalties(days, b, forecast_years(days, "date")))
    return risk.specific_volatility(fits.select("id", "date", "res"), seed=10, least=20)


@query("rk22_characteristic_basis")
def rk22(spark: SparkSession, sf: str) -> DataFrame:
    """The replay on each year's characteristic axes: factor returns and residuals."""
    b = rk1(spark, sf).persist()
    return risk.daily_regressions(demo.days(spark, sf), risk.projected_by_year(b, risk.characteristic_bases(b, forecast_years(b))))


def stream(spark: SparkSession, sf: str) -> pd.DataFrame:
    """The factor stream on the driver, in order: days x K."""
    return vectors(spark, sf).orderBy("vec_id").select("vec_id", "f", "market").toPandas()


@query("rk23_ward_groups")
def rk23(spark: SparkSession, sf: str) -> DataFrame:
    labels = linalg.product_groups(*moments.net_products(vectors(spark, sf)), 21)
    return spark.createDataFrame([(k, int(g)) for k, g in enumerate(labels)], "i int, cluster int")


_PERIODS = "v AS (SELECT vec_id, vec_id // 50 AS period, embedding::DOUBLE[] AS f FROM embeddings)"


def _expanding_sql(half_life: float) -> str:
    return f"""u AS (SELECT vec_id, period, unnest(range(64)) AS i, unnest(f) AS x FROM v), e AS (SELECT p.period, vec_id, i, x, power(2.0, (vec_id - last) / {half_life}) AS w FROM u JOIN (SELECT period, max(vec_id) AS last FROM v GROUP BY period) p ON u.period <= p.period),
c AS (SELECT period, vec_id, i, w, x - (sum(w * x) OVER (PARTITION BY period, i)) / (sum(w) OVER (PARTITION BY period, i)) AS x FROM e)"""


@query("rk15_expanding_covariance", f"WITH {_PERIODS}, {_expanding_sql(84.0)} SELECT a.period, a.i, b.i AS j, round(sum(a.w * a.x * b.x) / sum(a.w) / (1 - sum(a.w * a.w) / (sum(a.w) * sum(a.w))), 9) AS v FROM c a JOIN c b ON a.period = b.period AND a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def rk15(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).withColumn("period", F.floor(F.col("vec_id") / 50))
    return moments.expanding_covariance(rows, "period", "vec_id", 84.0).select("period", "i", "j", r("v", 9).alias("v"))


def _driver_matrix(spark: SparkSession, m: np.ndarray) -> DataFrame:
    i, j = np.triu_indices(len(m))
    return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), m[i, j].tolist(), strict=True)), "i int, j int, v double")


def _covariance(spark: SparkSession, sf: str) -> np.ndarray:
    rows = moments.factor_covariance(vectors(spark, sf), moments.exponential(504), moments.exponential(84)).toPandas()  # K x K
    return linalg.statistics_matrix(rows["i"].to_numpy(), rows["j"].to_numpy(), rows["v"].to_numpy())


@query("rk11_truncated_covariance")
def rk11(spark: SparkSession, sf: str) -> DataFrame:
    cov = _covariance(spark, sf)
    return _driver_matrix(spark, linalg.truncated(cov, np.ones(1), np.ones((1, len(cov))), 0.9)[0])


@query("rk12_tuned_truncation")
def rk12(spark: SparkSession, sf: str) -> DataFrame:
    v, cov = stream(spark, sf), _covariance(spark, sf)
    share = linalg.selected_share(np.stack(v["f"].to_numpy()), v["vec_id"].to_numpy() // 21)
    return _driver_matrix(spark, linalg.truncated(cov, np.ones(1), np.ones((1, len(cov))), share)[0]).withColumn("share", F.lit(share))


@query("rk13_tuned_decay")
def rk13_tuned(spark: SparkSession, sf: str) -> DataFrame:
    v = stream(spark, sf)
    x, months = np.stack(v["f"].to_numpy()), v["vec_id"].to_numpy() // 21
    rows = [(c, linalg.selected_decay(x, months, 504.0, 84.0, component=c)) for c in ("variance", "correlation")]
    return spark.createDataFrame(rows, "component string, half_weight_age double")


@query("rk16_expanding_tuned_decay")
def rk16(spark: SparkSession, sf: str) -> DataFrame:
    """Each year's half-weight age (of 12 months) by capped calendar blocks of all history, and the covariance it
    gives; without a choice, the exponential one."""
    v = vectors(spark, sf).select("vec_id", "f").orderBy("vec_id").toArrow()  # days x K, as flat numbers
    x, months = v["f"].combine_chunks().flatten().to_numpy().reshape(len(v), -1), v["vec_id"].to_numpy() // 21
    years = len(range(11, int(months.max()) + 1, 12))
    shared = spark.sparkContext.broadcast((x, months))

    def run(batches):  # noqa: ANN001, ANN202
        x, months = shared.value
        i, j = np.triu_indices(x.shape[1])
        for frame in batches:
            for last in 11 + 12 * frame["id"].to_numpy():
                known = x[months <= last]
                age = linalg.selected_decay(known, months[months <= last], 504.0, 84.0, width=96)
                cov = linalg.aged_covariance(known, np.arange(len(known), 0, -1.0), 504.0, 84.0, age)
                yield pd.DataFrame({"i": i, "j": j, "v": cov[i, j], "month": last, "half_weight_age": np.nan if age is None else age})

    rows = spark.range(0, years, 1, max(1, min(years, 96))).mapInPandas(run, "i int, j int, v double, month int, half_weight_age double")
    return rows.withColumn("half_weight_age", F.nanvl("half_weight_age", F.lit(None).cast("double")))


@query("rk20_state_blend")
def rk20(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the down covariance in either market state, learned from months' pairs of down, up and next month's
    covariance."""
    v = stream(spark, sf)
    x, market, months = np.stack(v["f"].to_numpy()), v["market"].to_numpy(), v["vec_id"].to_numpy() // 21
    pairs = []
    for m in range(3, int(months.max())):
        known, next_month = months <= m, months == m + 1
        down, up = (x[known & side] for side in (market < 0, market >= 0))
        if min(len(down), len(up), int(next_month.sum())) < 2:
            continue
        a, b, target = (np.cov(y.T, ddof=0) for y in (down, up, x[next_month]))
        pairs.append((bool(market[months == m].sum() < 0), float(((a - b) * (target - b)).sum()), float(((a - b) ** 2).sum())))
    blend = linalg.state_blend(pairs, least=8)
    return spark.createDataFrame([(s, float(w)) for s, w in sorted(blend.items())], "falling boolean, share double")
