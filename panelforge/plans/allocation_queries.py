"""Queries of the allocation operators: risk with one factor, for which SQL has closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import industry
from ..operators import allocation, evaluation, joins, linalg
from ..sources import demo
from .queries import _SCORED, _SIC_SQL, _WEIGHTED, decile_weights, outcomes, query, r, scored

TARGET = "0.1 / sqrt(252 * {})"
_UNITS = f"""WITH {_SCORED}, u AS (SELECT id, eom, scored.eom_ret, scored.label, pred AS mu, 0.0001 * (1 + qty / 100) AS d, price / 1000000 AS b, ({_SIC_SQL.replace(' v ', ' CAST(sic AS DOUBLE) ')}) AS g
  FROM scored JOIN panel USING (id, eom)),
s AS (SELECT *, median(d + b * b) OVER (PARTITION BY eom) AS unit FROM u)"""


def _solved(rhs: str, d: str, out: str, source: str, keys: str = "eom", b: str = "b") -> str:
    """The closed form of (diag(d) + bb')^-1 rhs."""
    return f"({rhs}) / ({d}) - {b} / ({d}) * (sum({b} * ({rhs}) / ({d})) OVER (PARTITION BY {keys})) / (1 + sum({b} * {b} / ({d})) OVER (PARTITION BY {keys})) AS {out}"


def _variance(w: str, keys: str = "eom", b: str = "b", d: str = "d") -> str:
    return f"(sum({w} * {w} * {d}) OVER (PARTITION BY {keys}) + power(sum({b} * {w}) OVER (PARTITION BY {keys}), 2))"


def risk_rows(spark: SparkSession, sf: str, factor: bool = True) -> DataFrame:
    """A month of risk in a row: forecasts, specific variances, one factor's loadings (none without `factor`)."""
    m = demo.monthly(spark, sf).select("id", "eom", "qty", "price", "sic")
    rows = scored(spark, sf).select("id", "eom", F.col("pred").alias("mu")).join(m, ["id", "eom"])
    b = F.col("price") / 1_000_000 if factor else F.lit(0.0)
    one = F.struct("id", "mu", (0.0001 * (1 + F.col("qty") / 100)).alias("d"), b.alias("b"), industry(F.col("sic")).alias("g"))
    x = rows.groupBy("eom").agg(F.array_sort(F.collect_list(one)).alias("x"))
    loading = F.transform("x", lambda v: F.array(v["b"]))
    return x.select("eom", F.col("x.id").alias("ids"), F.col("x.mu").alias("mu"), F.col("x.d").alias("diagonal"), loading.alias("loading"), F.transform(loading, lambda v: F.transform(v, lambda y: y * 1.5)).alias("reference"), F.col("x.g").alias("industry"))


def _rounded(weights: DataFrame, digits: int = 8) -> DataFrame:
    return weights.select("id", "eom", r("w", digits).alias("w"))


@query("al2_woodbury_solve", f"{_UNITS}, z AS (SELECT id, eom, {_solved('mu', 'd', 'z', 's')} FROM s) SELECT id, eom, round(z, 5) AS w FROM z")
def al2(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(allocation.per_month(risk_rows(spark, sf), lambda mu, d, b, g: linalg.woodbury(d, b, mu)), 5)


@query("al3_minimum_variance", f"{_UNITS}, z AS (SELECT id, eom, {_solved('1', 'd', 'z', 's')} FROM s) SELECT id, eom, round(z / sum(z) OVER (PARTITION BY eom), 8) AS w FROM z")
def al3(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(allocation.minimum_variance(risk_rows(spark, sf)))


@query("al4_markowitz", f"{_UNITS}, z AS (SELECT id, eom, d, b, {_solved('mu', 'd', 'z', 's')} FROM s) SELECT id, eom, round(z * {TARGET.format(_variance('z'))}, 8) AS w FROM z")
def al4(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(allocation.markowitz(risk_rows(spark, sf)))


@query(
    "al5_portfolio_variance",
    f"""WITH {_WEIGHTED}, p AS (SELECT w.id, w.eom, w.w, qty / 1000 AS b0, disc AS b1, 0.0001 * (1 + tax) AS d FROM weights w JOIN panel USING (id, eom) WHERE tax IS NOT NULL)
SELECT eom, round(sum(w * w * d) + 0.04 * power(sum(w * b0), 2) + 0.02 * sum(w * b0) * sum(w * b1) + 0.09 * power(sum(w * b1), 2), 10) AS variance FROM p GROUP BY eom""",
)
def al5(spark: SparkSession, sf: str) -> DataFrame:
    m = demo.monthly(spark, sf).where("tax IS NOT NULL").select("id", "eom", "qty", "disc", "tax")
    w = decile_weights(spark, sf).join(m.select("id", "eom"), ["id", "eom"], "left_semi")
    both = F.inline(F.array(F.struct(F.lit(0).alias("i"), (F.col("qty") / 1000).alias("b")), F.struct(F.lit(1).alias("i"), F.col("disc").alias("b"))))
    cov = m.select("eom").distinct().select("eom", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(v).alias("v")) for i, j, v in ((0, 0, 0.04), (0, 1, 0.01), (1, 1, 0.09))])))
    out = allocation.portfolio_variance(w, m.select("id", "eom", (0.0001 * (1 + F.col("tax"))).alias("d")), m.select("id", "eom", both), cov)
    return out.select("eom", r("variance", 10).alias("variance"))


@query(
    "al6_net_neutral",
    f"""{_UNITS}, z AS (SELECT *, {_solved('mu', 'd', 'z', 's')}, {_solved('1', 'd', 'o', 's')} FROM s), n AS (SELECT *, z - o * (sum(z) OVER (PARTITION BY eom)) / (sum(o) OVER (PARTITION BY eom)) AS raw FROM z)
SELECT id, eom, round(raw * {TARGET.format(_variance('raw'))}, 8) AS w FROM n""",
)
def al6(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(allocation.neutral(risk_rows(spark, sf), "net"))


_LOCAL = f"""{_UNITS}, n AS (SELECT *, (mu - (sum(mu / d) OVER (PARTITION BY eom, g)) / (sum(1 / d) OVER (PARTITION BY eom, g))) / d AS raw, count(*) OVER (PARTITION BY eom, g) AS k FROM s)"""


@query("al6_industry_neutral", f"{_LOCAL} SELECT id, eom, round(raw * 0.1 / sqrt(252 * sum(raw * raw * d) OVER (PARTITION BY eom)), 8) AS w FROM n")
def al6_industry(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(allocation.neutral(risk_rows(spark, sf, factor=False), "industry"))


@query(
    "al7_penalised_weights",
    f"""{_UNITS}, q AS (SELECT 0.0::DOUBLE AS q UNION ALL SELECT power(10, -5 + k / 2.0) FROM range(15) t(k)), e AS (SELECT *, d + q * unit AS dq FROM s, q),
z AS (SELECT *, {_solved('1', 'dq', 'o', 'e', 'eom, q')}, {_solved('mu', 'dq', 'z', 'e', 'eom, q')} FROM e)
SELECT id, eom, round(q, 6) AS q, round(o / sum(o) OVER (PARTITION BY eom, q), 8) AS minimum, round(z * {TARGET.format(_variance('z', 'eom, q'))}, 8) AS markowitz FROM z""",
)
def al7(spark: SparkSession, sf: str) -> DataFrame:
    return allocation.penalised_weights(risk_rows(spark, sf)).select("id", "eom", r("q", 6).alias("q"), r("minimum").alias("minimum"), r("markowitz").alias("markowitz"))


@query(
    "al9_penalised_loop",
    f"""{_UNITS}, q AS (SELECT 0.0::DOUBLE AS q UNION ALL SELECT power(10, -5 + k / 2.0) FROM range(15) t(k)), e AS (SELECT *, d + q * unit AS dq FROM s, q),
z AS (SELECT *, {_solved('mu', 'dq', 'z', 'e', 'eom, q')} FROM e), c AS (SELECT *, z * {TARGET.format(_variance('z', 'eom, q'))} AS w FROM z),
bank AS (SELECT eom, eom_ret, q, sum(w * label) AS payoff FROM c WHERE label IS NOT NULL GROUP BY ALL), f AS (SELECT DISTINCT eom AS formation FROM u),
rel AS (SELECT formation, q, eom_ret, payoff, row_number() OVER (PARTITION BY formation, q ORDER BY eom_ret DESC) AS k FROM f JOIN bank ON eom_ret <= formation),
bl AS (SELECT *, ntile(5) OVER (PARTITION BY formation, q ORDER BY eom_ret) AS block, count(*) OVER (PARTITION BY formation, q) AS n FROM rel WHERE k <= 120),
sc AS (SELECT formation, q, block, avg(payoff) * sqrt(12) / stddev_samp(payoff) AS v FROM bl WHERE n >= 10 GROUP BY ALL), t AS (SELECT formation, q, avg(v) AS score FROM sc GROUP BY ALL HAVING count(v) = 5),
ch AS (SELECT formation, arg_min(q, (-score, q)) AS q FROM t GROUP BY formation)
SELECT c.id, c.eom, round(c.q, 6) AS q, round(c.w, 8) AS w FROM c JOIN (SELECT formation, coalesce(ch.q, 0) AS q FROM f LEFT JOIN ch USING (formation)) p ON p.formation = c.eom AND p.q = c.q""",
)
def al9(spark: SparkSession, sf: str) -> DataFrame:
    return allocation.penalised_loop(risk_rows(spark, sf), outcomes(spark, sf)).select("id", "eom", r("q", 6).alias("q"), r("w").alias("w"))


@query("al10_wide_penalties")
def al10(spark: SparkSession, sf: str) -> DataFrame:
    profiles = allocation.penalty_profiles(risk_rows(spark, sf), outcomes(spark, sf)).persist()
    months = profiles.select("eom").collect()  # not a second branch of the plan, which would make the profiles again
    return allocation.wide_penalties(profiles, spark.createDataFrame(months, "formation date"))


def _sleeves(combine: str, pick: str) -> None:
    sql = f"""{_LOCAL}, v AS (SELECT *, sum(raw * raw * d) OVER (PARTITION BY eom, g) AS gv FROM n),
l AS (SELECT *, CASE WHEN k > 1 AND gv > 0 THEN raw * 0.1 / sqrt(252 * gv) ELSE 0 END AS sleeve FROM v),
x AS (SELECT *, CASE WHEN k > 1 AND gv > 0 THEN {pick} ELSE 0 END * sleeve AS w FROM l)
SELECT id, eom, round(w * 0.1 / sqrt(252 * sum(w * w * d) OVER (PARTITION BY eom)), 7) AS w FROM x"""

    @query(f"al12_sleeves_{combine}", sql)
    def al12(spark: SparkSession, sf: str) -> DataFrame:
        return _rounded(allocation.industry_sleeves(risk_rows(spark, sf, factor=False), combine), 7)


# without a common factor the sleeves are independent and of one variance, so the least variance is equal parts and the
# best tangency is in proportion to what each sleeve is expected to earn, which is never negative
_sleeves("equal", "1")
_sleeves("minimum", "1")
_sleeves("tangency", "(sum(mu * sleeve) OVER (PARTITION BY eom, g))")


@query(
    "al13_two_scalings",
    f"""{_UNITS}, z AS (SELECT *, 1.5 * b AS ref, {_solved('mu', 'd', 'z', 's')} FROM s)
SELECT id, eom, round(z * {TARGET.format(_variance('z'))}, 8) AS native, round(z * {TARGET.format(_variance('z', b='ref'))}, 8) AS reference FROM z""",
)
def al13(spark: SparkSession, sf: str) -> DataFrame:
    return allocation.rescaled(risk_rows(spark, sf)).select("id", "eom", r("native").alias("native"), r("reference").alias("reference"))


@query(
    "al14_combined",
    f"""{_UNITS}, m AS (SELECT *, 1.5 * b AS ref, d + 0.1 * median(d + 2.25 * b * b) OVER (PARTITION BY eom) AS dq FROM u), z AS (SELECT *, {_solved('mu', 'dq', 'z', 'm')} FROM m)
SELECT id, eom, round(z * {TARGET.format(_variance('z', b='ref'))}, 8) AS w FROM z""",
)
def al14(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(allocation.rescaled(risk_rows(spark, sf), penalty=0.1).withColumn("w", F.col("reference")))


# --- evaluation and checks of outputs --------------------------------------------------------------------------------


@query("ev8_coverage", f"WITH {_WEIGHTED} SELECT count(*) AS expected, count(w.id) AS covered, count(*) - count(w.id) AS missing FROM (SELECT id, eom FROM panel WHERE label IS NOT NULL) p LEFT JOIN weights w USING (id, eom)")
def ev8(spark: SparkSession, sf: str) -> DataFrame:
    out = outcomes(spark, sf)
    w = decile_weights(spark, sf).join(out.select("id", "eom"), ["id", "eom"], "left_semi")
    evaluation.evaluate(w, out)  # raises unless keys agree
    missing = joins.uncovered(out, w, ["id", "eom"]).where("side = 'expected'").select("id", "eom", F.lit(1).alias("m"))
    return out.select("id", "eom").join(missing, ["id", "eom"], "left").agg(F.count("*").alias("expected"), F.count_if(F.col("m").isNull()).alias("covered"), F.count("m").alias("missing"))


@query("ev9_finalised", f"WITH {_WEIGHTED} SELECT id, eom, round(w, 8) AS w FROM weights")
def ev9(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluation.finalised(decile_weights(spark, sf)))


@query("ev6_scaled_drawdowns", f"WITH {_WEIGHTED}, x AS (SELECT eom, ret * 0.1 AS ret FROM months), k AS (SELECT eom, 'raw' AS kind, ret FROM x UNION ALL SELECT eom, 'scaled', ret * 0.1 / (stddev_samp(ret) OVER () * sqrt(12)) FROM x), l AS (SELECT kind, eom, product(1 + ret) OVER (PARTITION BY kind ORDER BY eom) AS level FROM k), p AS (SELECT kind, 1 - level / greatest(1, max(level) OVER (PARTITION BY kind ORDER BY eom)) AS drawdown FROM l) SELECT kind, round(max(drawdown), 8) AS maximum_drawdown FROM p GROUP BY kind")
def ev6_scaled(spark: SparkSession, sf: str) -> DataFrame:
    from .queries import performance

    out = evaluation.maximum_drawdowns(performance(spark, sf).select("eom", (F.col("ret") * 0.1).alias("ret")))
    return out.select("kind", r("maximum_drawdown").alias("maximum_drawdown"))
