"""Named queries over the derived panels, and SQL with the same rows for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import forecast_year, month_end, month_number, next_month_end
from ..functions.values import INDUSTRIES, SIC_RANGES, finite, flag, industry
from ..operators import allocation, evaluation, folds, joins, moments, ranks, risk
from ..sources import demo, panel
from ..sources.demo import CELLS_SQL, DAYS_SQL, FEATURES, MONTHLY_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r(c: object, digits: int = 8) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- sources, projections, predicates -------------------------------------------------------------------------------


@query(
    "io4_canonical_projection",
    """SELECT o_orderkey AS id, last_day(CAST(o_orderdate AS DATE)) AS eom, last_day(CAST(last_day(CAST(o_orderdate AS DATE)) + INTERVAL 1 DAY AS DATE)) AS eom_ret,
    o_orderpriority AS excntry, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS test, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS label,
    CAST(o_custkey AS DOUBLE) AS size FROM orders""",
)
def io4(spark: SparkSession, sf: str) -> DataFrame:
    o = demo.table(spark, sf, "orders")
    eom = F.last_day(F.col("o_orderdate").cast("date"))
    text = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "0").otherwise("x")
    raw = o.select(F.col("o_orderkey").alias("id"), eom.alias("eom"), next_month_end(eom).alias("eom_ret"), F.col("o_orderpriority").alias("excntry"), text.alias("test"), F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("label"), F.col("o_custkey").alias("size"))
    return panel.canonical(raw, ["size"])


@query("io5_feature_list", "SELECT DISTINCT p_brand AS features FROM part")
def io5(spark: SparkSession, sf: str) -> DataFrame:
    return demo.table(spark, sf, "part").select(F.col("p_brand").alias("features")).distinct().orderBy("features")


@query("io6_month_load", f"WITH {MONTHLY_SQL} SELECT id, eom, qty FROM panel WHERE eom = DATE '1996-03-31'")
def io6(spark: SparkSession, sf: str) -> DataFrame:
    import datetime as dt

    return panel.month(demo.monthly(spark, sf), dt.date(1996, 3, 31)).select("id", "eom", "qty")


@query("io7_day_range_load", f"WITH {DAYS_SQL} SELECT id, date, ret_exc FROM days WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-03-20'")
def io7(spark: SparkSession, sf: str) -> DataFrame:
    import datetime as dt

    return panel.month_to_date(panel.daily(demo.days(spark, sf)), dt.date(1996, 3, 20))


@query("io8_month_metadata", f"WITH {MONTHLY_SQL} SELECT eom, eom_ret, count(*) AS n, count(label) AS labels, min(id) AS first_id FROM panel GROUP BY ALL")
def io8(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel.metadata(demo.monthly(spark, sf))
    return rows.groupBy("eom", "eom_ret").agg(F.count("*").alias("n"), F.count("label").alias("labels"), F.min("id").alias("first_id"))


@query("pf4_membership", f"WITH {DAYS_SQL}, {CELLS_SQL} SELECT d.* FROM days d WHERE EXISTS (SELECT 1 FROM cells c WHERE c.id = d.id AND c.eom = CAST(date_trunc('month', d.date) AS DATE) - 1)")
def pf4(spark: SparkSession, sf: str) -> DataFrame:
    known = demo.cells(spark, sf).select("id", "eom")
    return demo.days(spark, sf).withColumn("eom", F.last_day(F.add_months("date", -1))).join(known, ["id", "eom"], "left_semi").drop("eom")


@query("pf6_finite_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem WHERE l_discount > 0 AND l_tax > 0")
def pf6(spark: SparkSession, sf: str) -> DataFrame:
    lines = demo.table(spark, sf, "lineitem")
    v = F.when(F.col("l_discount") == 0, float("inf")).when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_extendedprice"))
    return lines.select("l_orderkey", "l_linenumber", v.alias("v")).where(finite(F.col("v")))


@query("pf8_date_parts", "SELECT year(l_shipdate) AS y, month(l_shipdate) AS m, count(*) AS n FROM lineitem WHERE year(l_shipdate) = 1996 AND month(l_shipdate) <= 6 GROUP BY ALL")
def pf8(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("l_shipdate")
    lines = demo.table(spark, sf, "lineitem").where((d >= F.lit("1996-01-01").cast("timestamp_ntz")) & (d < F.lit("1996-07-01").cast("timestamp_ntz")))
    return lines.groupBy(F.year(d).alias("y"), F.month(d).alias("m")).agg(F.count("*").alias("n"))


@query("pf9_flag_parsing", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 5 = 1 THEN false WHEN o_orderkey % 5 = 2 THEN true WHEN o_orderkey % 5 = 3 THEN false END AS flag FROM orders")
def pf9(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "True").when(k == 1, "0").when(k == 2, "1").when(k == 3, "FALSE").otherwise("yes")
    return demo.table(spark, sf, "orders").select("o_orderkey", flag(text).alias("flag"))


_SIC_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'v BETWEEN {a} AND {b}' for a, b in SIC_RANGES[n])} THEN '{n}'" for n in SIC_RANGES) + " ELSE 'Other' END"


@query(
    "fn_industry",
    f"WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey * 37 % 9100 AS DOUBLE) WHEN 1 THEN CAST(p_partkey * 37 % 9100 AS DOUBLE) WHEN 2 THEN NULL END AS v FROM part) SELECT p_partkey, {_SIC_SQL} AS industry FROM p",
)
def fn_industry(spark: SparkSession, sf: str) -> DataFrame:
    code = (F.col("p_partkey") * 37 % 9100).cast("string")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, code).when(k == 1, F.concat(code, F.lit(".0"))).when(k == 2, F.concat(code, F.lit(".5"))).otherwise("n/a")
    return demo.table(spark, sf, "part").select("p_partkey", industry(text).alias("industry"))


@query("fn_calendar", "SELECT o_orderkey, year(d) * 12 + month(d) - 1 AS number, last_day(d) AS month_end, last_day(CAST(last_day(d) + INTERVAL 1 DAY AS DATE)) AS next_end, year(d) + CASE WHEN month(d) = 12 THEN 1 ELSE 0 END AS forecast_year FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def fn_calendar(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return demo.table(spark, sf, "orders").select("o_orderkey", month_number(d).alias("number"), month_end(month_number(d)).alias("month_end"), next_month_end(d).alias("next_end"), forecast_year(d).alias("forecast_year"))


# --- joins ---------------------------------------------------------------------------------------------------------


@query("j6_key_coverage", f"WITH {CELLS_SQL}, a AS (SELECT id, eom FROM cells WHERE qty > 50), b AS (SELECT id, eom FROM cells WHERE price > 30000) SELECT *, 'expected' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'got' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    c = demo.cells(spark, sf)
    return joins.uncovered(c.where("qty > 50"), c.where("price > 30000"), ["id", "eom"])


@query("j7_full_outer", f"WITH {CELLS_SQL} SELECT coalesce(a.id, b.id) AS id, coalesce(a.eom, b.eom) AS eom, coalesce(a.qty, 0) AS w, coalesce(b.price, 0) AS drift FROM (SELECT * FROM cells WHERE qty > 100) a FULL JOIN (SELECT * FROM cells WHERE disc = 0) b ON a.id = b.id AND a.eom = b.eom")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    c = demo.cells(spark, sf)
    return joins.combined(c.where("qty > 100").select("id", "eom", F.col("qty").alias("w")), c.where("disc = 0").select("id", "eom", F.col("price").alias("drift")), ["id", "eom"], ["w", "drift"])


@query("j10_as_of", "SELECT e.event_id, p.value AS as_of FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    e = demo.table(spark, sf, "events")
    p = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("value").alias("value"))
    return joins.as_of(e.select("event_id", "user_id", "ts"), p, "ts", "at", "value", ["user_id"]).select("event_id", "as_of")


@query("j11_formation_join", f"WITH {MONTHLY_SQL}, {DAYS_SQL} SELECT d.id, d.date, p.eom, p.qty FROM days d JOIN panel p ON p.id = d.id AND p.eom_ret = last_day(d.date)")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    m = demo.monthly(spark, sf).select("id", "eom", "eom_ret", "qty")
    return joins.on_formation(demo.days(spark, sf), m, ["id"]).select("id", "date", "eom", "qty")


@query("j12_contiguous_lag", f"WITH {CELLS_SQL} SELECT a.id, a.eom, a.price, b.price AS lag_price FROM cells a JOIN cells b ON a.id = b.id AND b.eom = CAST(date_trunc('month', a.eom) AS DATE) - 1")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    c = demo.cells(spark, sf)
    return joins.lagged(c.select("id", "eom", "price"), c, ["id"], ["price"])


# --- aggregates, windows, folds -------------------------------------------------------------------------------------


@query("a2_compounded", f"WITH {DAYS_SQL} SELECT last_day(date) AS eom, round(product(1 + r) - 1, 8) AS ret FROM (SELECT date, avg(ret_exc * ret_exc) AS r FROM days GROUP BY date) GROUP BY ALL")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    d = demo.days(spark, sf).groupBy("date").agg(F.avg(F.col("ret_exc") * F.col("ret_exc")).alias("r"))
    return d.groupBy(F.last_day("date").alias("eom")).agg(r(F.product(1 + F.col("r")) - 1).alias("ret"))


@query("a3_factor_targets", "SELECT last_day(DATE '2000-01-01' + CAST(vec_id AS INTEGER)) AS eom, i, round(sum(x), 6) AS v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    e = demo.table(spark, sf, "embeddings").select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("vec_id").cast("int")).alias("date"), F.col("embedding").cast("array<double>").alias("f"))
    return risk.monthly_factors(e).select("eom", "i", r("v", 6).alias("v"))


@query("a6_weighted_mean", "SELECT l_shipdate AS d, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 8) AS v FROM lineitem GROUP BY ALL")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    lines = demo.table(spark, sf, "lineitem").withColumn("top", F.max("l_extendedprice").over(Window.partitionBy("l_shipdate")))
    unit = F.col("l_extendedprice") / F.col("top")
    return lines.groupBy(F.col("l_shipdate").alias("d")).agg(r(F.sum(unit * F.col("l_discount")) / F.sum(unit)).alias("v"))


@query("a7_quantiles", f"WITH {CELLS_SQL} SELECT eom, round(quantile_cont(price, 0.1), 6) AS low, round(quantile_cont(price, 0.9), 6) AS high, round(median(price), 6) AS mid FROM cells GROUP BY eom")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return demo.cells(spark, sf).groupBy("eom").agg(r(F.percentile("price", F.lit(0.1)), 6).alias("low"), r(F.percentile("price", F.lit(0.9)), 6).alias("high"), r(F.median("price"), 6).alias("mid"))


_STATS_SQL = f"""WITH {MONTHLY_SQL}, v AS (SELECT eom, row_number() OVER () AS k, [1, qty, price / 10000, disc, label] AS f FROM panel WHERE label IS NOT NULL),
u AS (SELECT eom, k, unnest(range(5)) AS i, unnest(f) AS x FROM v)"""


@query("a10_sufficient_statistics", _STATS_SQL + " SELECT a.eom, a.i, b.i AS j, round(sum(a.x * b.x), 5) AS s FROM u a JOIN u b ON a.k = b.k AND a.i <= b.i GROUP BY ALL")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    p = demo.monthly(spark, sf).withColumn("price", F.col("price") / 10000)
    return moments.sufficient_statistics(p, ["qty", "price", "disc"], "label", ["eom"]).select("eom", "i", "j", r("s", 5).alias("s"))


@query("a12_mean_month_gram", f"WITH {CELLS_SQL}, g AS (SELECT eom, count(*) AS n, sum(qty * qty) AS s00, sum(qty * disc) AS s01, sum(disc * disc) AS s11 FROM cells GROUP BY eom HAVING count(*) > 1) SELECT i, j, round(avg(s / (n - 1)), 6) AS v FROM (SELECT n, unnest([0, 0, 1]) AS i, unnest([0, 1, 1]) AS j, unnest([s00, s01, s11]) AS s FROM g) GROUP BY ALL")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return moments.mean_month_gram(demo.cells(spark, sf), ["qty", "disc"]).select("i", "j", r("v", 6).alias("v"))


def _rank_sql(x: str, group: str) -> str:
    return f"""CASE WHEN {x} = 0 THEN -0.5 ELSE coalesce(CASE WHEN {x} IS NOT NULL THEN count({x}) OVER (PARTITION BY {group} ORDER BY {x} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    / CAST(count({x}) OVER (PARTITION BY {group}) AS DOUBLE) - 0.5 END, 0) END"""


_RANKED = ", ".join(f"round({_rank_sql(f, 'excntry, eom')}, 8) AS {f}" for f in FEATURES)
_SCORED = f"{MONTHLY_SQL}, scored AS (SELECT id, eom, eom_ret, excntry, label, test, round(({' + '.join(_rank_sql(f, 'excntry, eom') for f in FEATURES)}) / 5, 8) AS pred FROM panel)"
_WEIGHTED = (
    _SCORED
    + """, cutoffs AS (SELECT excntry, eom, quantile_cont(pred, 0.1) AS low, quantile_cont(pred, 0.9) AS high FROM scored GROUP BY ALL),
sided AS (SELECT s.*, CASE WHEN pred <= low THEN -1 WHEN pred >= high THEN 1 ELSE 0 END AS side FROM scored s JOIN cutoffs USING (excntry, eom)),
weights AS (SELECT *, side / CAST(count(*) OVER (PARTITION BY eom, side) AS DOUBLE) AS w FROM sided),
held AS (SELECT id, eom, eom_ret, pred, w, label FROM weights WHERE label IS NOT NULL),
months AS (SELECT eom, eom_ret, sum(w * label) AS ret, sum(w) AS net, sum(abs(w)) AS gross, count(*) FILTER (w > 0) AS n_long, count(*) FILTER (w < 0) AS n_short, count(*) AS universe FROM held GROUP BY ALL)"""
)


@query("w1_max_tie_rank", f"WITH {MONTHLY_SQL} SELECT id, eom, {_RANKED} FROM panel")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    out = ranks.ranked_panel(demo.monthly(spark, sf).select("id", "eom", "excntry", *FEATURES), FEATURES)
    return out.select("id", "eom", *[r(f).alias(f) for f in FEATURES])


@query("w1_min_obs_rank", f"WITH {MONTHLY_SQL} SELECT id, eom, CASE WHEN count(disc) OVER (PARTITION BY excntry, eom) >= 10 THEN round({_rank_sql('disc', 'excntry, eom')}, 8) ELSE 0 END AS disc FROM panel")
def w1_min_obs(spark: SparkSession, sf: str) -> DataFrame:
    out = ranks.ranked_panel(demo.monthly(spark, sf).select("id", "eom", "excntry", "disc"), ["disc"], min_obs=10)
    return out.select("id", "eom", r("disc").alias("disc"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Equal-weight composite of the ranked features."""
    keys = ["id", "eom", "eom_ret", "excntry", "label", "test"]
    out = ranks.ranked_panel(demo.monthly(spark, sf).select(*keys, *FEATURES), FEATURES)
    return out.select(*keys, F.round(sum((F.col(f) for f in FEATURES[1:]), F.col(FEATURES[0])) / 5, 8).alias("pred"))


@query("w3_forecast_percentile", f"WITH {_SCORED} SELECT id, eom, round(cume_dist() OVER (PARTITION BY excntry, eom ORDER BY pred) - 0.5, 8) AS pred FROM scored")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.forecast_percentiles(scored(spark, sf)).select("id", "eom", r("pred").alias("pred"))


_MEDIAN_X = "CASE WHEN tax = 0 THEN -0.5 WHEN tax IS NOT NULL THEN count(tax) OVER (PARTITION BY excntry, eom ORDER BY tax RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(count(tax) OVER (PARTITION BY excntry, eom) AS DOUBLE) - 0.5 END"


@query("w5_median_fill", f"WITH {MONTHLY_SQL}, x AS (SELECT id, eom, excntry, id % 2 AS half, {_MEDIAN_X} AS x FROM panel) SELECT id, eom, round(coalesce(x, median(x) OVER (PARTITION BY excntry, eom, half), median(x) OVER (PARTITION BY excntry, eom), 0), 8) AS tax FROM x")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    p = demo.monthly(spark, sf).select("id", "eom", "excntry", (F.col("id") % 2).alias("half"), "tax")
    return ranks.median_filled_ranks(p, ["tax"], "half").select("id", "eom", r("tax").alias("tax"))


@query("w10_last_rows", f"WITH {DAYS_SQL} SELECT id, date, ret_exc, age FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS age FROM days) WHERE age <= 20")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    return moments.aged(demo.days(spark, sf).withColumn("g", F.col("id")), "date", 20).select("id", "date", "ret_exc", "age")


@query("w14_trailing_year", f"WITH {CELLS_SQL}, m AS (SELECT eom, year(eom) * 12 + month(eom) AS m, avg(disc) AS g FROM cells GROUP BY ALL) SELECT eom, CASE WHEN count(*) OVER w = 12 THEN round(exp(sum(ln(1 + g)) OVER w) - 1, 8) END AS v FROM m WINDOW w AS (ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)")
def w14(spark: SparkSession, sf: str) -> DataFrame:
    m = demo.cells(spark, sf).groupBy("eom").agg(F.avg("disc").alias("g")).withColumn("m", month_number(F.col("eom")))
    w = Window.orderBy("m").rangeBetween(-11, 0)
    return m.select("eom", F.when(F.count("*").over(w) == 12, r(F.product(1 + F.col("g")).over(w) - 1)).alias("v"))


@query("sl3_argmin_ties", f"WITH {CELLS_SQL} SELECT eom, arg_min(id, (disc, id)) AS id FROM cells GROUP BY eom")
def sl3(spark: SparkSession, sf: str) -> DataFrame:
    return demo.cells(spark, sf).groupBy("eom").agg(F.min_by("id", F.struct("disc", "id")).alias("id"))


_FIRST, _LAST = 1992 * 12, 1998 * 12 + 11


@query("cv1_calendar_folds", f"WITH {CELLS_SQL} SELECT DISTINCT eom, CAST(least(4, (year(eom) * 12 + month(eom) - 1 - {_FIRST}) * 5 // {_LAST - _FIRST}) AS INTEGER) AS fold FROM cells")
def cv1(spark: SparkSession, sf: str) -> DataFrame:
    return demo.cells(spark, sf).select("eom").distinct().withColumn("fold", folds.calendar_fold(F.col("eom"), _FIRST, _LAST))


@query("cv2_usable_folds", f"WITH {CELLS_SQL}, m AS (SELECT DISTINCT eom FROM cells WHERE month(eom) <> 7), k AS (SELECT eom, row_number() OVER (ORDER BY eom) - 1 AS pos, count(*) OVER () AS n FROM m) SELECT eom, CAST(least(4, pos * 5 // greatest(1, n - 1)) AS INTEGER) AS fold FROM k")
def cv2(spark: SparkSession, sf: str) -> DataFrame:
    return folds.usable_folds(demo.cells(spark, sf).where("month(eom) <> 7").select("eom").distinct())


@query("cv4_capped_folds", f"WITH {CELLS_SQL} SELECT DISTINCT eom, CAST(least(6, (year(eom) * 12 + month(eom) - 1 - {_FIRST}) * 7 // {_LAST - _FIRST + 1}) AS INTEGER) AS fold FROM cells")
def cv4(spark: SparkSession, sf: str) -> DataFrame:
    return demo.cells(spark, sf).select("eom").distinct().withColumn("fold", folds.capped_fold(F.col("eom"), _FIRST, _LAST, width=12))


def calendar(rows: DataFrame) -> tuple[int, int]:
    """First and last month number."""
    return rows.agg(F.min(month_number(F.col("eom"))), F.max(month_number(F.col("eom")))).first()


_CALENDAR_SQL = f"WITH {CELLS_SQL}, m AS (SELECT DISTINCT eom, year(eom) * 12 + month(eom) - 1 AS m FROM cells), s AS (SELECT min(m) AS first, max(m) AS last FROM m)"


@query("cv1_panel_calendar_folds", f"{_CALENDAR_SQL} SELECT eom, CAST(least(4, (m - first) * 5 // greatest(1, last - first)) AS INTEGER) AS fold FROM m, s")
def cv1_panel(spark: SparkSession, sf: str) -> DataFrame:
    months = demo.cells(spark, sf).select("eom").distinct().persist()
    return months.withColumn("fold", folds.calendar_fold(F.col("eom"), *calendar(months)))


@query("cv4_panel_capped_folds", f"{_CALENDAR_SQL}, b AS (SELECT *, CAST(greatest(5, ceil((last - first + 1) / 12.0)) AS INTEGER) AS blocks FROM s) SELECT eom, CAST(least(blocks - 1, (m - first) * blocks // (last - first + 1)) AS INTEGER) AS fold FROM m, b")
def cv4_panel(spark: SparkSession, sf: str) -> DataFrame:
    months = demo.cells(spark, sf).select("eom").distinct().persist()
    return months.withColumn("fold", folds.capped_fold(F.col("eom"), *calendar(months), width=12))


@query("cv5_contiguous_blocks", f"WITH {CELLS_SQL} SELECT eom, CAST(ntile(5) OVER (ORDER BY eom) - 1 AS INTEGER) AS block FROM (SELECT DISTINCT eom FROM cells)")
def cv5(spark: SparkSession, sf: str) -> DataFrame:
    return folds.contiguous_blocks(demo.cells(spark, sf).select("eom").distinct())


@query("cv6_forward_folds", f"""WITH {MONTHLY_SQL}, m AS (SELECT DISTINCT eom, eom_ret FROM panel), k AS (SELECT *, row_number() OVER (ORDER BY eom) - 1 AS pos FROM m),
f AS (SELECT eom, CAST(ntile(5) OVER (ORDER BY eom) - 1 AS INTEGER) AS fold FROM k WHERE pos >= 24), s AS (SELECT fold, min(eom) AS start FROM f GROUP BY fold)
SELECT fold, eom, 'train' AS role FROM m JOIN s ON eom < start AND eom_ret <= start UNION ALL SELECT fold, eom, 'validate' FROM f""")
def cv6(spark: SparkSession, sf: str) -> DataFrame:
    return folds.forward_pairs(demo.monthly(spark, sf).select("eom", "eom_ret").distinct())


@query("cv7_security_folds", "SELECT s_suppkey AS id, CAST(s_suppkey % 5 AS INTEGER) AS fold FROM supplier")
def cv7(spark: SparkSession, sf: str) -> DataFrame:
    return demo.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), folds.security_fold(F.col("s_suppkey")).alias("fold"))


# --- moments -------------------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as a stream of factor vectors in the order of their ids."""
    e = demo.table(spark, sf, "embeddings").select(F.lit(0).alias("g"), "vec_id", F.col("embedding").cast("array<double>").alias("f"))
    return moments.aged(e, "vec_id").withColumn("market", F.element_at("f", 1) - F.element_at("f", 2))


_VECTORS = "v AS (SELECT *, row_number() OVER (ORDER BY vec_id DESC) AS age FROM (SELECT vec_id, embedding::DOUBLE[] AS f FROM embeddings))"


def _cov_sql(name: str, weight: str, source: str = "v", unbiased: bool = True) -> str:
    part = "(1 - sum(w * w) / (sum(w) * sum(w)))" if unbiased else "1"
    return f"""{name}_w AS (SELECT vec_id, f, {weight} AS w FROM {source}), {name}_u AS (SELECT vec_id, w, unnest(range(64)) AS i, unnest(f) AS x FROM {name}_w),
{name}_c AS (SELECT vec_id, w, i, x - (sum(w * x) OVER (PARTITION BY i)) / (sum(w) OVER (PARTITION BY i)) AS x FROM {name}_u),
{name} AS (SELECT a.i AS i, b.i AS j, sum(a.w * a.x * b.x) / sum(a.w) / {part.replace("w", "a.w") if unbiased else part} AS v FROM {name}_c a JOIN {name}_c b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL)"""


_COMBINE = """SELECT c.i, c.j, round(CASE WHEN ci.v * cj.v > 0 THEN c.v / sqrt(ci.v * cj.v) * sqrt(vi.v * vj.v) ELSE 0 END, 9) AS v
FROM cor c JOIN cor ci ON ci.i = c.i AND ci.j = c.i JOIN cor cj ON cj.i = c.j AND cj.j = c.j JOIN var vi ON vi.i = c.i AND vi.j = c.i JOIN var vj ON vj.i = c.j AND vj.j = c.j"""
_EXP = "power(0.5, age / {}.0)".format


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "i", "j", r("v", 9).alias("v"))


@query("rk6_weighted_covariance", f"WITH {_VECTORS}, {_cov_sql('cor', _EXP(84))} SELECT i, j, round(v, 9) AS v FROM cor")
def rk6(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(moments.covariance(vectors(spark, sf), moments.exponential(84)))


@query("rk7_factor_covariance", f"WITH {_VECTORS}, {_cov_sql('cor', _EXP(504))}, {_cov_sql('var', _EXP(84))} {_COMBINE}")
def rk7(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(moments.factor_covariance(vectors(spark, sf), moments.exponential(504), moments.exponential(84)))


@query(
    "rk9_ledoit_wolf",
    f"""WITH {_VECTORS}, {_cov_sql('emp', '1.0', unbiased=False)}, t AS (SELECT sum(CASE WHEN i = j THEN v END) AS trace, sum(CASE WHEN i = j THEN 1 ELSE 2 END * v * v) AS sq FROM emp),
q AS (SELECT avg(n2 * n2) AS fourth, count(*) AS n FROM (SELECT vec_id, sum(x * x) AS n2 FROM emp_c GROUP BY vec_id)),
a AS (SELECT trace, CASE WHEN sq - trace * trace / 64 <= 0 THEN 0 ELSE least(1, greatest(0, ((fourth - sq) / (64 * n)) / ((sq - trace * trace / 64) / 64))) END AS alpha FROM t, q)
SELECT i, j, round((1 - alpha) * v + CASE WHEN i = j THEN alpha * trace / 64 ELSE 0 END, 9) AS v, round(alpha, 9) AS intensity FROM emp, a""",
)
def rk9(spark: SparkSession, sf: str) -> DataFrame:
    return moments.ledoit_wolf(vectors(spark, sf)).select("i", "j", r("v", 9).alias("v"), r("intensity", 9).alias("intensity"))


@query("rk10_empirical_covariance", f"WITH {_VECTORS}, u AS (SELECT vec_id, unnest(range(64)) AS i, unnest(f) AS x FROM v) SELECT a.i, b.i AS j, round(covar_pop(a.x, b.x), 9) AS v FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def rk10(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(moments.covariance(vectors(spark, sf), unbiased=False))


@query("rk14_hyperbolic_covariance", f"WITH {_VECTORS}, {_cov_sql('cor', 'power(1 + age / (504 / (sqrt(2.0) - 1)), -2)')}, {_cov_sql('var', _EXP(84))} {_COMBINE}")
def rk14(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(moments.factor_covariance(vectors(spark, sf), moments.hyperbolic(504), moments.exponential(84)))


@query("rk13_hyperbolic_variance", f"WITH {_VECTORS}, {_cov_sql('cor', _EXP(504))}, {_cov_sql('var', '1 / (1 + age / 42.0)')} {_COMBINE}")
def rk13(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(moments.factor_covariance(vectors(spark, sf), moments.exponential(504), moments.hyperbolic(42, 1.0)))


@query("rk17_drawdown_conditioned", f"WITH {_VECTORS}, b AS (SELECT * FROM v WHERE 1 - (age % 20) / 100.0 <= 0.9), {_cov_sql('cor', _EXP(504), 'b')}, {_cov_sql('var', _EXP(84), 'b')} {_COMBINE}")
def rk17(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).withColumn("drawdown", (F.col("age") % 20) / F.lit(100.0))
    return _rounded(moments.drawdown_conditioned(rows, 0.3, 0.10, moments.exponential(504), moments.exponential(84)))


@query("rk18_downside_semimoment", f"WITH {_VECTORS}, u AS (SELECT vec_id, unnest(range(64)) AS i, least(unnest(f), 0) AS x FROM v) SELECT a.i, b.i AS j, round(sum(a.x * b.x) / (SELECT count(*) FROM v), 9) AS v FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def rk18(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(moments.second_moment(vectors(spark, sf), downside=True))


@query(
    "rk19_conditional_covariance",
    f"""WITH {_VECTORS}, neg AS (SELECT * FROM v WHERE f[1] - f[2] < 0), pos AS (SELECT * FROM v WHERE f[1] - f[2] >= 0), {_cov_sql('a', '1.0', 'v', False)}, {_cov_sql('n', '1.0', 'neg', False)}, {_cov_sql('p', '1.0', 'pos', False)},
o AS (SELECT 'all' AS state, * FROM a UNION ALL SELECT 'negative', * FROM n UNION ALL SELECT 'nonnegative', * FROM p UNION ALL SELECT 'balanced', n.i, n.j, (n.v + p.v) / 2 FROM n JOIN p ON n.i = p.i AND n.j = p.j) SELECT state, i, j, round(v, 9) AS v FROM o""",
)
def rk19(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(moments.conditional_covariances(vectors(spark, sf)), "state")


# --- risk ----------------------------------------------------------------------------------------------------------


@query("rk27_equal_weight_proxy", f"WITH {DAYS_SQL} SELECT date, round(avg(ret_exc), 8) AS ret, count(*) AS observed FROM days GROUP BY date")
def rk27(spark: SparkSession, sf: str) -> DataFrame:
    return risk.equal_weight_proxy(demo.days(spark, sf)).withColumn("ret", r("ret"))


@query(
    "rk28_cap_weight_proxy",
    f"""WITH {DAYS_SQL}, {CELLS_SQL}, j AS (SELECT d.*, c.capital FROM days d LEFT JOIN cells c ON c.id = d.id AND c.eom = CAST(date_trunc('month', d.date) AS DATE) - 1)
SELECT date, round(coalesce(sum(ret_exc * capital) / sum(capital), avg(ret_exc)), 8) AS ret, count(*) AS observed, count(capital) AS valid, round(count(capital) / count(*), 8) AS valid_fraction,
round(coalesce(sum(capital), 0), 2) AS capital, CASE WHEN count(capital) > 0 THEN 'market_cap' ELSE 'equal_no_valid_cap' END AS weighting FROM j GROUP BY date HAVING count(*) > 1""",
)
def rk28(spark: SparkSession, sf: str) -> DataFrame:
    out = risk.cap_weight_proxy(demo.days(spark, sf), demo.cells(spark, sf))
    return out.select("date", r("ret").alias("ret"), "observed", "valid", r("valid_fraction").alias("valid_fraction"), r("capital", 2).alias("capital"), "weighting")


_ST = {"seed": 10, "half_life": 20.0, "least": 20, "window": 1500}


@query(
    "st1_specific_volatility",
    f"""WITH {DAYS_SQL}, t AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM days)),
c AS (SELECT id, date, day, ret_exc AS res, row_number() OVER w - 1 AS c, lag(day, 20) OVER w AS old FROM days JOIN t USING (date) WINDOW w AS (PARTITION BY id ORDER BY date)),
v AS (SELECT *, CASE WHEN c >= 10 THEN sqrt(power(power(0.5, 1 / 20.0), c - 10) * sum(CASE WHEN c < 10 THEN res * res END) OVER w / 9
 + (1 - power(0.5, 1 / 20.0)) * power(power(0.5, 1 / 20.0), c - 11) * coalesce(sum(CASE WHEN c >= 10 THEN res * res * power(power(0.5, 1 / 20.0), 10 - c) END) OVER w, 0)) END AS vol
 FROM c WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, date, round(vol, 8) AS vol, coalesce(c >= 20 AND day >= 1500 AND old >= day - 1500 AND vol > 0, false) AS eligible FROM v""",
)
def st1(spark: SparkSession, sf: str) -> DataFrame:
    res = demo.days(spark, sf).withColumnRenamed("ret_exc", "res")
    return risk.specific_volatility(res, **_ST).withColumn("vol", r("vol"))


@query("rk1_exposures")
def rk1(spark: SparkSession, sf: str) -> DataFrame:
    return risk.exposures(demo.monthly(spark, sf), FEATURES, min_obs=3)


@query("rk2_daily_regressions")
def rk2(spark: SparkSession, sf: str) -> DataFrame:
    return risk.daily_regressions(demo.days(spark, sf), rk1(spark, sf))


# --- allocation and evaluation -------------------------------------------------------------------------------------


def decile_weights(spark: SparkSession, sf: str) -> DataFrame:
    return allocation.deciles(scored(spark, sf))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return demo.monthly(spark, sf).where("label IS NOT NULL").select("id", "eom", "eom_ret", "label")


def performance(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.monthly_performance(decile_weights(spark, sf), outcomes(spark, sf))


@query("al1_deciles", f"WITH {_WEIGHTED} SELECT id, eom, round(w, 8) AS w FROM weights")
def al1(spark: SparkSession, sf: str) -> DataFrame:
    return decile_weights(spark, sf).select("id", "eom", r("w").alias("w"))


@query("ev1_monthly_performance", f"WITH {_WEIGHTED} SELECT eom, eom_ret, round(ret, 12) AS ret, round(net, 8) AS net, round(gross, 8) AS gross, n_long, n_short, universe FROM months")
def ev1(spark: SparkSession, sf: str) -> DataFrame:
    return performance(spark, sf).select("eom", "eom_ret", r("ret", 12).alias("ret"), *[r(c).alias(c) for c in ("net", "gross")], "n_long", "n_short", "universe")


_TURNOVER = """, nx AS (SELECT eom, ret, lead(eom) OVER (ORDER BY eom) AS next_eom FROM months),
drift AS (SELECT h.id, next_eom AS eom, w * (1 + label) / (1 + ret) AS drift FROM held h JOIN nx USING (eom) WHERE next_eom IS NOT NULL),
turn AS (SELECT coalesce(h.eom, d.eom) AS eom, sum(abs(coalesce(w, 0) - coalesce(drift, 0))) AS turnover FROM held h FULL JOIN drift d ON h.id = d.id AND h.eom = d.eom GROUP BY 1)"""


@query("ev3_turnover", f"WITH {_WEIGHTED}{_TURNOVER} SELECT eom, round(turnover, 8) AS turnover FROM turn WHERE eom > (SELECT min(eom) FROM held)")
def ev3(spark: SparkSession, sf: str) -> DataFrame:
    out = outcomes(spark, sf)
    w = decile_weights(spark, sf).join(out.select("id", "eom"), ["id", "eom"], "left_semi")
    return evaluation.turnover(w, out).withColumn("turnover", r("turnover"))


@query("ev4_forecast_errors", f"WITH {_WEIGHTED} SELECT round(avg(power(label - pred, 2)), 8) AS mse, round(avg(label * label), 8) AS zero_mse, round(1 - avg(power(label - pred, 2)) / avg(label * label), 6) AS r2 FROM held")
def ev4(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.forecast_errors(scored(spark, sf).select("id", "eom", "pred"), outcomes(spark, sf))
    return out.select(r("mse").alias("mse"), r("zero_mse").alias("zero_mse"), r("r2", 6).alias("r2"))


@query("ev5_annual_statistics", f"WITH {_WEIGHTED} SELECT count(*) AS months, round(avg(ret) * 12, 8) AS mean_annual, round(stddev_samp(ret) * sqrt(12), 8) AS volatility_annual, round(avg(ret) * 12 / (stddev_samp(ret) * sqrt(12)), 6) AS sharpe_annual, round(avg(universe), 6) AS average_universe, round(avg(n_long + n_short), 6) AS average_holdings, round(avg(gross), 8) AS gross_leverage, round(max(abs(net)), 8) AS maximum_absolute_net FROM months")
def ev5(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.annual_statistics(performance(spark, sf))
    return out.select("months", *[r(c, 6 if "average" in c or "sharpe" in c else 8).alias(c) for c in out.columns[1:]])


@query("ev6_drawdowns", f"WITH {_WEIGHTED}, l AS (SELECT eom, product(1 + ret * 0.1) OVER (ORDER BY eom) AS level FROM months), p AS (SELECT *, greatest(1, max(level) OVER (ORDER BY eom)) AS peak FROM l) SELECT eom, round(level, 8) AS level, round(peak, 8) AS peak, round(1 - level / peak, 8) AS drawdown, round(coalesce(lag(1 - level / peak) OVER (ORDER BY eom), 0), 8) AS drawdown_before FROM p")
def ev6(spark: SparkSession, sf: str) -> DataFrame:
    m = performance(spark, sf).select("eom", (F.col("ret") * 0.1).alias("ret"))
    return evaluation.drawdowns(m).select("eom", *[r(c).alias(c) for c in ("level", "peak", "drawdown", "drawdown_before")])


_BANK = """, q AS (SELECT unnest([0.0, 0.1, 1.0]) AS q), bank AS (SELECT eom, eom_ret, q, ret * (1 - q / 4) + q * net * net / 50 AS markowitz FROM months, q)"""


@query(
    "al8_penalty_selection",
    f"""WITH {_WEIGHTED}{_BANK}, f AS (SELECT DISTINCT eom AS formation FROM months),
r AS (SELECT formation, q, eom_ret, markowitz, row_number() OVER (PARTITION BY formation, q ORDER BY eom_ret DESC) AS k FROM f JOIN bank ON eom_ret <= formation),
b AS (SELECT *, ntile(5) OVER (PARTITION BY formation, q ORDER BY eom_ret) AS block, count(*) OVER (PARTITION BY formation, q) AS n FROM r WHERE k <= 30),
s AS (SELECT formation, q, block, var_samp(markowitz) AS v FROM b WHERE n >= 10 GROUP BY ALL), t AS (SELECT formation, q, avg(v) AS score FROM s GROUP BY ALL HAVING count(v) = 5),
c AS (SELECT formation, arg_min(q, (score, q)) AS q, min(score) AS score FROM t GROUP BY formation)
SELECT formation, CAST(coalesce(c.q, 0) AS DOUBLE) AS q, round(score, 10) AS score FROM f LEFT JOIN c USING (formation)""",
)
def al8(spark: SparkSession, sf: str) -> DataFrame:
    m = performance(spark, sf)
    q = F.explode(F.array(*map(F.lit, (0.0, 0.1, 1.0))))
    bank = m.withColumn("q", q).select("eom", "eom_ret", "q", (F.col("ret") * (1 - F.col("q") / 4) + F.col("q") * F.col("net") * F.col("net") / 50).alias("markowitz"))
    out = allocation.selected_penalties(bank, m.select(F.col("eom").alias("formation")).distinct(), "markowitz", "variance", months=30)
    return out.withColumn("score", r("score", 10))


@query(
    "al11_timed_weights",
    f"""WITH {_WEIGHTED}, {DAYS_SQL}, px AS (SELECT last_day(date) AS eom, product(1 + r) AS g FROM (SELECT date, avg(ret_exc) AS r FROM (SELECT date, ret_exc * CASE WHEN id % 2 = 0 THEN 1 ELSE -0.5 END AS ret_exc FROM days) GROUP BY date) GROUP BY 1),
sg AS (SELECT eom, CASE WHEN count(*) OVER w = 12 THEN exp(sum(ln(g)) OVER w) - 1 END AS signal FROM (SELECT *, year(eom) * 12 + month(eom) AS m FROM px) WINDOW w AS (ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT id, eom, round(w * CASE WHEN signal < 0 THEN 0.5 ELSE 1 END, 8) AS w FROM weights LEFT JOIN sg USING (eom)""",
)
def al11(spark: SparkSession, sf: str) -> DataFrame:
    d = demo.days(spark, sf).withColumn("ret_exc", F.col("ret_exc") * F.when(F.col("id") % 2 == 0, 1.0).otherwise(-0.5))
    return allocation.timed(decile_weights(spark, sf), risk.equal_weight_proxy(d)).withColumn("w", r("w"))


# --- iterative and dense ones, which SQL can't express ---------------------------------------------------------------


def forecast_years(rows: DataFrame, date: str = "eom") -> list[int]:
    """All forecast years of the rows' months."""
    return [y for (y,) in rows.select(forecast_year(F.col(date)).alias("year")).distinct().orderBy("year").collect()]


@query("fc5_walk_forward_ridge")
def fc5(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ridge

    keys = ["id", "eom", "eom_ret", "excntry", "label"]
    p = ranks.ranked_panel(demo.monthly(spark, sf).select(*keys, *FEATURES), FEATURES).persist()
    return ridge.walk_forward(p, FEATURES, forecast_years(p))


@query("rk24_section_penalties")
def rk24(spark: SparkSession, sf: str) -> DataFrame:
    days = demo.days(spark, sf).persist()
    return risk.searched_section_penalties(days, rk1(spark, sf), forecast_years(days, "date"))


@query("rk17_drawdown_states", f"WITH {DAYS_SQL}, px AS (SELECT date, avg(ret_exc * ret_exc) - 0.0001 AS ret FROM days GROUP BY date), l AS (SELECT date, ret, product(1 + ret) OVER (ORDER BY date) AS level FROM px), p AS (SELECT *, greatest(1, max(level) OVER (ORDER BY date)) AS peak FROM l) SELECT date, round(ret, 8) AS ret, round(coalesce(lag(1 - level / peak) OVER (ORDER BY date), 0), 8) AS drawdown FROM p")
def rk17_states(spark: SparkSession, sf: str) -> DataFrame:
    d = demo.days(spark, sf).withColumn("ret_exc", F.col("ret_exc") * F.col("ret_exc"))
    proxy = risk.equal_weight_proxy(d).withColumn("ret", F.col("ret") - 0.0001)
    return risk.drawdown_states(proxy).select("date", r("ret").alias("ret"), r("drawdown").alias("drawdown"))


@query("flagship_weights")
def flagship_weights(spark: SparkSession, sf: str) -> DataFrame:
    from . import flagship

    s = flagship.Settings(correlation_half_life=120, variance_half_life=60, seed=10, least_residuals=20, min_obs=2)
    return flagship.weights(demo.monthly(spark, sf).persist(), FEATURES, demo.days(spark, sf), s)
