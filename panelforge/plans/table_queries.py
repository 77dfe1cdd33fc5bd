"""Queries of joins with checks, set operations, scalar functions, grids, sinks and stored models."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import iso_text, parsed_date
from ..functions.normal import ndtri
from ..operators import allocation, joins, ranks, ridge
from ..sources import demo, panel, store
from ..sources.demo import CELLS_SQL, DAYS_SQL, FEATURES, MONTHLY_SQL
from .queries import _SCORED, forecast_years, query, r, scored


def _scratch(spark: SparkSession) -> str:
    """A new folder in the warehouse, which all machines share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{uuid.uuid4().hex}"


@query("j1_attached_code", f"WITH {CELLS_SQL} SELECT id, eom, qty, CAST(100 + id * 97 % 8900 AS VARCHAR) AS sic FROM cells WHERE id % 3 <> 0")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    c = demo.cells(spark, sf).select("id", "eom", "qty")
    codes = demo.monthly(spark, sf).where("id % 3 <> 0").select("id", "eom", "sic")
    return joins.with_codes(c, codes, ["id", "eom"])


@query("j2_one_to_one", f"WITH {_SCORED} SELECT s.id, s.eom, pred, s.label FROM scored s WHERE s.label IS NOT NULL")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return joins.joined_one_to_one(s.select("id", "eom", "pred"), s.where("label IS NOT NULL").select("id", "eom", "label"), ["id", "eom"])


@query("j3_looked_up", f"WITH {_SCORED} SELECT s.id, s.eom, qty, pred FROM scored s JOIN panel p ON p.id = s.id AND p.eom = s.eom")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    c = demo.monthly(spark, sf).select("id", "eom", "qty")
    return joins.looked_up(c, scored(spark, sf), ["id", "eom"], ["pred"], "forecast")


@query("j4_left_one_to_one", f"WITH {_SCORED} SELECT s.id, s.eom, pred, CASE WHEN id % 2 = 0 THEN label END AS label FROM scored s")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return joins.joined_one_to_one(s.select("id", "eom", "pred"), s.where("id % 2 = 0").select("id", "eom", "label"), ["id", "eom"], "left")


@query("j5_dated", f"WITH {DAYS_SQL}, m AS (SELECT date, avg(ret_exc * ret_exc) AS market FROM days WHERE date < DATE '1999-01-01' GROUP BY date) SELECT id, date, round(market, 9) AS market FROM days LEFT JOIN m USING (date)")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    d = demo.days(spark, sf)
    market = d.where("date < DATE '1999-01-01'").groupBy("date").agg(F.avg(F.col("ret_exc") * F.col("ret_exc")).alias("market"))
    return joins.dated(d, market).select("id", "date", r("market", 9).alias("market"))


@query("j13_same_keys", f"WITH {CELLS_SQL} SELECT id, eom, qty FROM cells")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    c = demo.cells(spark, sf).select("id", "eom", "qty")
    joins.same_keys(["id", "eom"], c, scored(spark, sf), demo.monthly(spark, sf))
    return c


@query("so2_missing_columns", "SELECT unnest(['b', 'd']) AS name")
def so2(spark: SparkSession, sf: str) -> DataFrame:
    raw = demo.table(spark, sf, "region").withColumns({"a": F.lit(1), "c": F.lit(2)})
    return spark.createDataFrame([(c,) for c in panel.missing_columns(raw, ["a", "b", "c", "d"])], "name string")


@query("so4_differences", f"WITH {CELLS_SQL}, a AS (SELECT id, eom, qty FROM cells), b AS (SELECT id, eom, CASE WHEN id % 10 = 0 THEN qty + 1 ELSE qty END AS qty FROM cells) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def so4(spark: SparkSession, sf: str) -> DataFrame:
    a = demo.cells(spark, sf).select("id", "eom", "qty")
    return store.differences(a, a.withColumn("qty", F.when(F.col("id") % 10 == 0, F.col("qty") + 1).otherwise(F.col("qty"))))


@query("fn_iso_dates", "SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS text, d AS date, strftime(d, '%Y-%m-%d') LIKE '1996-%' AS in_1996 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def fn_iso_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = demo.table(spark, sf, "orders").select("o_orderkey", iso_text(F.col("o_orderdate").cast("date")).alias("text"))
    return o.select("o_orderkey", "text", parsed_date(F.col("text")).alias("date"), F.startswith("text", F.lit("1996-")).alias("in_1996"))


@query("fn_row_hash", "SELECT c_custkey, sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR))) AS digest FROM customer")
def fn_row_hash(spark: SparkSession, sf: str) -> DataFrame:
    return demo.table(spark, sf, "customer").select("c_custkey", store.row_digest("c_custkey", "c_name", "c_nationkey").alias("digest"))


@query("fn_json_records", "SELECT c_custkey, '{\"key\":' || c_custkey || ',\"name\":\"' || c_name || '\"}' AS record, c_name AS name FROM customer")
def fn_json(spark: SparkSession, sf: str) -> DataFrame:
    c = demo.table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))).alias("record"))
    return c.withColumn("name", F.from_json("record", "key long, name string")["name"])


@query("fn_ndtri")
def fn_ndtri(spark: SparkSession, sf: str) -> DataFrame:
    return demo.table(spark, sf, "part").select("p_partkey", ndtri(F.pmod(F.col("p_partkey") * 37, F.lit(1000)) / 1000).alias("z"))


def _grid(spark: SparkSession, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(round(float(v), 10),) for v in values], "q double")


_GEO = "power(10.0, -8 + 8 * k / {}.0)".format


@query("g1_ridge_grid", f"SELECT DISTINCT round(q, 10) AS q FROM (SELECT CAST(range AS DOUBLE) AS q FROM range(1, 10001) UNION ALL SELECT {_GEO(999)} FROM range(1000) t(k) UNION ALL SELECT unnest([1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0]))")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, ridge.WIDE).distinct()


@query("g3_allocation_grid", "SELECT 0.0::DOUBLE AS q UNION ALL SELECT round(power(10.0, -5 + k / 2.0), 10) FROM range(15) t(k)")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, np.array(allocation.PENALTIES))


@query("g4_wide_allocation_grid", f"SELECT DISTINCT round(q, 10) AS q FROM (SELECT 0.0::DOUBLE AS q UNION ALL SELECT {_GEO(199)} FROM range(200) t(k) UNION ALL SELECT CAST(range AS DOUBLE) FROM range(1, 10001) UNION ALL SELECT power(10.0, -5 + k / 2.0) FROM range(15) t(k))")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, allocation.wide_grid()).distinct()


@query("g5_designs")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import trees

    return spark.createDataFrame([(k, *d) for k, d in enumerate(trees.DESIGNS)], "k int, columns double, depth int, penalty double, rows double")


@query("io3_polymorphic_ingest", "SELECT 'arrow' AS kind, n_nationkey, n_name FROM nation UNION ALL SELECT 'pandas', n_nationkey, n_name FROM nation UNION ALL SELECT 'parquet', n_nationkey, n_name FROM nation UNION ALL SELECT 'spark', n_nationkey, n_name FROM nation")
def io3(spark: SparkSession, sf: str) -> DataFrame:
    n = demo.table(spark, sf, "nation").select("n_nationkey", "n_name")
    forms = {"spark": n, "pandas": n.toPandas(), "arrow": n.toArrow(), "parquet": f"{sf}/nation.parquet"}
    out = [panel.ingest(spark, x).select(F.lit(k).alias("kind"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name") for k, x in forms.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("io9_csv_sink", f"WITH {_SCORED} SELECT id, eom, pred AS w FROM scored")
def io9(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark)
    panel.write_csv(scored(spark, sf).select("id", "eom", F.col("pred").alias("w")), path)
    return spark.read.csv(path, header=True, schema="id long, eom date, w double")


@query("io10_month_sink", f"WITH {CELLS_SQL} SELECT id, eom, qty, disc FROM cells WHERE eom >= DATE '1996-01-31'")
def io10(spark: SparkSession, sf: str) -> DataFrame:
    """Parquet by month (zstd), read back with a predicate that prunes partitions."""
    path = _scratch(spark)
    panel.write_months(demo.cells(spark, sf).select("id", "eom", "qty", "disc"), path)
    return spark.read.parquet(path).where("eom >= DATE '1996-01-31'").select("id", "eom", "qty", "disc")


@query("io12_array_bundle", f"WITH {MONTHLY_SQL} SELECT id, eom, round(qty / 64, 9) AS b0, round(disc, 9) AS b1 FROM panel")
def io12(spark: SparkSession, sf: str) -> DataFrame:
    """A month of exposures in a row, as arrays, stored and read again."""
    m = demo.monthly(spark, sf).select("id", "eom", F.array(F.col("qty") / 64, F.col("disc")).alias("b"))
    s = store.Store(spark, _scratch(spark))
    s.write("exposures", store.bundled(m, ["id", "b"]), {"panel": "demo"})
    back = store.unbundled(s.read("exposures", {"panel": "demo"}, verify=True), ["id", "b"])
    return back.select("id", "eom", r(F.col("b")[0], 9).alias("b0"), r(F.col("b")[1], 9).alias("b1"))


@query("io14_stored_models")
def io14(spark: SparkSession, sf: str) -> DataFrame:
    """Each year's Ridge fit written, read again and applied."""
    keys = ["id", "eom", "eom_ret", "excntry", "label"]
    p = ranks.ranked_panel(demo.monthly(spark, sf).select(*keys, *FEATURES), FEATURES).persist()
    path = _scratch(spark)
    store.write_models(ridge.yearly_fits(p, FEATURES, forecast_years(p)), path)
    return ridge.applied(p, FEATURES, store.read_models(spark, path))


@query("pv2_stage_manifests", f"WITH {CELLS_SQL} SELECT id, eom, qty FROM cells")
def pv2(spark: SparkSession, sf: str) -> DataFrame:
    s = store.Store(spark, _scratch(spark))
    return s.get("cells", {"table": "lineitem"}, lambda: demo.cells(spark, sf).select("id", "eom", "qty"))
