"""Panels derived from star-schema tables: suppliers as entities, calendar months of shipments as cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import month_number, next_month_end

FEATURES = ["qty", "price", "disc", "tax", "returned"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (id, eom): features, with true zeros in `disc` and nulls in `tax`, and the capital."""
    lines = table(spark, sf_dir, "lineitem")
    eom = F.last_day(F.col("l_shipdate").cast("date"))
    grouped = lines.groupBy(F.col("l_suppkey").alias("id"), eom.alias("eom"))
    return grouped.agg(
        F.sum("l_quantity").alias("qty"),
        F.round(F.avg("l_extendedprice"), 6).alias("price"),
        F.min("l_discount").alias("disc"),
        F.nullif(F.max("l_tax"), F.lit(0.08)).alias("tax"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"),
        F.round(F.sum("l_extendedprice"), 6).alias("capital"),
    )


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells with metadata; the label is the next calendar month's change of the mean price, null where that month
    isn't there; the last year is for tests."""
    base = cells(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    suppliers = suppliers.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("excntry"))
    by = Window.partitionBy("id").orderBy("eom")
    follows = month_number(F.lead("eom").over(by)) == month_number(F.col("eom")) + 1
    label = F.when(follows, F.round(F.lead("price").over(by) / F.col("price") - 1, 8))
    sic = (F.lit(100) + F.col("id") * 97 % 8900).cast("string")
    out = base.withColumn("label", label).join(suppliers, "id").withColumn("sic", sic)
    return out.withColumn("eom_ret", next_month_end(F.col("eom"))).withColumn("test", F.col("eom") >= F.lit("1998-01-01").cast("date"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, date, ret_exc): a supplier-day's mean discounted price, in whole hundredths of cents, against the day's mean,
    scaled. Sums are of whole numbers, so no order of rows can change a value."""
    lines = table(spark, sf_dir, "lineitem")
    price = F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))
    mean = lines.groupBy(F.col("l_suppkey").alias("id"), F.col("l_shipdate").cast("date").alias("date")).agg(F.round(F.sum(price) / F.count("*")).cast("long").alias("v"))
    day = Window.partitionBy("date")
    return mean.select("id", "date", ((F.col("v") - F.sum("v").over(day) / F.count("*").over(day)) / 1e10).alias("ret_exc"))


#: The same panels for the oracle.
CELLS_SQL = """
cells AS (SELECT l_suppkey AS id, last_day(CAST(l_shipdate AS DATE)) AS eom, sum(l_quantity) AS qty, round(avg(l_extendedprice), 6) AS price,
  min(l_discount) AS disc, nullif(max(l_tax), 0.08) AS tax, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS returned,
  round(sum(l_extendedprice), 6) AS capital FROM lineitem GROUP BY ALL)"""
MONTHLY_SQL = (
    CELLS_SQL
    + """,
led AS (SELECT *, lead(price) OVER w AS next_price, lead(eom) OVER w AS next_eom FROM cells WINDOW w AS (PARTITION BY id ORDER BY eom)),
panel AS (SELECT led.* EXCLUDE (next_price, next_eom),
  CASE WHEN next_eom = last_day(CAST(eom + INTERVAL 1 DAY AS DATE)) THEN round(next_price / price - 1, 8) END AS label,
  'R' || CAST(n_regionkey AS VARCHAR) AS excntry, CAST(100 + id * 97 % 8900 AS VARCHAR) AS sic,
  last_day(CAST(eom + INTERVAL 1 DAY AS DATE)) AS eom_ret, eom >= DATE '1998-01-01' AS test
  FROM led JOIN supplier ON s_suppkey = id JOIN nation ON n_nationkey = s_nationkey)"""
)
DAYS_SQL = """
dm AS (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS date, CAST(round(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM lineitem GROUP BY ALL),
days AS (SELECT id, date, (v - CAST(sum(v) OVER (PARTITION BY date) AS DOUBLE) / count(*) OVER (PARTITION BY date)) / 1e10 AS ret_exc FROM dm)"""
