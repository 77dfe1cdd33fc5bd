"""Tables of the data model: ingest, canonical projections, checks, partial loads, sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import is_month_end, next_month_end
from ..functions.values import finite, flag, present

META = ["id", "eom", "eom_ret", "excntry", "test", "label"]
KEYS = ["id", "eom"]


def ingest(spark: SparkSession, data: object) -> DataFrame:
    """A DataFrame from a DataFrame, a Parquet path, a pandas frame or an Arrow table."""
    import pandas as pd
    import pyarrow as pa

    if isinstance(data, DataFrame):
        return data
    if isinstance(data, str):
        return spark.read.parquet(data)
    if isinstance(data, pd.DataFrame | pa.Table):
        return spark.createDataFrame(data)
    raise TypeError(f"can't read a table from {type(data).__name__}")


def feature_list(features: DataFrame, column: str = "features") -> list[str]:
    """Distinct sorted names; they are columns, so there are few."""
    names = [r[0] for r in features.select(column).distinct().orderBy(column).collect()]
    if not names or set(names) & set(META):
        raise ValueError("feature names must be given and differ from the metadata")
    return names


def missing_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    return sorted(set(wanted) - set(df.columns))


def canonical(raw: DataFrame, features: Iterable[str], test: str = "test", label: str = "label") -> DataFrame:
    """The characteristics table by projection: types as the model has them, NaN as null."""
    features = list(features)
    if missing := missing_columns(raw, ["id", "eom", "eom_ret", "excntry", test, label, *features]):
        raise ValueError(f"missing columns: {missing}")
    meta = [F.col("id").cast("long").alias("id"), F.col("eom").cast("date").alias("eom"), F.col("eom_ret").cast("date").alias("eom_ret"), F.col("excntry").cast("string").alias("excntry")]
    return raw.select(*meta, flag(F.col(test)).alias("test"), present(F.col(label)).alias("label"), *[present(F.col(f)).alias(f) for f in features])


def daily(raw: DataFrame, value: str = "ret_exc") -> DataFrame:
    """(id, date, value) without values that aren't finite."""
    return raw.select(F.col("id").cast("long").alias("id"), F.col("date").cast("date").alias("date"), F.col(value).cast("double").alias(value)).where(finite(F.col(value)))


def check_panel(panel: DataFrame) -> None:
    """Raises unless keys are whole and unique, months end where they should, and returns follow in the next month."""
    one = panel.agg(
        F.count_if(F.col("id").isNull() | F.col("eom").isNull() | F.col("eom_ret").isNull() | F.col("excntry").isNull() | F.col("test").isNull()).alias("nulls"),
        F.count_if(~is_month_end(F.col("eom")) | (F.col("eom_ret") != next_month_end(F.col("eom")))).alias("months"),
    ).first()
    if one["nulls"]:
        raise ValueError("null metadata")
    if one["months"]:
        raise ValueError("months must be consecutive month ends")
    check_unique(panel, KEYS)


def check_unique(df: DataFrame, keys: list[str]) -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{keys} must be unique")


def month(panel: DataFrame, eom: dt.date) -> DataFrame:
    """One month; the predicate reaches the scan, or the partitions where the table is laid out by month."""
    return panel.where(F.col("eom") == F.lit(eom))


def month_to_date(days: DataFrame, d: dt.date) -> DataFrame:
    return days.where(F.col("date").between(F.trunc(F.lit(d), "MM"), F.lit(d)))


def metadata(panel: DataFrame) -> DataFrame:
    return panel.select(*META)


def formation_of_return(panel: DataFrame) -> DataFrame:
    """eom_ret -> eom, one row a month."""
    return panel.select("eom_ret", "eom").distinct()


def write_months(df: DataFrame, path: str) -> None:
    """Parquet by month, a month's rows in one task's files."""
    df.repartition("eom").sortWithinPartitions("eom", "id").write.mode("overwrite").option("compression", "zstd").partitionBy("eom").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Sorted output for people, in one file: results are small."""
    df.orderBy("eom", "id").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
