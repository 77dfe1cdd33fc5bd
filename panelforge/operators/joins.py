"""Joins with the checks and clocks of the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_number
from ..sources.panel import check_unique


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new ids. A table that a Python function made gets other ids where it meets itself in a
    join, and its cached rows aren't found by them; with a projection on top, only that one changes."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def joined_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    check_unique(left, keys)
    check_unique(right, keys)
    return left.join(right, keys, how)


def uncovered(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side that the other lacks, with the side that has them."""
    a, b = expected.select(*keys).distinct(), got.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("expected")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("got")))


def lagged(left: DataFrame, right: DataFrame, by: list[str], values: list[str], months: int = 1, prefix: str = "lag_") -> DataFrame:
    """left with right's values of exactly `months` calendar months before; rows without that month go."""
    earlier = right.select(*by, (month_number(F.col("eom")) + months).alias("__m"), *[F.col(v).alias(f"{prefix}{v}") for v in values])
    return left.withColumn("__m", month_number(F.col("eom"))).join(earlier, [*by, "__m"]).drop("__m")


def on_formation(days: DataFrame, months: DataFrame, by: list[str]) -> DataFrame:
    """Day rows with the values formed at the end of the month before."""
    return days.withColumn("eom_ret", F.last_day("date")).join(months, [*by, "eom_ret"])


def as_of(left: DataFrame, right: DataFrame, time: str, right_time: str, value: Column | str, by: list[str] | None = None, out: str = "as_of") -> DataFrame:
    """left with right's latest value at or before its time: both are put in one order and the last value is carried
    on, so each key is sorted once and no pair of rows is formed."""
    from pyspark.sql.window import Window

    by = by or []
    value = F.col(value) if isinstance(value, str) else value
    bare = right.select(*by, F.col(right_time).alias(time), value.alias(out), F.lit(0).alias("__side"))
    both = left.withColumn("__side", F.lit(1)).unionByName(bare, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(out, F.last(out, ignorenulls=True).over(order)).where("__side = 1").drop("__side")


def combined(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join with missing values as 0."""
    return left.join(right, keys, "full").fillna(0.0, values)


def required(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """df, whose rows raise when read if one of the columns is null: a check that costs no job of its own."""
    return df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{what}: {c} is missing"))) for c in columns})


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], what: str = "lookup") -> DataFrame:
    """Left join that raises where a row finds no value: keys of right are unique, so rows stay as they are."""
    check_unique(right, keys)
    return required(left.join(right.select(*keys, *values), keys, "left"), values, what)


def with_codes(panel: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that attaches a classifier code; rows without one go."""
    check_unique(codes, keys)
    return panel.join(codes, keys)


def dated(rows: DataFrame, by_date: DataFrame) -> DataFrame:
    """Left join on the date, one row a date on the right, which is small: a calendar's worth."""
    check_unique(by_date, ["date"])
    return rows.join(F.broadcast(by_date), "date", "left")


def same_keys(keys: list[str], *frames: DataFrame) -> None:
    """Raises unless all have the same unique keys."""
    first = frames[0]
    for df in frames:
        check_unique(df, keys)
        if df is not first and not uncovered(first, df, keys).isEmpty():
            raise ValueError(f"{keys} must be the same in all tables")
