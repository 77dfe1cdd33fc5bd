"""Validation folds as columns over small tables of months."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import month_number


def calendar_fold(d: Column, first: int, last: int, folds: int = 5) -> Column:
    """Blocks of the calendar from month number first to last: all months count, present or not."""
    span = max(1, last - first)
    return F.least(F.lit(folds - 1), F.floor((month_number(d) - first) * folds / F.lit(span)).cast("int"))


def usable_folds(months: DataFrame, folds: int = 5, column: str = "eom") -> DataFrame:
    """Blocks of the months that are there, by their place; no more folds than months."""
    place = Window.orderBy(column)  # one row a month
    whole = Window.partitionBy()
    n = F.count("*").over(whole)
    k = F.least(F.lit(folds), n)
    at = F.row_number().over(place) - 1
    return months.withColumn("fold", F.least(k - 1, F.floor(at * k / F.greatest(F.lit(1), n - 1))).cast("int"))


def capped_blocks(first: int, last: int, width: int = 96, least: int = 5) -> int:
    """How many equal calendar blocks a span needs so that none is wider than `width` months."""
    return max(least, math.ceil((last - first + 1) / width))


def capped_fold(d: Column, first: int, last: int, width: int = 96, least: int = 5) -> Column:
    blocks, span = capped_blocks(first, last, width, least), last - first + 1
    return F.least(F.lit(blocks - 1), F.floor((month_number(d) - first) * blocks / F.lit(span)).cast("int"))


def contiguous_blocks(months: DataFrame, blocks: int = 5, column: str = "eom") -> DataFrame:
    return months.withColumn("block", F.ntile(blocks).over(Window.orderBy(column)) - 1)


def forward_pairs(months: DataFrame, burn: int = 24, folds: int = 5) -> DataFrame:
    """(fold, eom, role): each later block is validated with the months before it whose returns it knows."""
    at = F.row_number().over(Window.orderBy("eom")) - 1
    placed = months.withColumn("at", at).withColumn("fold", F.when(F.col("at") >= burn, F.ntile(folds).over(Window.partitionBy((F.col("at") >= burn)).orderBy("eom")) - 1))
    starts = placed.where("fold IS NOT NULL").groupBy("fold").agg(F.min("eom").alias("start"))
    train = placed.drop("fold").join(F.broadcast(starts), (F.col("eom") < F.col("start")) & (F.col("eom_ret") <= F.col("start"))).select("fold", "eom", F.lit("train").alias("role"))
    return train.unionByName(placed.where("fold IS NOT NULL").select("fold", "eom", F.lit("validate").alias("role")))


def security_fold(id_: Column, folds: int = 5) -> Column:
    return F.pmod(id_, F.lit(folds)).cast("int")


def bootstrap_months(months: list, anchor: int, bag: int, block: int = 3, seed: int = 1) -> list:
    """Circular blocks of months, as many as there are; each anchor (a month number) and bag has draws of its own."""
    import numpy as np

    n = len(months)
    if not n:
        return []
    rng = np.random.default_rng(np.random.SeedSequence([seed, anchor, bag]))
    starts = rng.integers(0, n, size=-(-n // block))
    return [months[(s + k) % n] for s in starts for k in range(block)][:n]


def expanding_fold(d: Column, last: Column, first: int, folds: int = 5) -> Column:
    """Blocks of the calendar from the first month to the latest one known, a column: the span grows with it."""
    span = F.greatest(F.lit(1), last - first)
    return F.least(F.lit(folds - 1), F.floor((month_number(d) - first) * folds / span).cast("int"))
