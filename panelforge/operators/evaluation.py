"""Portfolio evaluation: monthly returns, drift, turnover, forecast errors, annual statistics, drawdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import combined, joined_one_to_one, uncovered


def monthly_performance(weights: DataFrame, outcomes: DataFrame) -> DataFrame:
    """weights (id, eom, w) with outcomes (id, eom, eom_ret, label): a row a month."""
    joined = weights.join(outcomes, ["id", "eom"])
    return joined.groupBy("eom", "eom_ret").agg(
        F.sum(F.col("w") * F.col("label")).alias("ret"),
        F.sum("w").alias("net"),
        F.sum(F.abs("w")).alias("gross"),
        F.count_if(F.col("w") > 0).alias("n_long"),
        F.count_if(F.col("w") < 0).alias("n_short"),
        F.count("*").alias("universe"),
    )


def drifted(weights: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, eom, drift): a month's weights after its returns, at the next month that has a portfolio."""
    joined = weights.join(outcomes, ["id", "eom"])
    months = joined.groupBy("eom").agg(F.sum(F.col("w") * F.col("label")).alias("__ret"))
    months = months.withColumn("__next", F.lead("eom").over(Window.orderBy("eom"))).where("__next IS NOT NULL")  # a row a month
    return joined.join(F.broadcast(months), "eom").select("id", F.col("__next").alias("eom"), (F.col("w") * (1 + F.col("label")) / (1 + F.col("__ret"))).alias("drift"))


def turnover(weights: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(eom, turnover) for all months but the first."""
    both = combined(weights.select("id", "eom", "w"), drifted(weights, outcomes), ["id", "eom"], ["w", "drift"])
    out = both.groupBy("eom").agg(F.sum(F.abs(F.col("w") - F.col("drift"))).alias("turnover"))
    return out.withColumn("__first", F.min("eom").over(Window.partitionBy())).where("eom > __first").drop("__first")


def drawdowns(months: DataFrame, value: str = "ret", order: str = "eom", keys: list[str] | None = None) -> DataFrame:
    """Level, peak (1 at least) and drawdown before and after each return."""
    w = Window.partitionBy(*(keys or [])).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = months.withColumn("level", F.product(1 + F.col(value)).over(upto))
    out = out.withColumn("peak", F.greatest(F.lit(1.0), F.max("level").over(upto))).withColumn("drawdown", 1 - F.col("level") / F.col("peak"))
    return out.withColumn("drawdown_before", F.coalesce(F.lag("drawdown").over(w), F.lit(0.0)))


def forecast_errors(preds: DataFrame, outcomes: DataFrame) -> DataFrame:
    joined = preds.join(outcomes, ["id", "eom"])
    errors = joined.agg(F.avg(F.pow(F.col("label") - F.col("pred"), 2)).alias("mse"), F.avg(F.pow("label", F.lit(2.0))).alias("zero_mse"))
    return errors.withColumn("r2", F.when(F.col("zero_mse") != 0, 1 - F.col("mse") / F.col("zero_mse")))


def annual_statistics(months: DataFrame) -> DataFrame:
    """One row from monthly performance (with turnover, if it is there)."""
    sd = F.stddev_samp("ret") * F.sqrt(F.lit(12.0))
    stats = [
        F.count("*").alias("months"),
        (F.avg("ret") * 12).alias("mean_annual"),
        sd.alias("volatility_annual"),
        F.when(sd != 0, F.avg("ret") * 12 / sd).alias("sharpe_annual"),
        F.avg("universe").alias("average_universe"),
        F.avg(F.col("n_long") + F.col("n_short")).alias("average_holdings"),
        F.avg("gross").alias("gross_leverage"),
        F.max(F.abs("net")).alias("maximum_absolute_net"),
    ]
    if "turnover" in months.columns:
        stats.append(F.avg("turnover").alias("turnover_monthly"))
    return months.agg(*stats)


def maximum_drawdowns(months: DataFrame, volatility: float = 0.10) -> DataFrame:
    """Raw, and of returns scaled to a yearly volatility."""
    sd = F.stddev_samp("ret").over(Window.partitionBy()) * F.sqrt(F.lit(12.0))
    both = months.withColumn("__sd", sd).select("eom", F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col("ret")), F.struct(F.lit("scaled").alias("kind"), (F.col("ret") * volatility / F.col("__sd")).alias("ret")))).alias("r"))
    return drawdowns(both.select("eom", "r.kind", "r.ret"), keys=["kind"]).groupBy("kind").agg(F.max("drawdown").alias("maximum_drawdown"))


def evaluate(weights: DataFrame, outcomes: DataFrame, preds: DataFrame | None = None) -> DataFrame:
    """One row of all statistics; raises unless weights cover exactly the outcomes, which must be finite."""
    if not uncovered(outcomes, weights, ["id", "eom"]).isEmpty():
        raise ValueError("weights and outcomes must have the same keys")
    joined = joined_one_to_one(weights, outcomes, ["id", "eom"])
    if not joined.where(F.col("label").isNull() | F.isnan("label")).isEmpty():
        raise ValueError("outcomes must be finite")
    months = monthly_performance(weights, outcomes).join(turnover(weights, outcomes), "eom", "left")
    worst = maximum_drawdowns(months).agg(F.max(F.when(F.col("kind") == "raw", F.col("maximum_drawdown"))).alias("maximum_drawdown"), F.max(F.when(F.col("kind") == "scaled", F.col("maximum_drawdown"))).alias("maximum_drawdown_scaled"))
    out = annual_statistics(months).crossJoin(worst)  # one row each
    return out if preds is None else out.crossJoin(forecast_errors(preds, outcomes))


def finalised(weights: DataFrame) -> DataFrame:
    """(id, eom, w) typed; raises if empty, not finite or not unique."""
    out = weights.select(F.col("id").cast("long").alias("id"), F.col("eom").cast("date").alias("eom"), F.col("w").cast("double").alias("w"))
    one = out.agg(F.count("*").alias("n"), F.count_if(F.col("w").isNull() | F.isnan("w") | (F.abs("w") == float("inf"))).alias("bad")).first()
    if not one["n"] or one["bad"]:
        raise ValueError("weights must be given and finite")
    from ..sources.panel import check_unique

    check_unique(out, ["id", "eom"])
    return out
