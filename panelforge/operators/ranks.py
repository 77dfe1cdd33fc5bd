"""Cross-sectional ranks and medians. All features go through one window over (group, feature)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GROUP = ["excntry", "eom"]


def long_form(panel: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return panel.unpivot(keys, features, "feature", "x")


def wide_form(rows: DataFrame, keys: list[str], features: list[str], value: str = "x") -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == f, F.col(value))).alias(f) for f in features])


def percentile_ranks(rows: DataFrame, group: list[str], value: str = "x", out: str = "x", min_obs: int | None = None, fill: bool = True) -> DataFrame:
    """Rank over the group's count less one half; ties take the largest rank, a raw zero is -0.5, what is missing is 0.
    Groups with fewer than min_obs values are 0 throughout."""
    whole, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.col(value)
    n = F.count(x).over(whole)
    rank = F.when(x == 0, F.lit(-0.5)).when(x.isNotNull(), F.count(x).over(upto) / n - 0.5)
    if min_obs is not None:
        rank = F.when(n >= min_obs, rank)
    return rows.withColumn(out, F.coalesce(rank, F.lit(0.0)) if fill else rank)


def ranked_panel(panel: DataFrame, features: list[str], min_obs: int | None = None, group: list[str] | None = None) -> DataFrame:
    """The panel with its features ranked in each group."""
    group = group or GROUP
    keys = [c for c in panel.columns if c not in features]
    ranked = percentile_ranks(long_form(panel, keys, features), [*group, "feature"], min_obs=min_obs)
    return wide_form(ranked, keys, features)


def median_filled(rows: DataFrame, group: list[str], value: str, out: str, within: str | None = None) -> DataFrame:
    """What is missing becomes the median of the group's part given by `within`, else of the group, else 0."""
    medians = [F.median(value).over(Window.partitionBy(*group, within))] if within else []
    return rows.withColumn(out, F.coalesce(value, *medians, F.median(value).over(Window.partitionBy(*group)), F.lit(0.0)))


def median_filled_ranks(panel: DataFrame, features: list[str], industry: str | None = None) -> DataFrame:
    """Ranks whose originally missing cells become medians of ranks, by country or by country and industry."""
    keys = [c for c in panel.columns if c not in features]
    ranked = percentile_ranks(long_form(panel, keys, features), [*GROUP, "feature"], fill=False)
    return wide_form(median_filled(ranked, [*GROUP, "feature"], "x", "x", industry), keys, features)


def z_scores(rows: DataFrame, group: list[str], value: str = "x", out: str = "z") -> DataFrame:
    """Against the group's mean and sample deviation; a constant group, to six decimals, is 0."""
    w = Window.partitionBy(*group)
    sd = F.stddev_samp(value).over(w)
    return rows.withColumn(out, F.when(F.round(sd, 6) != 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def forecast_percentiles(preds: DataFrame, group: list[str] | None = None) -> DataFrame:
    return preds.withColumn("pred", F.cume_dist().over(Window.partitionBy(*(group or GROUP)).orderBy("pred")) - 0.5)
