"""Moments of ordered vectors, as long (i, j, v) tables.

A row has a group, a place in time and an array of K values. Each task multiplies whole Arrow batches (X'WX for each
group in them) and gives out the upper triangles of its groups once, so n rows become K(K+1)/2 sums a task and group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import linalg

GROUP = "g"
HELD_BYTES = 64_000_000  # of a task's products; beyond that they are given out and begun anew


def aged(rows: DataFrame, time: str, last: int | None = None) -> DataFrame:
    """With `age`, 1 for the latest row of the group; only the `last` latest rows, if given."""
    out = rows.withColumn("age", F.row_number().over(Window.partitionBy(GROUP).orderBy(F.desc(time))))
    return out if last is None else out.where(F.col("age") <= last)


def exponential(half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.col("age") / F.lit(float(half_life)))


def hyperbolic(half_life: float, power: float = 2.0) -> Column:
    tau = half_life / (2.0 ** (1.0 / power) - 1.0)
    return F.pow(F.lit(1.0) + F.col("age") / F.lit(tau), F.lit(-float(power)))


def _summed(rows: DataFrame, weight: Column, value: str, keys: list[str], squares: bool) -> DataFrame:
    """(keys, i, j, s) partial sums of w * x_i * x_j for i <= j, or (keys, i, s) of w * x_i; nulls count as 0."""
    bare = rows.select(*keys, weight.cast("double").alias("__w"), F.transform(value, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("__x"))
    names = ["i", "j"] if squares else ["i"]
    schema = T.StructType([*[bare.schema[k] for k in keys], *[T.StructField(n, T.IntegerType()) for n in names], T.StructField("s", T.DoubleType())])
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            for key, m in sums.items():
                index = np.triu_indices(len(m)) if squares else (np.arange(len(m)),)
                n = len(index[0])
                columns = [pa.array([k], kind).take(pa.array(np.zeros(n, np.int64))) for k, kind in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.astype(np.int32)) for x in index), pa.array(m[index])], names=[*keys, *names, "s"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(k).type for k in range(at)]
            w, lists = batch.column(at).to_numpy(zero_copy_only=False), batch.column(at + 1)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            of: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(at)), strict=True) if at else [()] * batch.num_rows):
                of.setdefault(key, []).append(row)
            for key, at_rows in of.items():
                part, v = (x, w) if len(of) == 1 else (x[at_rows], w[at_rows])
                sums[key] = sums.get(key, 0.0) + ((part * v[:, None]).T @ part if squares else v @ part)
            if sum(m.nbytes for m in sums.values()) > HELD_BYTES:
                yield from out()
                sums.clear()
        yield from out()

    return bare.mapInArrow(run, schema)


def pair_sums(rows: DataFrame, weight: Column, value: str = "f", keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, s) with s the sum of weight * x_i * x_j for i <= j. All rows have arrays of the same length."""
    keys = keys or [GROUP]
    return _summed(rows, weight, value, keys, True).groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))


def means(rows: DataFrame, weight: Column, value: str = "f", keys: list[str] | None = None) -> DataFrame:
    """(keys, m) with m the array of weighted means."""
    keys = keys or [GROUP]
    total = rows.groupBy(*keys).agg(F.sum(weight).alias("__sw"))
    sums = _summed(rows, weight, value, keys, False).groupBy(*keys, "i").agg(F.sum("s").alias("s"))
    sums = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("m"))
    return sums.join(total, keys).select(*keys, F.transform("m", lambda x: x / F.col("__sw")).alias("m"))


def centred(rows: DataFrame, weight: Column, keys: list[str] | None = None) -> DataFrame:
    keys = keys or [GROUP]
    out = rows.join(means(rows, weight, keys=keys), keys)
    return out.withColumn("f", F.zip_with("f", "m", lambda x, m: x - m)).drop("m")


def covariance(rows: DataFrame, weight: Column | None = None, unbiased: bool = True, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, v), i <= j. Weights count relative to their sum; unbiased divides by 1 - sum of their squares."""
    keys, weight = keys or [GROUP], F.lit(1.0) if weight is None else weight
    sums = rows.withColumn("__w", weight).groupBy(*keys).agg(F.sum("__w").alias("sw"), F.sum(F.col("__w") * F.col("__w")).alias("sw2"))
    part = F.lit(1.0) - F.col("sw2") / (F.col("sw") * F.col("sw")) if unbiased else F.lit(1.0)
    return pair_sums(centred(rows, weight, keys), weight, keys=keys).join(sums, keys).select(*keys, "i", "j", (F.col("s") / F.col("sw") / part).alias("v"))


def second_moment(rows: DataFrame, downside: bool = False) -> DataFrame:
    """Mean products, without centring; downside cuts values at zero from above."""
    if downside:
        rows = rows.withColumn("f", F.transform("f", lambda x: F.least(x, F.lit(0.0))))
    n = rows.groupBy(GROUP).agg(F.count("*").alias("n"))
    return pair_sums(rows, F.lit(1.0)).join(n, GROUP).select(GROUP, "i", "j", (F.col("s") / F.col("n")).alias("v"))


def _diagonal(cov: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return cov.where("i = j").select(*keys, F.col("i").alias(f"{name}_i"), F.sqrt(F.greatest("v", F.lit(0.0))).alias(name))


def correlation_with_variance(cor: DataFrame, var: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Correlations of the one, deviations of the other; a factor without variance has no correlation."""
    keys = keys or [GROUP]
    out = cor
    for name, table in (("ci", cor), ("cj", cor), ("vi", var), ("vj", var)):
        d = _diagonal(table, name, keys).withColumnRenamed(f"{name}_i", name[1])
        out = out.join(d, [*keys, name[1]])
    scale = F.col("ci") * F.col("cj")
    return out.select(*keys, "i", "j", F.when(scale > 0, F.col("v") / scale * F.col("vi") * F.col("vj")).otherwise(0.0).alias("v"))


def factor_covariance(rows: DataFrame, correlation: Column, variance: Column) -> DataFrame:
    """rows with `age`; one weight for correlations, one for variances."""
    return correlation_with_variance(covariance(rows, correlation), covariance(rows, variance))


def ledoit_wolf(rows: DataFrame) -> DataFrame:
    """(g, i, j, v, intensity): the empirical covariance shrunk to a multiple of the identity."""
    empirical = covariance(rows, unbiased=False)
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    totals = empirical.groupBy(GROUP).agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("trace"), F.sum(twice * F.col("v") * F.col("v")).alias("squares"), (F.max("j") + 1).cast("double").alias("k"))
    norm = F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x)
    fourth = centred(rows, F.lit(1.0)).groupBy(GROUP).agg(F.avg(norm * norm).alias("fourth"), F.count("*").alias("n"))
    both = totals.join(fourth, GROUP)
    delta = (F.col("squares") - F.col("trace") * F.col("trace") / F.col("k")) / F.col("k")
    beta = (F.col("fourth") - F.col("squares")) / (F.col("k") * F.col("n"))
    both = both.withColumn("intensity", F.when(delta <= 0, 0.0).otherwise(F.least(F.greatest(beta / delta, F.lit(0.0)), F.lit(1.0))))
    shrunk = (1 - F.col("intensity")) * F.col("v") + F.when(F.col("i") == F.col("j"), F.col("intensity") * F.col("trace") / F.col("k")).otherwise(0.0)
    return empirical.join(both, GROUP).select(GROUP, "i", "j", shrunk.alias("v"), "intensity")


def net_products(rows: DataFrame, signal: str = "market") -> tuple[np.ndarray, np.ndarray]:
    """(K x K products of the centred factors net of the signal, the factors' squares): three passes over the days, of
    which only K x K sums leave the cluster. Residuals are formed row by row, so nothing cancels in the sums."""

    def products(x: Column) -> np.ndarray:
        s = pair_sums(rows.select(F.lit(0).alias(GROUP), x.alias("f")), F.lit(1.0)).toPandas()
        return linalg.statistics_matrix(s["i"].to_numpy(), s["j"].to_numpy(), s["s"].to_numpy())

    def fixed(values: np.ndarray) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    whole = F.concat("f", F.array(F.col(signal).cast("double")))
    raw = products(F.concat(F.array(F.lit(1.0)), whole))
    mean, k = raw[0, 1:] / raw[0, 0], len(raw) - 2
    rows = rows.select(F.zip_with(whole, fixed(mean), lambda x, m: x - m).alias("f"))
    c = products(F.col("f"))
    beta = c[:k, k] / c[k, k] if c[k, k] > 0 else np.zeros(k)
    net = F.zip_with(F.slice("f", 1, k), fixed(beta), lambda x, b: x - b * F.element_at("f", -1))
    return products(net), np.diag(raw)[1:-1]


def conditional_covariances(rows: DataFrame, signal: str = "market", least: int = 63) -> DataFrame:
    """(g, state, i, j, v) for all, negative, nonnegative and balanced days; a state with few days is all of them."""
    days = rows.select(GROUP, "f", F.explode(F.array(F.lit("all"), F.when(F.col(signal) < 0, "negative").otherwise("nonnegative"))).alias("state"))
    counts = days.groupBy(GROUP, "state").agg(F.count("*").alias("n"))
    states = covariance(days, unbiased=False, keys=[GROUP, "state"]).join(counts, [GROUP, "state"])
    pooled = states.where("state = 'all'").select(GROUP, "i", "j", F.col("v").alias("pooled"))
    want = pooled.select("*", F.explode(F.array(F.lit("negative"), F.lit("nonnegative"))).alias("state"))
    got = want.join(states, [GROUP, "state", "i", "j"], "left").select(GROUP, "state", "i", "j", F.when(F.col("n") >= least, F.col("v")).otherwise(F.col("pooled")).alias("v"))
    balanced = got.groupBy(GROUP, "i", "j").agg(F.avg("v").alias("v")).withColumn("state", F.lit("balanced"))
    return got.unionByName(balanced).unionByName(pooled.withColumn("state", F.lit("all")).withColumnRenamed("pooled", "v"))


def drawdown_conditioned(rows: DataFrame, current: float, threshold: float, correlation: Column, variance: Column, least: int = 63) -> DataFrame:
    """The factor covariance of the days in the current state, their ages kept; of all days where they are few.
    `drawdown` is what was known before each day's return."""
    bear_now = 1 - current <= 1 - threshold
    bear = (1 - F.col("drawdown")) <= 1 - threshold
    chosen = rows.where(bear if bear_now else ~bear)
    return factor_covariance(chosen if chosen.count() >= least else rows, correlation, variance)


def sufficient_statistics(panel: DataFrame, features: list[str], label: str, keys: list[str]) -> DataFrame:
    """(keys, i, j, s) over 1, features and label in this order, of rows with a finite label: n, sums, products. They
    add up over any grouping, so a fold's complement is the whole less the fold."""
    vector = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(label).cast("double"))
    usable = panel.where(F.col(label).isNotNull() & ~F.isnan(label) & (F.abs(label) < float("inf")))
    return pair_sums(usable.select(*keys, vector.alias("f")), F.lit(1.0), keys=keys)


def mean_month_gram(panel: DataFrame, features: list[str]) -> DataFrame:
    """Mean over months of X'X / (n - 1)."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    rows = panel.select("eom", vector.alias("f"))
    n = rows.groupBy("eom").agg(F.count("*").alias("n")).where("n > 1")
    return pair_sums(rows, F.lit(1.0), keys=["eom"]).join(n, "eom").groupBy("i", "j").agg(F.avg(F.col("s") / (F.col("n") - 1)).alias("v"))


def expanding_covariance(rows: DataFrame, period: str, time: str, half_life: float) -> DataFrame:
    """(g, period, i, j, v): for each period, the unbiased covariance of all rows up to its end, with weights that halve
    in half_life steps of `time`. Each period's sums are formed once, and prefixes of them added up: weights relative to
    a fixed time differ from those relative to a period's end by a factor that cancels."""
    first = rows.agg(F.min(time)).first()[0]
    w = F.pow(F.lit(2.0), (F.col(time) - F.lit(first)) / F.lit(float(half_life)))
    keys = [GROUP, period]
    sums = pair_sums(rows.withColumn("f", F.concat(F.array(F.lit(1.0)), "f")), w, keys=keys)
    upto = Window.partitionBy(GROUP, "i", "j").orderBy(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("s", F.sum("s").over(upto))
    squares = rows.groupBy(*keys).agg(F.sum(w * w).alias("w2")).withColumn("w2", F.sum("w2").over(Window.partitionBy(GROUP).orderBy(period)))
    total = sums.where("j = 0").select(*keys, F.col("s").alias("w1"))
    mean = sums.where("i = 0 AND j > 0").join(total, keys).select(*keys, (F.col("j") - 1).alias("k"), (F.col("s") / F.col("w1")).alias("m"))
    out = sums.where("i > 0").select(*keys, (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "s").join(total, keys).join(squares, keys)
    out = out.join(mean.withColumnsRenamed({"k": "i", "m": "mi"}), [*keys, "i"]).join(mean.withColumnsRenamed({"k": "j", "m": "mj"}), [*keys, "j"])
    return out.select(*keys, "i", "j", ((F.col("s") / F.col("w1") - F.col("mi") * F.col("mj")) / (1 - F.col("w2") / (F.col("w1") * F.col("w1")))).alias("v"))


def expanding_factor_covariance(rows: DataFrame, period: str, time: str, correlation: float, variance: float) -> DataFrame:
    """Correlations and variances of all rows up to each period's end, with a half-life each."""
    return correlation_with_variance(expanding_covariance(rows, period, time, correlation), expanding_covariance(rows, period, time, variance), [GROUP, period])
