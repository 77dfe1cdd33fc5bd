"""From forecasts and risk to weights."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import month_number
from . import linalg

PENALTIES = [0.0, *np.logspace(-5, 2, 15).tolist()]
WEIGHTS = "eom date, id long, w double"
# a month of risk: ids with specific variances and loadings, as arrays in one row
RISK = "eom date, ids array<long>, mu array<double>, diagonal array<double>, loading array<array<double>>, industry array<string>"


def deciles(preds: DataFrame, portfolios: int = 10, cash_on_degenerate: bool = False) -> DataFrame:
    """Short the lowest and long the highest part of each country, weights equal on each side of a month over all
    countries. At or under the low cutoff is short, also where both cutoffs agree."""
    group = Window.partitionBy("excntry", "eom")
    low, high = (F.percentile("pred", F.lit(q)).over(group) for q in (1 / portfolios, 1 - 1 / portfolios))
    side = F.when(F.col("pred") <= low, -1).when(F.col("pred") >= high, 1).otherwise(0)
    sided = preds.withColumn("side", side)
    month = Window.partitionBy("eom")
    counts = {k: F.sum((F.col("side") == k).cast("int")).over(month) for k in (-1, 0, 1)}
    n = F.when(F.col("side") == 1, counts[1]).when(F.col("side") == -1, counts[-1]).otherwise(counts[0])
    w = F.col("side") / n
    if cash_on_degenerate:
        w = F.when((counts[1] == 0) | (counts[-1] == 0), 0.0).otherwise(w)
    return sided.select("id", "eom", w.alias("w"))


def per_month(risk: DataFrame, weigh: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Weights of each month from weigh(mu, diagonal, loading, industry). A month is a row, so months run in parallel
    and no rows are gathered; its size is that of the cross-section."""

    def run(batches):  # noqa: ANN001, ANN202
        for frame in batches:
            for r in frame.itertuples(index=False):
                w = weigh(np.array(r.mu, float), np.array(r.diagonal, float), np.array([np.asarray(x) for x in r.loading], float).reshape(len(r.ids), -1), np.array(r.industry, object))
                yield pd.DataFrame({"eom": r.eom, "id": r.ids, "w": w})

    return risk.select("eom", "ids", "mu", "diagonal", "loading", "industry").mapInPandas(run, WEIGHTS)


def minimum_variance(risk: DataFrame) -> DataFrame:
    return per_month(risk, lambda mu, d, b, g: linalg.minimum_variance(d, b))


def markowitz(risk: DataFrame, target: float = 0.10, penalty: float = 0.0) -> DataFrame:
    return per_month(risk, lambda mu, d, b, g: linalg.markowitz(mu, d, b, target, penalty))


def neutral(risk: DataFrame, mode: str = "industry", target: float = 0.10) -> DataFrame:
    def weigh(mu, d, b, g):  # noqa: ANN001, ANN202
        h = np.ones((len(mu), 1)) if mode == "net" else np.column_stack([g == x for x in sorted(set(g))]).astype(float)
        return linalg.neutral(mu, h, d, b, target)

    return per_month(risk, weigh)


def industry_sleeves(risk: DataFrame, combine: str = "equal", target: float = 0.10) -> DataFrame:
    """Net-zero sleeves by industry, put together equally, for the least variance, or for the best tangency."""

    def weigh(mu, d, b, g):  # noqa: ANN001, ANN202
        u, _ = linalg.sleeves(mu, g, d, b, target)
        loads = b.T @ u
        cov = u.T @ (d[:, None] * u) + loads.T @ loads
        if combine == "equal":
            x = np.full(u.shape[1], 1.0 / u.shape[1])
        elif combine == "minimum":
            x = linalg.simplex_minimum_variance(cov)
        else:
            x = linalg.nonnegative_tangency(u.T @ mu, cov)
            if not x.any():
                x = np.full(u.shape[1], 1.0)
        return linalg.to_volatility(u @ x, d, b, target)

    return per_month(risk, weigh)


def penalised_weights(risk: DataFrame, penalties: list[float] | None = None, target: float = 0.10) -> DataFrame:
    """(eom, id, q, minimum, markowitz): each candidate's portfolios of a month; q is in units of the month's median
    stock variance."""
    grid = penalties or PENALTIES

    def run(batches):  # noqa: ANN001, ANN202
        for frame in batches:
            for r in frame.itertuples(index=False):
                mu, d = np.array(r.mu, float), np.array(r.diagonal, float)
                b = np.array([np.asarray(x) for x in r.loading], float).reshape(len(d), -1)
                scale = float(np.median(d + (b**2).sum(1)))
                for q in grid:
                    yield pd.DataFrame({"eom": r.eom, "id": r.ids, "q": q, "minimum": linalg.minimum_variance(d + q * scale, b), "markowitz": linalg.markowitz(mu, d, b, target, q)})

    return risk.select("eom", "ids", "mu", "diagonal", "loading").mapInPandas(run, "eom date, id long, q double, minimum double, markowitz double")


def penalty_bank(weights: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(eom, eom_ret, q, minimum, markowitz): what each candidate's portfolio of a month returns. It depends on weights
    only, not on the selection, so it is one pass."""
    joined = weights.join(outcomes, ["id", "eom"])
    return joined.groupBy("eom", "eom_ret", "q").agg(F.sum(F.col("minimum") * F.col("label")).alias("minimum"), F.sum(F.col("markowitz") * F.col("label")).alias("markowitz"))


def penalised_loop(risk: DataFrame, outcomes: DataFrame, value: str = "markowitz", penalties: list[float] | None = None, months: int = 120) -> DataFrame:
    """(id, eom, q, w): each formation has the penalty that the payoffs released by then choose. Candidates don't depend
    on the choice, so all months' candidates are made at once and the chosen ones picked by a join."""
    candidates = penalised_weights(risk, penalties).persist()
    bank = penalty_bank(candidates, outcomes)
    chosen = selected_penalties(bank, candidates.select(F.col("eom").alias("formation")).distinct(), value, "sharpe" if value == "markowitz" else "variance", months)
    picked = chosen.select(F.col("formation").alias("eom"), "q")
    return candidates.join(F.broadcast(picked), ["eom", "q"]).select("id", "eom", "q", F.col(value).alias("w"))


def rescaled(risk: DataFrame, target: float = 0.10, penalty: float = 0.0) -> DataFrame:
    """(eom, id, native, reference): Markowitz portfolios of changed risk, sized by that risk and by the reference's.
    Rows have `reference` loadings beside `loading`; a penalty is in units of the reference's median stock variance."""

    def run(batches):  # noqa: ANN001, ANN202
        for frame in batches:
            for r in frame.itertuples(index=False):
                mu, d = np.array(r.mu, float), np.array(r.diagonal, float)
                b, ref = (np.array([np.asarray(x) for x in m], float).reshape(len(d), -1) for m in (r.loading, r.reference))
                raw = linalg.woodbury(d + penalty * float(np.median(d + (ref**2).sum(1))), b, mu)
                yield pd.DataFrame({"eom": r.eom, "id": r.ids, "native": linalg.to_volatility(raw, d, b, target), "reference": linalg.to_volatility(raw, d, ref, target)})

    return risk.select("eom", "ids", "mu", "diagonal", "loading", "reference").mapInPandas(run, "eom date, id long, native double, reference double")


def wide_grid() -> np.ndarray:
    return np.unique(np.concatenate([[0.0], np.geomspace(1e-8, 1.0, 200), np.arange(1.0, 10001.0), PENALTIES]))


def _with_outcomes(risk: DataFrame, outcomes: DataFrame, how: str = "inner") -> DataFrame:
    """Months of risk beside the ids and labels of their outcomes, in the order of ids."""
    labels = outcomes.groupBy("eom", "eom_ret").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("x"))  # a month's cross-section
    return risk.join(labels, "eom", how).select("eom", "eom_ret", "ids", "mu", "diagonal", "loading", F.col("x.id").alias("known"), F.col("x.label").alias("labels"))


def _parts(r: object) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mu, y, diagonal, loading) of a month; stocks without an outcome have y = 0."""
    ids, known, d = np.array(r.ids), np.atleast_1d(r.known), np.array(r.diagonal, float)
    y = np.zeros(len(ids))
    if known.size and known[0] is not None:
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        y = np.where(known[at] == ids, np.array(r.labels, float)[at], 0.0)
    return np.array(r.mu, float), y, d, np.array([np.asarray(x) for x in r.loading], float).reshape(len(d), -1)


def penalty_spectra(risk: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(eom, eom_ret, unit, values, forecast, outcome): a month's stock covariance as eigenvalues, with forecasts and
    outcomes in its eigenvectors; from these the payoff of any penalty is two sums. Stocks without an outcome count 0.
    It takes the cube of the stocks; penalty_profiles gives the same payoffs in a time linear in them."""

    def run(batches):  # noqa: ANN001, ANN202
        for frame in batches:
            for r in frame.itertuples(index=False):
                mu, y, d, b = _parts(r)
                values, vectors = np.linalg.eigh(np.diag(d) + b @ b.T)
                yield pd.DataFrame({"eom": [r.eom], "eom_ret": [r.eom_ret], "unit": [float(np.median(d + (b**2).sum(1)))], "values": [np.maximum(values, 0.0)], "forecast": [vectors.T @ mu], "outcome": [vectors.T @ y]})

    return _with_outcomes(risk, outcomes).mapInPandas(run, "eom date, eom_ret date, unit double, values array<double>, forecast array<double>, outcome array<double>")


def penalty_profiles(risk: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(eom, eom_ret, unit, nodes, sums): linalg.risk_profile of a month's forecasts, outcomes and loadings, from which
    the payoff of any penalty follows; its size doesn't grow with the stocks. Stocks without an outcome count 0; months
    without one have no eom_ret."""

    def run(batches):  # noqa: ANN001, ANN202
        for frame in batches:
            for r in frame.itertuples(index=False):
                mu, y, d, b = _parts(r)
                nodes, sums = linalg.risk_profile(np.column_stack([mu, y, b]), d)
                yield pd.DataFrame({"eom": [r.eom], "eom_ret": [r.eom_ret], "unit": [float(np.median(d + (b**2).sum(1)))], "nodes": [nodes], "sums": [sums.ravel()]})

    return _with_outcomes(risk, outcomes, "left").mapInPandas(run, "eom date, eom_ret date, unit double, nodes array<double>, sums array<double>")


def spectral_payoffs(unit: float, values: np.ndarray, forecast: np.ndarray, outcome: np.ndarray, grid: np.ndarray, target: float = 0.10, batch: int = 512) -> np.ndarray:
    """Payoffs of the portfolios at the target volatility, for each penalty."""
    out = np.empty(len(grid))
    for at in range(0, len(grid), batch):
        x = forecast[:, None] / (values[:, None] + unit * grid[None, at : at + batch])
        out[at : at + batch] = outcome @ x * target / np.sqrt(252 * (values @ x**2))
    return out


def _block_sharpe(payoffs: np.ndarray, blocks: int) -> np.ndarray:
    parts = [p for p in np.array_split(payoffs, blocks)]
    with np.errstate(divide="ignore", invalid="ignore"):
        scores = np.array([np.sqrt(12) * p.mean(0) / p.std(0, ddof=1) for p in parts])
    total = scores.mean(0)
    return np.where(np.isfinite(total), total, -np.inf)


def wide_penalties(profiles: DataFrame, formations: DataFrame, months: int = 120, blocks: int = 5, least: int = 10, points: int = 10_000) -> DataFrame:
    """(formation, q): the best mean block Sharpe ratio of the payoffs released by the formation, over the wide grid and
    then evenly between the winner's neighbours; the coarse winner stays a candidate, ties go to the smallest, and with
    too few months q is 0. A formation is one task with the profiles of at most `months` months."""
    age = F.row_number().over(Window.partitionBy("formation").orderBy(F.desc("eom_ret")))
    known = profiles.join(formations, F.col("eom_ret") <= F.col("formation")).withColumn("age", age).where(F.col("age") <= months)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        q, frame = 0.0, frame.sort_values("eom_ret")
        if len(frame) >= least:
            rows = [(r.unit, np.asarray(r.nodes), np.asarray(r.sums).reshape(len(r.nodes), -1)) for r in frame[["unit", "nodes", "sums"]].itertuples(index=False)]
            grid = wide_grid()
            score = _block_sharpe(np.stack([linalg.profile_payoffs(*r, grid) for r in rows]), blocks)
            k = int(np.argmax(score))
            fine = np.unique(np.append(np.linspace(grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)], points), grid[k]))
            if np.isfinite(score[k]):
                q = float(fine[int(np.argmax(_block_sharpe(np.stack([linalg.profile_payoffs(*r, fine) for r in rows]), blocks)))])
        return pd.DataFrame({"formation": frame["formation"].iloc[:1], "q": [q]})

    got = known.repartition(48, "formation").groupBy("formation").applyInPandas(choose, "formation date, q double")
    return formations.join(got, "formation", "left").select("formation", F.coalesce("q", F.lit(0.0)).alias("q"))


def selected_penalties(bank: DataFrame, formations: DataFrame, value: str, best: str, months: int = 120, blocks: int = 5, least: int = 10) -> DataFrame:
    """(formation, q, score): for each formation, the candidate with the best mean block score over the latest `months`
    payoffs released by then: best 'variance' takes the smallest sample variance, 'sharpe' the largest yearly Sharpe
    ratio. Ties go to the smallest q; with too few months q is 0. All relational."""
    released = formations.join(bank, F.col("eom_ret") <= F.col("formation"))  # months x months x candidates; Spark broadcasts a side if it is small
    by = Window.partitionBy("formation", "q")
    recent = released.withColumn("k", F.row_number().over(by.orderBy(F.desc("eom_ret")))).where(F.col("k") <= months)
    placed = recent.withColumn("block", F.ntile(blocks).over(by.orderBy("eom_ret"))).withColumn("n", F.count("*").over(by)).where(F.col("n") >= least)
    scores = placed.groupBy("formation", "q", "block").agg(F.var_samp(value).alias("var"), F.avg(value).alias("mean"))
    one = F.col("var") if best == "variance" else F.when(F.col("var") > 0, F.col("mean") * F.sqrt(12 / F.col("var")))
    total = scores.withColumn("one", one).groupBy("formation", "q").agg(F.avg("one").alias("score"), F.count("one").alias("valid")).where(F.col("valid") == blocks)
    order = F.col("score") if best == "variance" else -F.col("score")
    chosen = total.groupBy("formation").agg(F.min_by(F.struct("q", "score"), F.struct(order, "q")).alias("c"))
    return formations.join(chosen, "formation", "left").select("formation", F.coalesce("c.q", F.lit(0.0)).alias("q"), F.col("c.score").alias("score"))


def timed(weights: DataFrame, proxy: DataFrame, months: int = 12, share: float = 0.5) -> DataFrame:
    """Half the weights after a market fall over the last 12 consecutive months; all of them else, also where a month
    is missing."""
    monthly = proxy.groupBy(F.last_day("date").alias("eom")).agg(F.product(1 + F.col("ret")).alias("gross"))
    span = Window.partitionBy().orderBy("m").rangeBetween(-(months - 1), 0)  # a row a month
    signal = monthly.withColumn("m", month_number(F.col("eom"))).select("eom", F.when(F.count("*").over(span) == months, F.product("gross").over(span) - 1).alias("signal"))
    out = weights.join(F.broadcast(signal), "eom", "left")
    return out.select("id", "eom", (F.col("w") * F.when(F.col("signal") < 0, share).otherwise(1.0)).alias("w"))


def portfolio_variance(weights: DataFrame, specific: DataFrame, exposures: DataFrame, cov: DataFrame) -> DataFrame:
    """(eom, variance) from long tables: weights (eom, id, w), specific (eom, id, d), exposures (eom, id, i, b), cov
    (eom, i, j, v) with i <= j."""
    own = weights.join(specific, ["eom", "id"]).groupBy("eom").agg(F.sum(F.col("w") * F.col("w") * F.col("d")).alias("own"))
    e = weights.join(exposures, ["eom", "id"]).groupBy("eom", "i").agg(F.sum(F.col("w") * F.col("b")).alias("e"))
    both = cov.join(e, ["eom", "i"]).join(e.select("eom", F.col("i").alias("j"), F.col("e").alias("f")), ["eom", "j"])
    shared = both.groupBy("eom").agg(F.sum(F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("e") * F.col("v") * F.col("f")).alias("shared"))
    return own.join(shared, "eom").select("eom", (F.col("own") + F.col("shared")).alias("variance"))
