"""The larger plans against plain NumPy walks, checks that must raise, and what is stored and read again."""

import datetime as dt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions.calendar import parsed_date
from panelforge.functions.normal import NormalStream, ndtri
from panelforge.operators import allocation, joins, linalg, moments, ridge, risk
from panelforge.plans import allocation_queries, catalogue, flagship, risk_queries
from panelforge.plans import queries as panel_queries
from panelforge.sources import demo, store

SF = "/root/testdata/sf0.001"


def month(d):
    return d.year * 12 + d.month - 1


def test_dense_factor_refits_equal_a_plain_walk(spark):
    p = demo.monthly(spark, SF).persist()
    s = flagship.Settings(training_months=36, seed=10, least_residuals=20, min_obs=2)
    inputs = flagship.stages(p, demo.FEATURES, demo.days(spark, SF), s)
    formations = [r[0] for r in p.where("test").select("eom").distinct().orderBy("eom").collect()]
    got = flagship.factor_forecasts(inputs, formations, s)
    sums = {m: np.sum(np.stack(x["f"].to_numpy()), 0) for m, x in inputs.factors.groupby(inputs.factors["date"].map(month))}
    stocks = {}
    for d, x in inputs.labelled.toPandas().groupby("eom_ret"):
        stocks[month(d)] = (np.stack(x["b"].to_numpy()), x["label"].to_numpy())
    checked = 0
    for at in range(0, len(formations), 12):
        d = formations[at]
        first = month(d) + 1 - 36
        known = [m for m in sorted(sums) if first <= m <= month(d) and m - 1 in sums]
        x, y = np.stack([sums[m - 1] for m in known]), np.stack([sums[m] for m in known])
        fold = np.array([min(4, (m - first) * 5 // 35) for m in known])

        def loss(q):
            total = []
            for k in np.unique(fold):
                a, c = linalg.multi_ridge(x[fold != k], y[fold != k], np.array([q]))[0]
                errors = np.concatenate([stocks[m][1] - stocks[m][0] @ (a + sums[m - 1] @ c) for m, g in zip(known, fold, strict=True) if g == k and m in stocks])
                total.append(np.mean(errors**2))
            return np.mean(total)

        best = min(loss(q) for q in np.geomspace(1e-8, 1e4, 60))
        for e in formations[at : at + 12]:
            if month(e) in sums:
                a, c = linalg.multi_ridge(x, y, np.array([1e-4]))[0]
                assert got[e].shape == (a + sums[month(e)] @ c).shape
        inner = linalg.Spectrum(x, y)
        d0 = formations[at]
        # the forecast lies on the Ridge path at a penalty whose loss is no worse than any of a plain grid
        path = np.geomspace(1e-13, 1e12, 4000)
        near = [np.abs(inner.forecast(sums[month(d0)], q) - got[d0]).max() for q in path]
        q = path[int(np.argmin(near))]
        assert min(near) < 1e-3 * max(np.abs(got[d0]).max(), 1e-12) + 1e-9 and loss(q) <= best * 1.001
        checked += 1
    assert checked > 2


def test_mapped_quadratics():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=(30, 4))
    one, (a, c) = linalg.Spectrum(x, y), linalg.multi_ridge(x, y, np.array([0.3]))[0]
    assert np.allclose(one.forecast(x[0], 0.3), a + x[0] @ c)
    b, r = rng.normal(size=(9, 4)), rng.normal(size=9)
    const, linear, q = linalg.mapped_quadratic(b, r, one.mean, one.outputs, one.coordinates(x[0]))
    d = one.shrunk(np.array([0.3]))[:, 0]
    assert np.isclose(const + 2 * linear @ d + d @ q @ d, ((r - b @ (a + x[0] @ c)) ** 2).sum())
    assert linalg.searched(lambda g: (np.log(g) - 7.25) ** 2, np.geomspace(1e-3, 1.0, 50)) == pytest.approx(np.exp(7.25), rel=1e-3)


def test_wide_penalties_equal_direct_payoffs(spark):
    rows = allocation_queries.risk_rows(spark, SF).persist()
    out = panel_queries.outcomes(spark, SF)
    spectra = {r.eom: r for r in allocation.penalty_spectra(rows, out).collect()}
    labels = {(r.id, r.eom): r.label for r in out.collect()}
    grid = np.array([0.0, 1e-3, 0.5, 20.0])
    for r in rows.collect()[::9]:
        if r.eom in spectra:
            one = spectra[r.eom]
            d, b, y = np.array(r.diagonal), np.array(r.loading), np.array([labels.get((i, r.eom), 0.0) for i in r.ids])
            want = [linalg.markowitz(np.array(r.mu), d, b, penalty=float(q)) @ y for q in grid]
            assert np.allclose(allocation.spectral_payoffs(one.unit, np.array(one["values"]), np.array(one.forecast), np.array(one.outcome), grid), want)
    chosen = {r.formation: r.q for r in catalogue.QUERIES["al10_wide_penalties"](spark, SF).collect()}
    first, last = min(chosen), max(chosen)
    assert chosen[first] == 0.0 and chosen[last] >= 0.0
    known = sorted((r for r in spectra.values() if r.eom_ret <= last), key=lambda r: r.eom_ret)[-120:]
    pay = lambda g: np.stack([allocation.spectral_payoffs(r.unit, np.array(r["values"]), np.array(r.forecast), np.array(r.outcome), g) for r in known])
    assert allocation._block_sharpe(pay(np.array([chosen[last]])), 5)[0] >= allocation._block_sharpe(pay(np.geomspace(1e-8, 1e4, 300)), 5).max() - 1e-9


def test_ward_groups_leave_days_in_the_cluster(spark, monkeypatch):
    v = risk_queries.stream(spark, SF)
    x, m = np.stack(v["f"].to_numpy()), v["market"].to_numpy()
    x, m = x - x.mean(0), m - m.mean()
    x = x - np.outer(m, m @ x / (m @ m))
    centres, members = list((x / np.sqrt((x**2).sum(0))).T), [[k] for k in range(x.shape[1])]
    while len(members) > 21:
        cost = {(i, j): ((centres[i] - centres[j]) ** 2).sum() * len(a) * len(b) / (len(a) + len(b)) for i, a in enumerate(members) for j, b in enumerate(members) if i < j}
        i, j = min(cost, key=cost.get)
        centres[i] = (len(members[i]) * centres[i] + len(members[j]) * centres[j]) / (len(members[i]) + len(members[j]))
        members[i] += members.pop(j)
        centres.pop(j)
    want = {k: c for c, part in enumerate(sorted(members, key=min)) for k in part}
    monkeypatch.setattr(risk_queries, "stream", None)  # days x K on the driver
    assert {r.i: r.cluster for r in catalogue.QUERIES["rk23_ward_groups"](spark, SF).collect()} == want
    rows = spark.createDataFrame([(float(t % 3), [5.0, 0.1, float(t % 5), -float(t % 5)]) for t in range(30)], "market double, f array<double>")
    assert linalg.product_groups(*moments.net_products(rows), 3).tolist() == linalg.correlation_groups(np.array([[5.0, 0.1, t % 5, -(t % 5)] for t in range(30)]), np.arange(30.0) % 3, 3).tolist()


def test_normal_draws(spark):
    stream, whole = NormalStream(1), NormalStream(1).take(300_000)
    places = np.array([0, 1, 2, 77, 5000, 65_536, 65_537, 299_999])
    assert np.array_equal(stream.at(places), whole[places])
    assert abs(whole.mean()) < 0.01 and abs(whole.std() - 1) < 0.01
    assert whole[:3] == pytest.approx([-0.6264538, 0.1836433, -0.8356286], abs=1e-6)  # the well-known first draws of seed 1
    z = [r[0] for r in spark.createDataFrame([(0.5,), (0.975,), (0.0,), (2.0,), (None,)], "p double").select(ndtri(F.col("p"))).collect()]
    assert z[:2] == pytest.approx([0.0, NormalDist().inv_cdf(0.975)]) and z[2] == -np.inf and z[3] is None and z[4] is None


def test_noise_replaces_what_does_not_vary(spark):
    rows = [(i, dt.date(2020, m, 28), dt.date(2020, m + 1, 28), "A", "100", float(i), 3.0) for m in (1, 2) for i in range(12)]
    p = spark.createDataFrame(rows, "id long, eom date, eom_ret date, excntry string, sic string, x double, c double")
    b = {(r.id, r.eom): r.b for r in risk.exposures(p, ["x", "c"], variant="noise").collect()}
    draws = NormalStream(1).take(24).reshape(2, 12)
    for k, m in enumerate((1, 2)):
        want = (draws[k] - draws[k].mean()) / draws[k].std(ddof=1)
        assert np.allclose([b[i, dt.date(2020, m, 28)][13] for i in range(12)], want)
    early = {r.id: r.b for r in risk.exposures(p.where("month(eom) = 1"), ["x", "c"], variant="noise").collect()}
    assert all(np.allclose(early[i], b[i, dt.date(2020, 1, 28)]) for i in range(12))  # later months don't matter
    with pytest.raises(ValueError, match="kind"):
        risk.exposures(p, ["x"], variant="other")


def test_checked_joins(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, x double")
    b = spark.createDataFrame([(1, 5.0)], "id long, y double")
    with pytest.raises(Exception, match="forecast: y is missing"):
        joins.looked_up(a, b, ["id"], ["y"], "forecast").collect()
    assert joins.looked_up(a.where("id = 1"), b, ["id"], ["y"]).collect()[0].y == 5.0
    with pytest.raises(ValueError, match="unique"):
        joins.with_codes(a, b.union(b), ["id"])
    with pytest.raises(ValueError, match="same"):
        joins.same_keys(["id"], a, b)
    days = spark.createDataFrame([(1, dt.date(2020, 1, 2), -1.5), (2, dt.date(2020, 1, 2), -1.5)], "id long, date date, ret_exc double")
    caps = spark.createDataFrame([(1, dt.date(2019, 12, 31), 1.0)], "id long, eom date, capital double")
    with pytest.raises(Exception, match="above -1"):
        risk.cap_weight_proxy(days, caps).collect()


def test_stored_models_and_receipts(spark, tmp_path):
    fits = spark.createDataFrame([(2020, 0.1, [1.0, 2.0]), (2021, 1.0, [0.5, 0.25])], "year int, penalty double, beta array<double>")
    store.write_models(fits, str(tmp_path / "m"))
    assert store.differences(store.read_models(spark, str(tmp_path / "m")), fits).isEmpty()
    changed = spark.read.parquet(str(tmp_path / "m")).withColumn("penalty", F.col("penalty") + 1)
    changed.write.parquet(str(tmp_path / "n"))
    with pytest.raises(Exception, match="changed"):
        store.read_models(spark, str(tmp_path / "n")).collect()
    rows = spark.createDataFrame([(dt.date(2020, m, 28), float(m)) for m in range(1, 6)], "eom date, v double")
    before = store.receipts(rows, ["2020-02-29", "2020-04-30"]).collect()
    after = store.receipts(rows.withColumn("v", F.when(F.col("eom") > "2020-02-29", 0.0).otherwise(F.col("v"))), ["2020-02-29", "2020-04-30"]).collect()
    assert before[0] == after[0] and before[1] != after[1] and before[0].rows == 2
    scores = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0)], "k string, q double, loss double")
    chosen = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, q double")
    assert sorted((r.k, r.regret) for r in store.certified(scores, chosen, ["k"], "q", "loss").collect()) == [("a", 1.0), ("b", 0.0)]
    assert store.code_hash() == store.code_hash() and len(store.code_hash()) == 64
    d = [r[0] for r in spark.createDataFrame([("2020-02-29",), ("2020-02-30",), ("x",), (None,)], "t string").select(parsed_date(F.col("t"))).collect()]
    assert d == [dt.date(2020, 2, 29), None, None, None]


def test_bases_and_expanding_moments(spark):
    b = risk.exposures(demo.monthly(spark, SF), demo.FEATURES, min_obs=3).persist()
    bases = risk.characteristic_bases(b, [1997, 1999], months=24)
    x = b.toPandas()
    for year, v in bases.items():
        months = sorted(m for m in x["eom"].unique() if m.year < year)
        grams = []
        for m in months:
            c = np.stack(x[x["eom"] == m]["b"].to_numpy())[:, 12:]
            if len(c) > 1:
                grams.append(c.T @ c / (len(c) - 1))
        want = linalg.principal(np.mean(grams[-24:], 0), 0.9)
        assert np.allclose(v[12:, 12:], want, atol=1e-8) and np.allclose(v[:12, :12], np.eye(12))
    out = risk.projected_by_year(b, bases).toPandas()
    one = out.iloc[0]
    year = one["eom"].year + (one["eom"].month == 12)
    whole = x[(x["eom"] == one["eom"]) & (x["id"] == one["id"])].iloc[0]["b"]
    assert np.allclose(one["b"], np.asarray(whole) @ bases[year])
    rows = spark.createDataFrame([(0, t // 10, t, [float(np.sin(t)), float(np.cos(3 * t)), float(t % 7)]) for t in range(60)], "g int, period int, t int, f array<double>")
    got = moments.expanding_factor_covariance(rows, "period", "t", 30.0, 8.0).toPandas()
    data = np.array([[np.sin(t), np.cos(3 * t), t % 7] for t in range(60)])
    for period, part in got.groupby("period"):
        seen = data[: 10 * (period + 1)]
        want = linalg.aged_covariance(seen, np.arange(len(seen), 0, -1.0), 30.0, 8.0)
        assert np.allclose(linalg.statistics_matrix(part["i"].to_numpy(), part["j"].to_numpy(), part["v"].to_numpy()), want)


def test_penalties_by_year_and_volatility_search(spark):
    b, days = risk.exposures(demo.monthly(spark, SF), demo.FEATURES, min_obs=3).persist(), demo.days(spark, SF).persist()
    table = spark.createDataFrame([(y, 0.5 if y == 1998 else 1e-4) for y in range(1990, 2010)], "year int, penalty double")
    mixed, plain, other = (risk.daily_regressions(days, b, q).select("date", "id", "res").toPandas() for q in (table, 1e-4, 0.5))
    both = mixed.merge(plain, on=["date", "id"]).merge(other, on=["date", "id"])
    inside = both["date"].map(lambda d: d.year == 1998)
    assert np.allclose(both["res_x"], np.where(inside, both["res"], both["res_y"])) and inside.any()
    vols = days.groupBy("id", F.last_day("date").alias("eom")).agg(F.stddev_samp("ret_exc").alias("vol"))
    found = risk.searched_volatility_penalties(b, vols, [1996, 1999], start=np.geomspace(1e-3, 1e3, 40), points=50, extensions=0).collect()
    sections = {}
    for m, part in b.join(vols.where("vol > 0"), ["eom", "id"]).toPandas().groupby("eom"):
        sections[m] = (np.stack(part["b"].to_numpy()), np.log(part["vol"].to_numpy()), part["id"].to_numpy() % 5)
    for row in found:
        def loss(q, year=row.year):
            out = []
            for m, (x, y, fold) in sections.items():
                held = [k for k in range(5) if (fold == k).any() and (fold != k).sum() > 1]
                if m.year < year and len(y) > 1 and held:
                    out.append(sum(((y[fold == k] - x[fold == k] @ linalg.section_ridge(x[fold != k], y[fold != k], q)) ** 2).sum() for k in held) / sum((fold == k).sum() for k in held))
            return np.mean(out)

        assert loss(row.penalty) <= min(loss(q) for q in np.geomspace(1e-3, 1e3, 40)) * (1 + 1e-9)


def test_entry_from_pandas(spark):
    p = demo.monthly(spark, SF).toPandas().rename(columns={"test": "ctff_test", "label": "ret_exc_lead1m"})
    days, s = demo.days(spark, SF).toPandas(), flagship.Settings(training_months=24, seed=10, least_residuals=20, min_obs=2, history_days=300, position_penalties=(0.0, 1.0))
    out = flagship.main(p, pd.DataFrame({"features": demo.FEATURES}), days, spark, s)
    assert list(out.columns) == ["id", "eom", "w"] and len(out) and np.isfinite(out["w"]).all() and out.equals(out.sort_values(["eom", "id"]))
    with pytest.raises(ValueError, match="missing columns"):
        flagship.main(p.drop(columns="excntry"), pd.DataFrame({"features": demo.FEATURES}), days, spark, s)


def test_command_line(spark, tmp_path):
    from panelforge.__main__ import arguments, main

    main(["--data", SF, "--output", str(tmp_path / "out"), "--query", "rk27_equal_weight_proxy"])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    with pytest.raises(SystemExit):
        arguments(["--data", SF, "--output", "x", "--query", "ev1_monthly_performance", "--threads", "11"])


def test_stock_forecasts_from_means(spark):
    b = risk.exposures(demo.monthly(spark, SF), demo.FEATURES, min_obs=3).persist()
    f = risk.factor_returns(risk.daily_regressions(demo.days(spark, SF), b)).persist()
    out, vectors, x = ridge.mean_forecasts(b, f, 100).toPandas(), f.orderBy("date").toPandas(), b.toPandas()
    row = out.iloc[len(out) // 2]
    year = row["eom"].year + (row["eom"].month == 12)
    anchor = min(m for m in x["eom"] if m.year + (m.month == 12) == year)
    known = np.stack(vectors[vectors["date"] <= anchor]["f"].to_numpy())[-100:]
    mine = x[(x["eom"] == row["eom"]) & (x["id"] == row["id"])].iloc[0]["b"]
    assert row["pred"] == pytest.approx(21 * known.mean(0) @ np.asarray(mine))


def test_cached_tables_are_found_where_they_meet_themselves(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for frame in batches:
            made.add(len(frame))
            yield frame

    rows = joins.renewed(spark.range(5).mapInPandas(run, "id long")).persist()
    assert rows.count() == 5 and rows.join(rows.where("id > 1"), "id").count() == 3
    assert made.value == 5  # not made again for the join
