"""Operators on Spark against NumPy, brute force and each other."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelforge.operators import allocation, evaluation, linalg, moments, ridge, risk, trees
from panelforge.plans import flagship, queries
from panelforge.sources import demo, panel, store
from panelforge.streaming.specific_risk import specific_volatility_stream

SF = "/root/testdata/sf0.001"


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(queries.QUERIES) <= set(names)


def test_ingest_and_checks(spark):
    frame = pd.DataFrame({"id": [1, 2], "eom": [dt.date(2020, 1, 31)] * 2, "eom_ret": [dt.date(2020, 2, 29)] * 2, "excntry": ["A", "A"], "test": ["1", "no"], "label": [0.1, float("nan")], "size": [1, 2]})
    out = panel.canonical(panel.ingest(spark, frame), ["size"])
    assert [(r.test, r.label, r.size) for r in out.orderBy("id").collect()] == [(True, 0.1, 1.0), (None, None, 2.0)]
    with pytest.raises(ValueError, match="null"):
        panel.check_panel(out)
    good = out.fillna(False, ["test"])
    panel.check_panel(good)
    with pytest.raises(ValueError, match="unique"):
        panel.check_panel(good.union(good))
    with pytest.raises(ValueError, match="month"):
        panel.check_panel(good.withColumn("eom", F.lit(dt.date(2020, 1, 30))))
    with pytest.raises(ValueError, match="missing"):
        panel.canonical(out, ["other"])
    with pytest.raises(TypeError):
        panel.ingest(spark, 3)
    with pytest.raises(ValueError):
        panel.feature_list(spark.createDataFrame([("id",)], "features string"))


def test_daily_regressions_and_state(spark):
    days, b = demo.days(spark, SF), queries.rk1(spark, SF)
    fits = risk.daily_regressions(days, b, 0.01).toPandas()
    some = sorted(set(fits["date"]))[::300]
    x = {(r.id, r.eom_ret): np.array(r.b) for r in b.collect()}
    ys = {(r.id, r.date): r.ret_exc for r in days.where(F.col("date").isin(some)).collect()}
    for d in some:
        end = (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
        ids = sorted(i for i, e in ys if e == d and (i, end) in x)
        m, y = np.stack([x[i, end] for i in ids]), np.array([ys[i, d] for i in ids])
        f = linalg.section_ridge(m, y, 0.01)
        part = fits[fits["date"] == d].sort_values("id")
        assert part["id"].tolist() == ids and np.allclose(part["res"], y - m @ f) and np.allclose(part["factor"].iloc[0], f)
    back = risk.reconstructed(b, risk.factor_returns(spark.createDataFrame(fits, risk.DAY)), spark.createDataFrame(fits, risk.DAY)).toPandas()
    assert all(np.isclose(r.ret, ys[r.id, r.date]) for r in back.itertuples() if (r.id, r.date) in ys)


def recursion(res, seed, half_life):
    d, count, squares, var, previous, out = 0.5 ** (1 / half_life), 0, 0.0, 0.0, 0.0, []
    for x in res:
        if count > seed:
            var = d * var + (1 - d) * previous**2
        out.append(np.sqrt(var) if count >= seed else None)
        if count < seed:
            squares += x * x
            var = squares / max(1, seed - 1)
        previous, count = x, count + 1
    return out


def test_specific_volatility_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(4)
    dates = pd.bdate_range("2020-01-01", periods=90).date
    rows = [(i, d, float(rng.normal())) for i in (1, 2) for k, d in enumerate(dates) if i == 1 or k % 3]
    res = spark.createDataFrame(rows, "id long, date date, res double")
    got = {(r.id, r.date): r for r in risk.specific_volatility(res, 10, 20.0, 30, 40).collect()}
    for i in (1, 2):
        mine = [(d, x) for j, d, x in rows if j == i]
        for (d, _), want in zip(mine, recursion([x for _, x in mine], 10, 20.0), strict=True):
            assert (got[i, d].vol is None) == (want is None) and (want is None or np.isclose(got[i, d].vol, want))
    place = {d: k for k, d in enumerate(dates)}
    own = [d for j, d, _ in rows if j == 2]
    for c, d in enumerate(own):
        assert got[2, d].eligible == (c >= 30 and place[d] >= 40 and place[own[c - 30]] >= place[d] - 40)
    for k, part in enumerate(np.array_split(np.array(dates), 3)):
        pd.DataFrame([r for r in rows if r[1] in set(part)], columns=["id", "date", "res"]).astype({"date": str}).to_json(tmp_path / f"{k}.json", orient="records", lines=True)
    stream = spark.readStream.schema("id long, date date, res double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "*.json"))
    q = specific_volatility_stream(stream, 10, 20.0).writeStream.format("memory").queryName("vols").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    streamed = {(r.id, r.date): r.vol for r in spark.table("vols").collect()}
    assert len(streamed) == len(rows) and all((got[k].vol is None) == (v is None) and (v is None or np.isclose(v, got[k].vol)) for k, v in streamed.items())


def risk_rows(spark, months=3, n=14):
    rng, rows = np.random.default_rng(9), []
    for m in range(months):
        b = rng.normal(size=(n, 3))
        rows.append((dt.date(2020, m + 1, 28), list(range(n)), rng.normal(size=n).tolist(), rng.uniform(0.01, 0.03, n).tolist(), (b / 20).tolist(), [("a", "b", "c")[k % 3] for k in range(n)]))
    return rows, spark.createDataFrame(rows, allocation.RISK)


def test_allocations(spark):
    rows, df = risk_rows(spark)
    index = {r[0]: r for r in rows}

    def weights(out):
        frame = out.toPandas().sort_values(["eom", "id"])
        return {d: part["w"].to_numpy() for d, part in frame.groupby("eom")}

    for name, out in {"min": allocation.minimum_variance(df), "mar": allocation.markowitz(df, penalty=0.1), "net": allocation.neutral(df, "net"), "ind": allocation.neutral(df), **{c: allocation.industry_sleeves(df, c) for c in ("equal", "minimum", "tangency")}}.items():
        for d, w in weights(out).items():
            _, _, mu, diagonal, loading, groups = index[d]
            v = linalg.variance(w, np.array(diagonal), np.array(loading))
            if name == "min":
                assert np.isclose(w.sum(), 1)
                continue
            assert np.isclose(np.sqrt(252 * v), 0.1)
            if name != "mar":
                assert abs(w.sum()) < 1e-10
            if name in ("ind", "equal", "minimum", "tangency"):
                assert all(abs(w[np.array(groups) == g].sum()) < 1e-10 for g in "abc")
    labels = spark.createDataFrame([(i, r[0], r[0] + dt.timedelta(days=30), 0.01 * i) for r in rows for i in r[1]], "id long, eom date, eom_ret date, label double")
    bank = allocation.penalty_bank(allocation.penalised_weights(df, [0.0, 1.0]), labels).collect()
    assert len(bank) == 6
    one = weights(allocation.markowitz(df, penalty=1.0))
    assert all(np.isclose(r.markowitz, one[r.eom] @ (0.01 * np.arange(14))) for r in bank if r.q == 1.0)
    w = allocation.minimum_variance(df)
    long = [(r[0], i, r[3][i], k, r[4][i][k]) for r in rows for i in r[1] for k in range(3)]
    table = spark.createDataFrame(long, "eom date, id long, d double, i int, b double")
    cov = spark.createDataFrame([(r[0], k, k, 1.0) for r in rows for k in range(3)], "eom date, i int, j int, v double")
    got = {r.eom: r.variance for r in allocation.portfolio_variance(w, table.select("eom", "id", "d").distinct(), table.select("eom", "id", "i", "b"), cov).collect()}
    assert all(np.isclose(got[d], linalg.variance(x, np.array(index[d][3]), np.array(index[d][4]))) for d, x in weights(w).items())


def test_degenerate_deciles(spark):
    rows = [(i, dt.date(2020, 1, 31), "A", 1.0) for i in range(4)]
    preds = spark.createDataFrame(rows, "id long, eom date, excntry string, pred double")
    assert {r.w for r in allocation.deciles(preds).collect()} == {-0.25}
    assert {r.w for r in allocation.deciles(preds, cash_on_degenerate=True).collect()} == {0.0}


def test_evaluate(spark):
    w = queries.decile_weights(spark, SF)
    out = queries.outcomes(spark, SF)
    w = w.join(out.select("id", "eom"), ["id", "eom"], "left_semi")
    one = evaluation.evaluate(evaluation.finalised(w), out, queries.scored(spark, SF).select("id", "eom", "pred")).first()
    assert one.months > 50 and 0 <= one.maximum_drawdown and one.turnover_monthly > 0 and one.mse > 0
    with pytest.raises(ValueError, match="keys"):
        evaluation.evaluate(w.where("id <> 1"), out)


def test_conditioned_covariance_falls_back(spark):
    rows = queries.vectors(spark, SF).withColumn("drawdown", F.lit(0.0))
    args = (moments.exponential(504), moments.exponential(84))
    pooled = {(r.i, r.j): r.v for r in moments.factor_covariance(rows, *args).collect()}
    bear = {(r.i, r.j): r.v for r in moments.drawdown_conditioned(rows, 0.5, 0.1, *args).collect()}
    assert bear == pytest.approx(pooled)


def test_ridge_forecasts(spark):
    p = demo.monthly(spark, "/root/testdata/sf0.01").fillna(0.0, demo.FEATURES).persist()
    folded = p.where("NOT test").withColumn("fold", (F.year("eom") % 5).cast("int"))
    penalty, beta = ridge.fitted(folded, ["disc", "returned"], "fold")
    frame = folded.where("label IS NOT NULL").toPandas()
    x, y, k = frame[["disc", "returned"]].to_numpy(float), frame["label"].to_numpy(float), frame["fold"].to_numpy()

    def fit(a, b, q):
        c = a - a.mean(0)
        coef = np.linalg.solve(c.T @ c + len(a) * q * np.eye(2), c.T @ (b - b.mean()))
        return b.mean() - a.mean(0) @ coef, coef

    errors = [np.mean([np.mean((y[k == f] - i - x[k == f] @ c) ** 2) for f in np.unique(k) for i, c in [fit(x[k != f], y[k != f], q)]]) for q in ridge.PENALTIES]
    best = ridge.PENALTIES[int(np.argmin(errors))]
    i, c = fit(x, y, best)
    assert penalty == best and np.allclose(beta, [i, *c])
    dense, _ = ridge.fitted(folded, ["disc", "returned"], "fold", dense=True)
    assert dense > 0
    out = ridge.walk_forward(p, ["disc", "returned"], [1997, 1998]).toPandas()
    assert set(pd.to_datetime(out["eom"]).dt.year) <= {1996, 1997, 1998} and out["pred"].notna().all()
    early = p.where("eom_ret <= DATE '1996-12-31' OR eom >= DATE '1996-12-31'")
    again = ridge.walk_forward(early.withColumn("label", F.when(F.col("eom_ret") <= F.lit("1996-12-31").cast("date"), F.col("label"))), ["disc", "returned"], [1997]).toPandas()
    both = out.merge(again, on=["id", "eom"])
    assert len(again) and np.allclose(both["pred_x"], both["pred_y"])  # later labels don't matter


def test_trees(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = np.where(x[:, 0] > 0, 1.0, -1.0) + 0.1 * rng.normal(size=600)
    rows = [(i, dt.date(2020, 1 + i % 12, 28), "A", float(y[i]), *map(float, x[i]), i % 3) for i in range(600)]
    p = spark.createDataFrame(rows, "id long, eom date, excntry string, label double, a double, b double, c double, fold int")
    train = trees.assembled(p, ["a", "b", "c"])
    model, record = trees.two_stage(train, "fold", [{"maxDepth": 1}, {"maxDepth": 2}], (5, 0.3), (8, 0.3))
    assert record["trees"] >= 1 and model.transform(train).agg(F.avg(F.pow(F.col("label") - F.col("pred"), 2))).first()[0] < 0.5
    mean = trees.bagged(train, train, {"maxDepth": 2}, 3, 0.3, 2020 * 12, bags=2)
    assert mean.count() == 600 and trees.blended(mean, mean).join(mean.withColumnRenamed("pred", "q"), ["id", "eom"]).where("abs(pred - q) > 1e-12").count() == 0
    scores, names = trees.principal_features(p, p, ["a", "b", "c"], 0.5)
    assert 1 <= len(names) <= 3 and set(names) <= set(scores.columns)
    weighted = trees.age_weights(p, 2020 * 12 + 11, 36)
    assert weighted.agg(F.avg("weight")).first()[0] == pytest.approx(1)


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, None), (2, float("nan"), "x")], "id long, v double, s string")
    minus = spark.createDataFrame([(2, float("nan"), "x"), (1, -0.0, None)], "id long, v double, s string")
    assert store.fingerprint(df) == store.fingerprint(minus) != store.fingerprint(df.fillna("", ["s"]))
    assert store.fingerprint(df) != store.fingerprint(df.union(df))
    s = store.Store(spark, str(tmp_path))
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert s.get("stage", {"code": 1}, make).count() == 2
    assert len(calls) == 1 and s.read("stage", {"code": 1}, verify=True).count() == 2 and s.read("none", {}) is None
    with pytest.raises(ValueError, match="else"):
        s.read("stage", {"code": 2})
    df.write.mode("overwrite").parquet(str(tmp_path / "stage2"))
    p = demo.monthly(spark, SF).select("id", "eom", "qty")
    panel.write_months(p, str(tmp_path / "months"))
    assert store.fingerprint(spark.read.parquet(str(tmp_path / "months")).select("id", "eom", "qty")) == store.fingerprint(p)


def test_flagship(spark):
    p = demo.monthly(spark, SF).persist()
    s = flagship.Settings(correlation_half_life=100, variance_half_life=40, history_days=300, training_months=24, seed=10, least_residuals=20, residual_window=200, min_obs=2, position_penalties=(0.0, 0.1, 1.0))
    days = demo.days(spark, SF)
    out = flagship.weights(p, demo.FEATURES, days, s).toPandas()
    test = p.where("test").select("id", "eom").toPandas()
    assert len(out) and len(out.merge(test, on=["id", "eom"])) == len(out) and np.isfinite(out["w"]).all()
    assert not out.duplicated(["id", "eom"]).any()
    cut = dt.date(1998, 5, 31)  # what comes later doesn't change earlier weights
    early = p.withColumn("label", F.when(F.col("eom_ret") <= cut, F.col("label"))).where(F.col("eom") <= cut)
    again = flagship.weights(early, demo.FEATURES, days.where(F.col("date") <= cut), s).toPandas()
    both = out[out["eom"] <= cut].merge(again, on=["id", "eom"])
    assert len(both) == len(again) > 0 and np.allclose(both["w_x"], both["w_y"])


def test_penalty_choice(spark):
    rows = [(dt.date(2020, m, 27 + k), p, float((p - 1) ** 2 * m + k), 10) for m in range(1, 13) for k in (0, 1) for p in (0.5, 1.0, 2.0)]
    scores = spark.createDataFrame(rows, "date date, penalty double, sse double, n long")
    assert [tuple(r) for r in risk.chosen_section_penalties(scores, [2020, 2021]).collect()] == [(2021, 1.0)]
    x = np.random.default_rng(3).normal(size=(60, 4)) * [3, 1, 0.1, 0.1]
    assert linalg.selected_share(x, np.repeat(np.arange(10), 6)) in (0.5, 0.7, 0.9, 0.95)


def test_flagship_query_is_whole(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(flagship, "weights", lambda p, features, days, s: seen.update(panel=p, days=days, s=s) or p)
    queries.flagship_weights(spark, SF)
    assert seen["panel"].count() == demo.monthly(spark, SF).count() and seen["days"].count() == demo.days(spark, SF).count()
    s, full = seen["s"], flagship.Settings()
    for name in ("history_days", "training_months", "residual_window", "position_penalties"):
        assert getattr(s, name) == getattr(full, name), name


def test_walk_forward_query_covers_the_calendar(spark):
    got = queries.QUERIES["fc5_walk_forward_ridge"](spark, SF).toPandas()
    p = demo.monthly(spark, SF).select("id", "eom", "eom_ret", "label").toPandas()
    year = p["eom"].map(lambda d: d.year + (d.month == 12))
    first = {y: (p["label"].notna() & (p["eom_ret"] <= dt.date(y - 1, 12, 31))).any() for y in year.unique()}
    want = p[year.map(first)]
    assert len(got) == len(want) == len(got.merge(want, on=["id", "eom"])) and got["pred"].notna().all()
    assert set(p.loc[p["eom"] >= dt.date(1998, 1, 1), "eom"]) <= set(got["eom"])


def test_section_penalty_search(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.year: r.penalty for r in queries.QUERIES["rk24_section_penalties"](spark, sf).collect()}
    assert sorted(got) == list(range(1995, 2002)) and got[1995] == 1e-4  # nothing is known before the first year
    b = {(r.id, r.eom_ret): np.array(r.b) for r in queries.rk1(spark, sf).collect()}
    day = demo.days(spark, sf).toPandas()
    day["eom"] = (pd.to_datetime(day["date"]) + pd.offsets.MonthEnd(0)).dt.date
    day = day[[k in b for k in zip(day["id"], day["eom"], strict=True)]]
    last = {}
    for d, part in day.groupby("date"):
        if len(part) > 1:
            last[part["eom"].iloc[0]] = part  # dates ascend

    def loss(year, p):
        out = []
        for e, part in last.items():
            if e.year < year:
                x, y, fold = np.stack([b[i, e] for i in part["id"]]), part["ret_exc"].to_numpy(), part["id"].to_numpy() % 5
                held = [fold == k for k in range(5) if (fold == k).any() and (fold != k).sum() > 1]
                sse = sum(((y[h] - x[h] @ linalg.section_ridge(x[~h], y[~h], p)) ** 2).sum() for h in held)
                out.append(sse / sum(h.sum() for h in held))
        return np.mean(out)

    for year in (1996, 1998, 2001):
        mine = loss(year, got[year])
        assert all(mine <= loss(year, p) * (1 + 1e-9) for p in (1e-4, 1e-3, 1e-2, 0.1, 0.3, 1.0, 10.0, 1e3, 1e5, got[year] * 0.9, got[year] * 1.1))


def test_whole_vector_moments(spark):
    e = demo.table(spark, SF, "embeddings").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    x = np.stack(e["embedding"].to_numpy()).astype(float)
    n, k = x.shape
    ages = np.arange(n, 0, -1.0)

    emp, bear = np.cov(x.T, ddof=0), (ages % 20) / 100 >= 0.1 - 1e-12
    down = x[:, 0] < x[:, 1]
    c = x - x.mean(0)
    trace, squares, fourth = np.trace(emp), (emp**2).sum(), ((c**2).sum(1) ** 2).mean()
    alpha = min(1.0, max(0.0, ((fourth - squares) / (k * n)) / ((squares - trace**2 / k) / k)))
    w = lambda h, a=ages, y=x: linalg.weighted_covariance(y, 0.5 ** (a / h))
    want = {
        "rk6_weighted_covariance": w(84),
        "rk7_factor_covariance": linalg.with_variances(w(504), w(84)),
        "rk9_ledoit_wolf": (1 - alpha) * emp + alpha * trace / k * np.eye(k),
        "rk10_empirical_covariance": emp,
        "rk13_hyperbolic_variance": linalg.with_variances(w(504), linalg.weighted_covariance(x, 1 / (1 + ages / 42))),
        "rk14_hyperbolic_covariance": linalg.with_variances(linalg.weighted_covariance(x, (1 + ages / (504 / (2**0.5 - 1))) ** -2.0), w(84)),
        "rk17_drawdown_conditioned": linalg.with_variances(w(504, ages[bear], x[bear]), w(84, ages[bear], x[bear])),
        "rk18_downside_semimoment": np.minimum(x, 0).T @ np.minimum(x, 0) / n,
        "rk19_conditional_covariance": np.cov(x[down].T, ddof=0),
    }
    for name, m in want.items():
        got = queries.QUERIES[name](spark, SF).toPandas()
        got = got[got["state"] == "negative"] if "state" in got else got
        assert len(got) == k * (k + 1) // 2 == 2080, name
        assert np.allclose(got["v"], m[got["i"], got["j"]], atol=2e-9), name
        assert "intensity" not in got or np.isclose(got["intensity"].iloc[0], alpha, atol=1e-8)


def test_panel_calendar_folds(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    for name, n in (("cv1_panel_calendar_folds", 5), ("cv4_panel_capped_folds", 7)):
        got = {(r.eom, r.fold) for r in queries.QUERIES[name](spark, SF).collect()}
        counts = [sum(f == k for _, f in got) for k in range(n)]
        assert len(got) == sum(counts) == 83 and max(counts) - min(counts) <= 2, counts
        assert got == set(con.execute(queries.ORACLES[name]).fetchall())
