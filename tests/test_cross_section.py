import numpy as np
import pandas as pd
import pytest

from tests.helpers import frame, price_panel
from tidemill.operators import metrics
from tidemill.operators.experiments import Experiment, model_ablation, run_experiment, strategy_ablation, training_moments, walkforward_predictions
from tidemill.operators.features import FEATURES, add_forward_return_label, add_forward_return_labels, make_daily_features
from tidemill.operators.models import fit_all, fit_model, merged, moments, resolve_model_params, solve_batch
from tidemill.operators.portfolio import ticker_selection, top_bottom_portfolio
from tidemill.operators.signals import normalize_scores, prepare_scores, smooth_scores
from tidemill.plans.grids import ModelSpec, model_grid, strategy_grid, sweep_grid


def features(spark, pdf):
    return make_daily_features(frame(spark, pdf)).toPandas().sort_values(["date", "ticker"]).reset_index(drop=True)


def test_features_against_pandas_and_without_future(spark):
    p = price_panel()
    got = features(spark, p.iloc[::-1])
    for t, g in p.groupby("ticker"):
        mine = got[got.ticker == t].reset_index(drop=True)
        c, v = g["Close"].reset_index(drop=True), g["Volume"].reset_index(drop=True)
        r = c.pct_change()
        for name, want in {"ret_5d": c.pct_change(5), "vol_20d": r.rolling(20).std(), "dist_ma_5": c / c.rolling(5).mean() - 1, "vol_ratio_20": v / v.rolling(20).mean()}.items():
            np.testing.assert_allclose(mine[name].astype(float), want, rtol=1e-9, equal_nan=True)
    q = p.copy()
    q.loc[q.date > "2020-01-28", "Close"] *= 7
    pd.testing.assert_frame_equal(got[got.date <= "2020-01-28"], features(spark, q)[lambda x: x.date <= "2020-01-28"])


def test_labels(spark):
    days = pd.date_range("2020-01-01", periods=6)
    p = pd.DataFrame([(d, t, b * 1.1**i) for t, b in (("AAA", 100.0), ("BBB", 50.0)) for i, d in enumerate(days)], columns=["date", "ticker", "Close"])
    got = add_forward_return_labels(frame(spark, p), (1, 3, 5, 3)).where("ticker = 'AAA'").orderBy("date").toPandas()
    np.testing.assert_allclose(got["label_3d_fwd"].astype(float), [0.331] * 3 + [np.nan] * 3)
    np.testing.assert_allclose(got["label_5d_fwd"].astype(float), [0.61051] + [np.nan] * 5)
    with pytest.raises(ValueError):
        add_forward_return_label(frame(spark, p), 0)


def scores(spark, rows):
    return spark.createDataFrame(rows, "date string, ticker string, score double")


def test_normalisation(spark):
    s = scores(spark, [("a", "A", 1.0), ("a", "B", 2.0), ("a", "C", 3.0), ("b", "A", 2.0), ("b", "B", 2.0), ("b", "C", 2.0), ("c", "A", None), ("c", "B", 5.0)])
    z = [r.score_normalized for r in normalize_scores(s, normalization="zscore").orderBy("date", "ticker").collect()]
    assert z == [pytest.approx(-1.224744871391589), 0.0, pytest.approx(1.224744871391589), 0.0, 0.0, 0.0, None, 0.0]
    r = [x.score_normalized for x in normalize_scores(s, normalization="rank_to_minus1_plus1").orderBy("date", "ticker").collect()]
    assert r == [-1.0, 0.0, 1.0, 0.0, 0.0, 0.0, None, 0.0]
    with pytest.raises(ValueError):
        normalize_scores(s, normalization="best")


def test_ema_with_gaps_against_pandas(spark):
    x = [None, 1.0, 2.0, None, None, 10.0, 4.0, None, 3.0]
    s = scores(spark, [(f"2020-01-{i + 1:02d}", t, v) for t in ("A", "B") for i, v in enumerate(x)])
    got = smooth_scores(s, smoothing="ema_3").where("ticker = 'A'").orderBy("date").toPandas()["score_smoothed"].astype(float)
    p = pd.Series(x, dtype=float)
    np.testing.assert_allclose(got, p.ewm(span=3, adjust=False, ignore_na=False).mean().where(p.notna()), rtol=1e-12)


def test_missing_scores_stay_missing(spark):
    s = scores(spark, [("a", "A", None), ("a", "B", 1.0), ("b", "A", 2.0), ("b", "B", 3.0)])
    got = prepare_scores(s, smoothing="ema_3", normalization="zscore").where("date = 'a' AND ticker = 'A'").first()
    assert got.score_signal is None


def test_top_and_bottom(spark):
    """Three days of seven tickers, held against sorted lists."""
    r = np.random.default_rng(17)
    rows = [(f"d{d}", t, float(s), float(x)) for d in range(3) for t, s, x in zip("ABCDEFG", r.permutation(7), r.normal(0, 0.01, 7).round(4))]
    detail, daily = top_bottom_portfolio(spark.createDataFrame(rows, "date string, ticker string, score double, label double"), forward_ret_col="label", k=3, cost_bps=10)
    was, longs, want = {}, {t: 0 for t in "ABCDEFG"}, []
    for d in range(3):
        own = sorted((x for x in rows if x[0] == f"d{d}"), key=lambda x: x[2])
        now = {x[1]: -1 / 3 for x in own[:3]} | {x[1]: 1 / 3 for x in own[-3:]}
        for x in own[-3:]:
            longs[x[1]] += 1
        gross = sum(x[3] for x in own[-3:]) / 3 - sum(x[3] for x in own[:3]) / 3
        want.append((gross, sum(abs(now.get(t, 0) - was.get(t, 0)) for t in "ABCDEFG") / 2))
        was = now
    got = daily.orderBy("date").toPandas()
    np.testing.assert_allclose(got[["portfolio_ret_gross", "turnover"]], want, atol=1e-12)
    np.testing.assert_allclose(got["gross_exposure"], 2.0)
    np.testing.assert_allclose(got["portfolio_ret_net"], got["portfolio_ret_gross"] - got["turnover"] * 0.001)
    t = ticker_selection(detail).toPandas().set_index("ticker")
    assert t["n_long_days"].to_dict() == longs and t.loc["A", "selection_rate_long"] == pytest.approx(longs["A"] / 3)
    s = metrics.long_short_spread(detail).orderBy("date").toPandas()
    np.testing.assert_allclose(s["spread"], [w[0] for w in want], atol=1e-12)


def test_short_side_takes_tied_rows_and_constant_days_stay_flat(spark):
    rows = [("d1", t, v, 0.01) for t, v in (("A", 1.0), ("B", 1.0), ("C", 1.0), ("D", 2.0))] + [("d2", t, 0.0, 0.01) for t in "ABCD"] + [("d3", "A", 1.0, None), ("d3", "B", 2.0, 0.1)]
    p = spark.createDataFrame(rows, "date string, ticker string, score double, label double")
    detail, daily = top_bottom_portfolio(p, forward_ret_col="label", k=2)
    w = {(r.date, r.ticker): r.weight for r in detail.collect()}
    assert [w["d1", t] for t in "ABCD"] == [-0.5, -0.5, 0.0, 0.5]
    d = {r.date: r for r in daily.collect()}
    assert d["d2"].is_constant_score_day and d["d2"].gross_exposure == 0 and d["d3"].is_constant_score_day and d["d3"].n_valid_scores == 1


def test_ic(spark):
    p = spark.createDataFrame([("a", "A", 1.0, 1.0), ("a", "B", 2.0, 2.0), ("a", "C", 3.0, 3.0), ("b", "A", 1.0, 3.0), ("b", "B", 2.0, 2.0), ("b", "C", 3.0, 1.0), ("c", "A", None, 1.0)], "date string, ticker string, score double, label double")
    ic = metrics.daily_ic(p, forward_ret_col="label")
    got = {r.date: r for r in ic.collect()}
    assert got["a"].ic_pearson == pytest.approx(1) and got["b"].ic_spearman == pytest.approx(-1) and got["c"].n_assets == 0 and got["c"].ic_pearson is None
    s = metrics.ic_summary(ic).first()
    assert s.mean_ic == pytest.approx(0) and s.ic_std == pytest.approx(1) and s.n_ic_days == 2


def test_benchmarks(spark):
    t = list(pd.date_range("2024-01-01", periods=3).to_pydatetime())
    rows = [(d, k, v) for k, vs in {"AAA": (0.01, 0.0, 0.02), "BBB": (0.02, -0.01, None), "SPY": (0.03, 0.0, None)}.items() for d, v in zip(t, vs)]
    pred = spark.createDataFrame(rows, "date timestamp, ticker string, label double")
    daily = spark.createDataFrame([(d, 1.0 + i) for i, d in enumerate(t)], "date timestamp, equity double")
    got = metrics.benchmark_curves(pred, daily, label_col="label").orderBy("date").toPandas()
    np.testing.assert_allclose(got["spy_equity"], [1.03, 1.03, 1.03])
    np.testing.assert_allclose(got["eq_universe_equity"].iloc[0], 1.02)
    none = metrics.benchmark_curves(pred.where("ticker <> 'SPY'"), daily, label_col="label")
    assert none.where("spy_equity IS NOT NULL").count() == 0
    assert metrics.benchmark_summary(none, return_col="spy_return", prefix="spy").first().spy_total_return is None


def test_model_parameters():
    assert resolve_model_params(" Ridge ") == {"alpha": 1.0} and resolve_model_params("elasticnet", {"alpha": 0.1}) == {"alpha": 0.1, "l1_ratio": 0.5}
    for bad in (("tree", {}), ("linear", {"alpha": 1}), ("lasso", {"alpha": 0}), ("elasticnet", {"l1_ratio": 2}), ("ridge", {"alpha": float("nan")})):
        with pytest.raises(ValueError):
            resolve_model_params(*bad)


def test_models_against_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -0.5, 0.0] + 0.3 + rng.normal(size=300) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    sd = y.std()
    for name, params, reg, l1 in (("linear", {}, 0.0, 0.0), ("ridge", {"alpha": 2.0}, 2.0 * sd / 300, 0.0), ("lasso", {"alpha": 0.05}, 0.05, 1.0), ("elasticnet", {"alpha": 0.05, "l1_ratio": 0.5}, 0.025 + 0.025 * sd, 0.025 / (0.025 + 0.025 * sd))):
        b, w = fit_model(df, ["a", "b", "c"], label_col="y", model_name=name, model_params=params)
        m = LinearRegression(featuresCol="f", labelCol="y", regParam=reg, elasticNetParam=l1, standardization=False, tol=1e-12, maxIter=1000, solver="normal" if l1 == 0 else "auto").fit(rows)
        np.testing.assert_allclose(w, m.coefficients.toArray(), atol=1e-6)
        assert b == pytest.approx(m.intercept, abs=1e-6)
    with pytest.raises(ValueError):
        fit_model(df.where("a > 100"), ["a"], label_col="y")


@pytest.fixture(scope="module")
def experiment(spark):
    p = price_panel(("AAA", "BBB", "CCC", "DDD"), 60)
    days = sorted(p["date"].unique())
    plan = pd.DataFrame([{"fold_id": 0, "train_start": days[0], "train_end": days[39], "test_start": days[40], "test_end": days[49]}])
    return add_forward_return_labels(make_daily_features(frame(spark, p)), (1, 3)).persist(), spark.createDataFrame(plan)


def test_experiment_summary(experiment):
    panel, plan = experiment
    got = run_experiment(panel, plan, Experiment("label_1d_fwd", k=1, normalization="zscore", smoothing="ema_3"))
    s = got["summary"]
    assert s["model_params"] == {"alpha": 1.0} and s["n_folds"] == 1 and s["n_prediction_rows"] == 40 and s["n_portfolio_days"] == 10 and s["n_constant_score_days"] == 0 and s["n_tickers"] == 4
    assert {"mean_ic", "ic_ir", "mean_spread", "total_return_net", "sharpe_net", "mean_turnover", "n_traded_days"} <= set(s)
    linear = run_experiment(panel, plan, Experiment("label_1d_fwd", model=ModelSpec("linear"), k=1))["summary"]
    assert linear["alpha"] == 1.0 and linear["model_params"] == {}


def test_training_stops_before_labels_of_the_test_period(experiment):
    panel, plan = experiment
    _, one = training_moments(panel, plan, features=["ret_1d"], labels={1: "label_1d_fwd"})
    _, three = training_moments(panel, plan, features=["ret_1d"], labels={3: "label_3d_fwd"})
    _, both = training_moments(panel, plan, features=["ret_1d"], labels={1: "label_1d_fwd", 3: "label_3d_fwd"})
    assert {m["horizon"]: m["n"] for m in both.collect()} == {1: one.first()["n"], 3: three.first()["n"]} == {1: 4 * 38, 3: 4 * 36}
    with pytest.raises(ValueError, match="too little history"):
        training_moments(panel, plan, features=["ret_1d"], labels={100: "label_1d_fwd"})


def test_grids_equal_single_runs(experiment):
    panel, plan = experiment
    specs = model_grid(("linear", "ridge"), ridge_alphas=(1.0,))
    rows = {r.experiment_name: r for r in model_ablation(panel, plan, specs, label_col="label_1d_fwd", k=1).collect()}
    one = run_experiment(panel, plan, Experiment("label_1d_fwd", k=1))["summary"]
    assert set(rows) == {"linear", "ridge__alpha_1"}
    for c in ("mean_ic", "total_return_net", "mean_turnover", "mean_spread"):
        assert rows["ridge__alpha_1"][c] == pytest.approx(one[c])
    rows = {r.experiment_name: r for r in strategy_ablation(panel, plan, strategy_grid((1, 3), (1,), ("zscore",), ("none", "ema_3")), model_name="ridge", model_params={"alpha": 1.0}).collect()}
    one = run_experiment(panel, plan, Experiment("label_3d_fwd", 3, k=1, normalization="zscore", smoothing="ema_3"))["summary"]
    assert len(rows) == 4
    for c in ("mean_ic", "total_return_net", "mean_turnover", "mean_spread"):
        assert rows["h3__k1__norm_zscore__smooth_ema_3"][c] == pytest.approx(one[c])
    assert (len(model_grid()), len(strategy_grid()), len(sweep_grid())) == (13, 54, 6)


def _folds(days):
    """Folds that overlap, one inside another, one with the same training window as another."""
    at = [(0, 39, 40, 49), (5, 44, 45, 54), (10, 29, 40, 49), (0, 39, 50, 59), (20, 39, 45, 49)]
    return pd.DataFrame([{"fold_id": i, "train_start": days[a], "train_end": days[b], "test_start": days[c], "test_end": days[d]} for i, (a, b, c, d) in enumerate(at)])


@pytest.mark.parametrize("keys", [(), ("ticker",)])
def test_moments_of_intervals_make_those_of_folds(spark, experiment, keys):
    panel, _ = experiment
    rows = panel.toPandas().sort_values(["ticker", "date"])
    days = sorted(rows["date"].unique())
    plan, columns = _folds(days), ["ret_1d", "ret_5d"]
    _, found = training_moments(panel, spark.createDataFrame(plan), features=columns, labels={1: "label_1d_fwd", 3: "label_3d_fwd"}, keys=keys)
    got = found.collect()
    assert len(got) == 5 * 2 * (4 if keys else 1)
    for r in got:
        f = plan.loc[r.fold_id]
        own = rows[(rows["date"] >= f.train_start) & (rows["date"] <= days[days.index(f.train_end) - r.horizon])]
        own = own[own["ticker"] == r.ticker] if keys else own
        x = own[[*columns, f"label_{r.horizon}d_fwd"]].dropna().to_numpy(float)
        n, mean, cov = merged(np.array([p.n for p in r.parts], float), np.array([p["mean"] for p in r.parts]), np.array([p.cov for p in r.parts]))
        assert n == r.n == len(x)
        np.testing.assert_allclose(mean, x.mean(axis=0), rtol=1e-12)
        np.testing.assert_allclose(cov, np.cov(x.T, bias=True), rtol=1e-11)


def test_models_of_each_ticker(spark, experiment):
    panel, _ = experiment
    plan = spark.createDataFrame(_folds(sorted(r.date for r in panel.select("date").distinct().collect())))
    both = walkforward_predictions(panel, plan, features=["ret_1d", "ret_5d"], label_col="label_1d_fwd", model_params={"alpha": 0.5}, keys=["ticker"])
    own = walkforward_predictions(panel.where("ticker = 'CCC'"), plan, features=["ret_1d", "ret_5d"], label_col="label_1d_fwd", model_params={"alpha": 0.5})
    a = both.where("ticker = 'CCC'").orderBy("fold_id", "date").toPandas()["score"]
    np.testing.assert_allclose(a, own.orderBy("fold_id", "date").toPandas()["score"], rtol=1e-9)
    late = panel.where("ticker <> 'DDD' OR label_3d_fwd IS NULL")
    assert walkforward_predictions(late, plan, features=["ret_1d"], label_col="label_3d_fwd", horizon=3, keys=["ticker"]).where("ticker = 'DDD' AND score IS NOT NULL").count() == 0


def test_descent_reaches_the_minimum_for_a_batch():
    """Optimality conditions of every model, and a path equals separate fits."""
    r = np.random.default_rng(23)
    xs = [r.normal(size=(80, 4)) @ np.diag(r.uniform(0.1, 2, 4)) for _ in range(12)]
    xs[3][:, 2] = xs[3][:, 1]  # equal columns
    xs[4][:, 0] = 0.0
    all_ = [np.c_[x, x @ [1.0, -0.5, 0.2, 0.0] + r.normal(size=80) * 0.3] for x in xs]
    n, mean, cov = np.full(12, 80.0), np.array([x.mean(axis=0) for x in all_]), np.array([np.cov(x.T, bias=True) for x in all_])
    specs = [("lasso", {"alpha": a}) for a in (0.01, 0.3, 0.05)] + [("elasticnet", {"alpha": a, "l1_ratio": 0.5}) for a in (0.02, 0.2)]
    for (name, params), (_, w) in zip(specs, solve_batch(n, mean, cov, specs), strict=True):
        l1 = params["alpha"] * params.get("l1_ratio", 1.0)
        slope = cov[:, :-1, -1] - np.einsum("mjk,mk->mj", cov[:, :-1, :-1], w) - (params["alpha"] - l1) * w
        np.testing.assert_allclose(np.where(w != 0, slope - l1 * np.sign(w), 0), 0, atol=1e-9)
        assert (np.abs(slope) <= l1 + 1e-9).all()
        alone = solve_batch(n, mean, cov, [(name, params)])[0][1]
        np.testing.assert_allclose(np.delete(w, 3, 0), np.delete(alone, 3, 0), atol=1e-9)


def test_coefficients_hold_every_model(spark):
    rows = spark.createDataFrame([(f, float(x), float(f * x + 1)) for f in (2, 3) for x in range(5)], "fold_id int, x double, y double")
    found = moments(rows, ["x"], "y").selectExpr("fold_id", "array(struct(n, mean, cov)) AS parts")
    got = {(r.spec_id, r.fold_id): (r._intercept, r._weights) for r in fit_all(found, [("linear", {}), ("lasso", {"alpha": 1e-9})], ["x"]).collect()}
    assert set(got) == {(s, f) for s in (0, 1) for f in (2, 3)}
    for (_, f), (b, w) in got.items():
        assert b == pytest.approx(1, abs=1e-6) and w == [pytest.approx(f, abs=1e-6)]
