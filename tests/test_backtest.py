from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import asset, folds, frame
from tidemill.operators import metrics
from tidemill.operators.backtest import ZScoreConfig, backtest_logret, backtest_ret, rate_limited, walkforward_backtest, zscore_position

CFG = ZScoreConfig(n=20, K=1.0, step_frac=0.25)


def signal(spark, pdf):
    return zscore_position(frame(spark, pdf), cfg=CFG).select("date", "z", "target_pos", "pos").toPandas().sort_values("date").reset_index(drop=True)


@pytest.mark.parametrize("known", [30, 97, 159])
def test_later_prices_do_not_change_earlier_signals(spark, known):
    a = asset()
    b = a.copy()
    b.loc[known:, "Close"] = b["Close"].iloc[known:].to_numpy()[::-1] ** 1.5
    whole = signal(spark, a)
    pd.testing.assert_frame_equal(whole[:known], signal(spark, b)[:known])
    pd.testing.assert_frame_equal(whole[:known], signal(spark, a[:known]))
    assert whole["pos"].abs().max() > 0


def test_rate_limit_moves_by_a_step_and_stays_within_bounds(spark):
    rows = spark.createDataFrame([(i, 5.0 if i < 6 else -5.0) for i in range(12)], "t int, x double").withColumn("g", F.lit(0))
    got = [r.p for r in rate_limited(rows, target="x", out="p", keys=["g"], order=["t"], K=1.0, step_frac=0.25).orderBy("t").collect()]
    assert got == [0.25, 0.5, 0.75, 1.0, 1.0, 1.0, 0.75, 0.5, 0.25, 0.0, -0.25, -0.5]


def test_pnl_is_the_lagged_position_times_the_return(spark):
    """A row's position is paid by the next row's return; costs follow the change of position."""
    r = np.random.default_rng(40)
    moves, held = r.normal(0, 0.03, 25), r.uniform(-2, 2, 25)
    table = pd.DataFrame({"date": pd.date_range("2019-05-06", periods=25, freq="W-MON"), "ret": moves, "pos": held})
    got = backtest_ret(frame(spark, table), cost_bps=35).orderBy("date").toPandas()
    paid = np.array([0.0, *(held[i - 1] * moves[i] for i in range(1, 25))])
    traded = np.array([0.0, *(abs(held[i] - held[i - 1]) for i in range(1, 25))])
    left = paid - traded * 0.0035
    for name, want in {"pnl_gross": paid, "turnover": traded, "pnl": left, "cum_pnl": left.cumsum(), "equity": (1 + left).cumprod()}.items():
        np.testing.assert_allclose(got[name], want, atol=1e-12)


def test_log_returns_leave_missing_rows_missing(spark):
    days = pd.date_range("2024-01-01", periods=4)
    rows = frame(spark, pd.DataFrame({"date": days, "pos": [1.0, 1, 1, 1], "log_ret": [0.1, 0.2, None, 0.3]}))
    got = backtest_logret(rows).orderBy("date").collect()
    assert [r.pnl for r in got] == [None, 0.2, None, 0.3]
    assert [r.equity if r.equity is None else round(r.equity, 9) for r in got] == [None, round(np.exp(0.2), 9), None, round(np.exp(0.5), 9)]


def test_walkforward_returns_test_rows_and_begins_each_fold_anew(spark):
    a = asset()
    plan = folds(a["date"])
    got = walkforward_backtest(frame(spark, a), spark.createDataFrame(plan), cfg=CFG, check=True).toPandas().sort_values(["fold_id", "date"])
    assert got.groupby("fold_id").size().to_dict() == {i: 15 for i in range(5)}
    assert list(got.columns[:5]) == ["fold_id", "train_start", "train_end", "test_start", "test_end"]
    for i, g in got.groupby("fold_id"):
        np.testing.assert_allclose(g["equity"], (1 + g["pnl"]).cumprod())
        span = a[(a["date"] >= plan.train_start[i]) & (a["date"] <= plan.test_end[i])]
        np.testing.assert_allclose(g["pos"], signal(spark, span)["pos"][-15:])  # by the fold's own rows alone


def test_folds_without_rows_and_sources_are_errors(spark):
    a = asset()
    plan = folds(a["date"]).assign(source_file="X.csv")
    late = plan.assign(test_start=pd.Timestamp("2030-01-01"), test_end=pd.Timestamp("2030-02-01"))
    with pytest.raises(ValueError, match="without test rows"):
        walkforward_backtest(frame(spark, a), spark.createDataFrame(late), check=True)
    with pytest.raises(ValueError, match="no folds"):
        walkforward_backtest(frame(spark, a), spark.createDataFrame(plan), source_file="Y.csv")
    with pytest.raises(ValueError):
        ZScoreConfig(n=1).checked()


def test_equal_folds_have_equal_returns(spark):
    rows = [(f, datetime(2024, 1, 1) + timedelta(days=10 * f + i), x) for f in (1, 2) for i, x in enumerate([0.01, -0.02, 0.03])]
    got = metrics.fold_summary(spark.createDataFrame(rows, "fold_id int, date timestamp, pnl double")).toPandas()
    assert got["total_return"].nunique() == 1 and got["n_test_rows"].tolist() == [3, 3]


def test_repeated_dates_are_an_error_or_summed(spark):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t, 0.1), (t, 0.2), (t + timedelta(days=1), 0.1)], "date timestamp, pnl double")
    with pytest.raises(ValueError, match="repeat"):
        metrics.stitched_curve(rows)
    got = metrics.stitched_curve(rows, on_duplicates="sum", window=None).orderBy("date").toPandas()
    np.testing.assert_allclose(got["equity"], [1.3, 1.43])


def test_rolling_sharpe_against_pandas(spark):
    a = asset()
    got = metrics.stitched_curve(frame(spark, a.rename(columns={"ret": "pnl"})), window=63).orderBy("date").toPandas()
    x = a["ret"]
    want = x.rolling(63, min_periods=21).mean() / x.rolling(63, min_periods=21).std(ddof=0) * np.sqrt(252)
    np.testing.assert_allclose(got["rolling_sharpe"].astype(float)[20:], want[20:], rtol=1e-6)


def test_sortino(spark):
    def of(xs):
        return spark.createDataFrame([(x,) for x in xs], "x double").agg(metrics.sortino(F.col("x"), 0.0, 4).alias("s")).first().s

    assert of([0.01, -0.02, 0.03, -0.01]) == pytest.approx(1.0)
    assert of([0.01, 0.02]) is None and of([0.01, -0.02, -0.02]) is None


def test_add_pnl_uses_equity_less_start(spark):
    days = pd.date_range("2024-01-01", periods=3)
    rows = frame(spark, pd.DataFrame({"date": days, "pos": [1.0, 1, 1], "ret": [0.5, 0.1, 0.1]}))
    got = metrics.add_pnl(rows, start=2.0).orderBy("date").toPandas()
    np.testing.assert_allclose(got["equity"], [2, 2.2, 2.42])
    np.testing.assert_allclose(got["cum_pnl"], [0, 0.2, 0.42])
