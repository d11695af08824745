"""Folds that overlap: a panel's rows are stored once, and each fold has the results that its own rows alone give."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame
from tidemill.functions import scan
from tidemill.operators.backtest import ZScoreConfig, walkforward_backtest

SHOWN = ["z", "target_pos", "pos", "pos_lag", "ret", "turnover", "cost", "pnl_gross", "pnl", "cum_pnl", "equity"]


def months(n, first=datetime(2020, 1, 1), train=3):
    """Folds of so many months and one of test, each a month later than the one before."""
    at = [first + pd.DateOffset(months=i) for i in range(n + train + 1)]
    back = pd.Timedelta(seconds=1)
    return pd.DataFrame([{"fold_id": i, "train_start": at[i], "train_end": at[i + train] - back, "test_start": at[i + train], "test_end": at[i + train + 1] - back} for i in range(n)])


def series(name, n, start="2020-01-01", freq="h", seed=0):
    r = np.random.default_rng(seed)
    moves = r.normal(0, 0.01, n)
    price = np.where(r.random(n) < 0.003, np.nan, 50 * np.cumprod(1 + moves))
    return pd.DataFrame({"ticker": name, "date": pd.date_range(start, periods=n, freq=freq), "Close": price, "ret": np.where(r.random(n) < 0.01, np.nan, moves)})


def by_fold(spark, table, plan, cfg):
    """Each ticker by itself, dealt by fold."""
    each = [walkforward_backtest(frame(spark, g.drop(columns="ticker")), plan, cfg=cfg, cost_bps=5.0).withColumn("ticker", F.lit(t)).toPandas() for t, g in table.groupby("ticker")]
    return pd.concat(each)


@pytest.mark.parametrize("parts, step", [("1", 0.25), ("5", 0.25), ("5", 0.1)])
def test_rows_are_stored_once_and_folds_are_right(spark, monkeypatch, parts, step):
    """A series over several tasks and several batches, between short ones, one of which has no fold's test rows."""
    table = pd.concat([series("a", 40, "2020-03-28", "3D", 1), series("b", 11_000, seed=2), series("c", 300, "2020-02-10", "D", 3), series("d", 12, "2020-01-02", "D", 4), series("e", 19, "2020-03-20", "D", 5)])
    plan = spark.createDataFrame(months(9))
    cfg = ZScoreConfig(n=20, K=1.0, step_frac=step)
    want = by_fold(spark, table, plan, cfg)
    stored = []
    monkeypatch.setattr(scan, "settle", lambda df, own=scan.settle: (out := own(df), stored.append(out.count()))[0])
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = walkforward_backtest(frame(spark, table).repartition(3), plan, keys=["ticker"], cfg=cfg, cost_bps=5.0)
        got = df.toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    assert stored == [len(table)]  # 27,609 by fold
    assert len(got) == len(want) > 6000 and set(got.columns) == set(want.columns)
    at = ["ticker", "fold_id", "date"]
    got, want = (x.sort_values(at).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got[at], want[at])
    for c in SHOWN:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)


def test_batches_of_one_long_series(spark, monkeypatch):
    """More rows by fold than a batch holds, all in one task."""
    table = pd.concat([series("a", 50, freq="D", seed=1), series("b", 30_000, freq="20min", seed=2), series("z", 400, freq="D", seed=3)])
    plan = spark.createDataFrame(months(9))
    assert 3.5 * 30_000 > scan.ROWS
    want = by_fold(spark, table, plan, ZScoreConfig())
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = walkforward_backtest(frame(spark, table), plan, keys=["ticker"], cost_bps=5.0).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    at = ["ticker", "fold_id", "date"]
    got, want = (x.sort_values(at).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got[at], want[at])
    for c in SHOWN:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)


def test_a_z_of_fewer_rows_is_taken_by_fold(spark):
    table = pd.concat([series("a", 200, freq="D", seed=1), series("b", 150, freq="D", seed=2)])
    plan, cfg = spark.createDataFrame(months(2)), ZScoreConfig(n=20, min_periods=3)
    got = walkforward_backtest(frame(spark, table), plan, keys=["ticker"], cfg=cfg, cost_bps=5.0).toPandas()
    at = ["ticker", "fold_id", "date"]
    got, want = (x.sort_values(at).reset_index(drop=True) for x in (got, by_fold(spark, table, plan, cfg)))
    np.testing.assert_allclose(got["z"].astype(float), want["z"].astype(float), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(got["pos"], want["pos"], atol=1e-12)


def test_columns_that_the_result_has(spark):
    """Without the price the other columns are the same, in each of the two ways."""
    table = series("a", 200, freq="D", seed=1)
    plan = spark.createDataFrame(months(2))
    df = frame(spark, table).withColumns({"more": F.lit(1.0), "held": F.col("ret") / 2, "log_ret": F.lit(0.5)})
    for cfg in (ZScoreConfig(), ZScoreConfig(min_periods=3)):
        whole = walkforward_backtest(df, plan, keys=["ticker"], ret_col="held", cfg=cfg)
        got = walkforward_backtest(df, plan, keys=["ticker"], ret_col="held", cfg=cfg, columns=["more"])
        assert set(whole.columns) - set(got.columns) == {"Close", "held", "log_ret"} and "more" in got.columns
        assert got.orderBy("date", "fold_id").collect() == whole.select(got.columns).orderBy("date", "fold_id").collect()
