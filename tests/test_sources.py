import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, price_panel
from tidemill import cli, runs
from tidemill.operators.experiments import best_configs
from tidemill.plans.walkforward import calendar_positions, fold_rows, label_cutoffs, walkforward_plan
from tidemill.sources import market, prices, sinks


@pytest.fixture()
def messy(tmp_path):
    """Dates out of order and with holes, and some that come again with other prices."""
    r = np.random.default_rng(31)
    days = pd.date_range("2021-02-10", "2021-12-07")[r.random(301) < 0.6]
    rows = pd.DataFrame({"Date": days, "Open": 3.0, "High": 9.0, "Low": 1.0, "Close": 2.0 + r.random(len(days)), "Volume": 40})
    rows = pd.concat([rows.sample(frac=1, random_state=2), rows.iloc[3:9].assign(Close=-5.0)])
    rows.to_csv(tmp_path / "QQ.csv", index=False)
    return str(tmp_path)


def brute_plan(days, train, test, step, start):
    """Fold after fold by the calendar months after ``start``."""
    out, months = [], pd.offsets.DateOffset
    start = pd.Timestamp(start)
    for k in range(100):
        begin = start if k == 0 else start.replace(day=1) + months(months=step * k)
        split = begin.replace(day=1) + months(months=train)
        first, last = (days[(days >= a) & (days < b)] for a, b in ((begin, split), (split, split + months(months=test))))
        if split <= days.max() and len(first) and len(last):
            out.append([len(out), *(str(d)[:10] for d in (first.min(), first.max(), last.min(), last.max()))])
    return out


def test_price_csv_keeps_the_first_of_each_date(spark, messy):
    got = prices.load_price_csv(spark, f"{messy}/QQ.csv").orderBy("date").toPandas()
    want = pd.read_csv(f"{messy}/QQ.csv").groupby("Date")["Close"].first()
    np.testing.assert_allclose(got["Close"], want)
    assert (got["Close"] > 0).all() and got["date"].is_unique and got.columns[0] == "date"
    with pytest.raises(ValueError, match="lacks"):
        prices.load_price_csv(spark, f"{messy}/QQ.csv", required_columns=["Nope"])


def test_invalid_dates_are_an_error_for_prices_and_dropped_for_plans(spark, tmp_path):
    (tmp_path / "X.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-01,1,1,1,1,1\nsoon,1,1,1,1,1\n")
    with pytest.raises(ValueError, match="no date"):
        prices.load_price_csv(spark, str(tmp_path / "X.csv"))
    got = prices.load_dates(spark, prices.list_files(spark, str(tmp_path)), directory=str(tmp_path)).collect()
    assert [(r.source_file, str(r.date)[:10]) for r in got] == [("X.csv", "2020-01-01")]


def test_plan_of_a_file(spark, messy):
    dates = prices.load_dates(spark, prices.select_files(spark, messy), directory=messy)
    days = pd.DatetimeIndex(pd.read_csv(f"{messy}/QQ.csv")["Date"].unique())
    for train, test, step, start in ((3, 2, 2, "2021-02-01"), (1, 1, 1, "2021-03-20"), (4, 1, 3, "2020-12-15")):
        plan = walkforward_plan(dates, train_months=train, test_months=test, step_months=step, start_date=start, keys=["source_file"])
        path = sinks.write_plan(plan, os.path.join(messy, "out", "plan.csv"))
        want = brute_plan(days, train, test, step, start)
        assert len(want) >= 2 and [r.split(",") for r in open(path).read().split()] == [["source_file", "fold_id", "train_start", "train_end", "test_start", "test_end"], *[["QQ.csv", *map(str, r)] for r in want]]
        assert sinks.read_plan(spark, path).count() == len(want)
    with pytest.raises(ValueError):
        walkforward_plan(dates, train_months=0, test_months=1)


def test_plan_starts_in_the_middle_of_a_month_and_skips_empty_folds(spark):
    days = [d for d in pd.bdate_range("2020-01-01", "2020-12-31") if d.month != 6]
    cal = spark.createDataFrame([(d.to_pydatetime(),) for d in days], "date timestamp")
    got = walkforward_plan(cal, train_months=2, test_months=1, start_date="2020-01-15").orderBy("fold_id").toPandas()
    assert str(got.train_start[0])[:10] == "2020-01-15" and str(got.train_end[0])[:10] == "2020-02-28" and list(got.fold_id) == list(range(len(got)))
    assert not ((got.test_start >= "2020-06-01") & (got.test_start < "2020-07-01")).any()
    assert (got.train_end < got.test_start).all()


def test_range_join_and_label_cutoff(spark):
    cal = spark.createDataFrame([(d.to_pydatetime(),) for d in pd.bdate_range("2020-01-01", periods=100)], "date timestamp")
    plan = walkforward_plan(cal, train_months=2, test_months=1, start_date="2020-01-01")
    brute = cal.crossJoin(plan).where("date BETWEEN train_start AND test_end").count()
    assert fold_rows(cal, plan, start="train_start", end="test_end").count() == brute
    pos = {r.date: r.pos for r in calendar_positions(cal).collect()}
    for r in label_cutoffs(plan, calendar_positions(cal), 3).collect():
        assert pos[r.train_end] - pos[r.label_cutoff] == 3 and r.on_calendar


def test_panel_aligns_files_with_other_column_orders(spark, tmp_path):
    os.makedirs(tmp_path / "deep")
    (tmp_path / "A.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-01,1,2,0,1.5,10\n2020-01-02,1,2,0,1.6,10\n")
    (tmp_path / "deep" / "B.csv").write_text("Date,Close,Open,High,Low,Volume,Extra\n2020-01-02,9,8,10,7,5,x\n2020-01-03,9,8,10,7,5,y\n")
    got = prices.load_price_panel(spark, str(tmp_path), recursive=True).orderBy("ticker").toPandas()
    assert got[["ticker", "Open", "Close"]].values.tolist() == [["A", 1.0, 1.6], ["B", 8.0, 9.0]] and list(got.columns[:7]) == ["date", "ticker", "Open", "High", "Low", "Close", "Volume"]
    assert prices.load_price_panel(spark, str(tmp_path), recursive=True, intersect_dates=False).count() == 4
    with pytest.raises(FileNotFoundError, match="Z"):
        prices.load_price_panel(spark, str(tmp_path), tickers=["A", "Z"])


def test_dates_with_offsets_keep_their_wall_time(spark):
    df = spark.createDataFrame([("2020-01-02 16:00:00-05:00",), ("2020-01-02T09:30:00Z",), ("2020-01-02",), ("x",)], "d string")
    assert [str(r[0]) for r in df.select(prices.wall_time("d")).collect()] == ["2020-01-02 16:00:00", "2020-01-02 09:30:00", "2020-01-02 00:00:00", "None"]


def fetched(ticker, start, end, auto_adjust):
    if ticker == "BAD":
        raise OSError("unreachable")
    index = pd.DatetimeIndex(["2020-01-02", "2020-01-03"], tz="America/New_York")
    cols = pd.MultiIndex.from_product([["Open", "High", "Low", "Close", "Volume", "Dividends"], [ticker]])
    return pd.DataFrame([[1, 2, 0.5, 1.5, 10, 0], [1, 2, 0.5, 1.8, 20, 0]], index=index, columns=cols)


def test_downloads(spark, tmp_path):
    done, failed = market.download(spark, ["SPY", "BAD"], str(tmp_path), fetch=fetched)
    assert [d.ticker for d in done] == ["SPY"] and list(failed) == ["BAD"] and done[0].rows == 2
    assert open(done[0].path).readline().startswith("Date,Open,High,Low,Close,Volume")
    with pytest.raises(RuntimeError):
        market.download(spark, ["BAD"], str(tmp_path), fetch=fetched)
    assert market.resolve_tickers(["spy, qqq"], "QQQ,xlk") == ["SPY", "QQQ", "XLK"] and market.resolve_tickers() == ["SPY"] and len(market.resolve_tickers(use_default_universe=True)) == 13


def test_source_reads_a_partition_for_each_ticker(spark):
    spark.dataSource.register(market.OhlcvSource)
    got = spark.read.format("ohlcv").option("tickers", "SPY,QQQ").option("fetcher", "tests.test_sources:fetched").load().collect()
    assert sorted({r.ticker for r in got}) == ["QQQ", "SPY"] and len(got) == 4 and got[0].Adj_Close is None


def test_synthetic_prices_are_seeded(spark, tmp_path):
    p = market.synthetic_panel(spark, 3, 10).orderBy("ticker", "date").toPandas()
    assert len(p) == 30 and (p.High >= p[["Open", "Close"]].max(axis=1)).all() and (p.Low <= p[["Open", "Close"]].min(axis=1)).all() and (p.date.dt.dayofweek < 5).all() and p.date.nunique() == 10
    assert p.equals(market.synthetic_panel(spark, 3, 10).repartition(5).orderBy("ticker", "date").toPandas()) and not p.Close.equals(market.synthetic_panel(spark, 3, 10, seed=8).orderBy("ticker", "date").toPandas().Close)
    paths = market.write_synthetic(spark, str(tmp_path), num_tickers=2, years=1)
    assert [os.path.basename(x) for x in paths] == ["DEMO01.csv", "DEMO02.csv"] and len(pd.read_csv(paths[1])) == 252
    with pytest.raises(ValueError):
        market.synthetic_panel(spark, 1, 10)


def row(**x):
    return runs.registry_row(**{"timestamp": "2024-01-01T00:00:00+00:00", "run_type": "single_run", "model_name": "ridge", "parameters": {"b": 1, "a": 2}, "k": 2, "horizon": 1, "path_to_run_dir": "x", **x})


def test_registry_and_champions(spark, tmp_path):
    paths = runs.init_run_paths(str(tmp_path), "demo")
    assert runs.update_champions(spark, paths.registry_path, paths.champions_dir) == []
    runs.append_registry(spark, paths.registry_path, [row(run_name="demo_run_a", sharpe_net=0.4), row(run_name="other", sharpe_net=9.0, run_type="ablation")])
    runs.append_registry(spark, paths.registry_path, [row(run_name="demo_run_b", sharpe_net=0.9, mean_ic=0.1)])
    got = runs.load_registry(spark, paths.registry_path)
    assert got.count() == 3 and got.columns == runs.REGISTRY.names and got.first().parameters == '{"a": 2, "b": 1}'
    written = runs.update_champions(spark, paths.registry_path, paths.champions_dir)
    best = {os.path.basename(p): json.load(open(p)) for p in written}
    assert best["best_by_sharpe.json"]["run_name"] == "demo_run_b" and best["current_etf_xs_champion.json"]["champion_value"] == 0.9 and "note" in best["best_by_sortino.json"]
    with pytest.raises(ValueError):
        runs.registry_row(nope=1)


def test_command_line_end_to_end(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    cli.main(["make-demo", "--out-dir", data, "--num-tickers", "4", "--years", "2"])
    cli.main(["plan", "--input-dir", data, "--out", f"{out}/plan.csv", "--start-date", "2020-01-01", "--train-months", "12", "--test-months", "3", "--step-months", "3"])
    cli.main(["backtest", "--data", f"{data}/DEMO01.csv", "--plan", f"{out}/plan.csv", "--out-dir", out, "--run-name", "bt", "--save-per-fold"])
    assert len(pd.read_csv(f"{out}/bt_fold_summary.csv")) >= 3 and set(pd.read_csv(f"{out}/bt_perf_summary.csv")["series"]) == {"strategy", "benchmark_buy_hold"} and os.path.isdir(f"{out}/folds/fold_id=0")
    cli.main(["sweep", "--data", f"{data}/DEMO01.csv", "--plan", f"{out}/plan.csv", "--out-dir", out, "--n-grid", "10,20", "--step-frac-grid", "0.5"])
    assert len(pd.read_csv(f"{out}/results_grid.csv")) == 2 and "| n |" in open(f"{out}/results_grid_best.md").read()
    months = ["--start-date", "2020-01-01", "--train-months", "12", "--test-months", "3", "--step-months", "3"]
    cli.main(["xs-model", "--input-dir", data, "--out-dir", out, "--run-name", "xs", "--k", "1", *months])
    s = json.load(open(f"{out}/runs/xs/xs_summary.json"))
    assert s["n_tickers"] == 4 and np.isnan(s["spy_total_return"]) and "unavailable" in capsys.readouterr().out
    assert {"predictions.csv", "portfolio_detail.csv", "portfolio_daily.csv", "ic_daily.csv", "spread_daily.csv", "ticker_summary.csv", "plan.csv", "run_config.json"} <= set(os.listdir(f"{out}/runs/xs"))
    cli.main(["xs-ablation", "--input-dir", data, "--out-dir", out, "--run-name", "ab", "--k", "1", "--model-names", "linear,ridge", "--ridge-alphas", "1", *months])
    assert len(pd.read_csv(f"{out}/runs/ab/ablation_summary.csv")) == 2
    cli.main(["strategy-ablation", "--input-dir", data, "--out-dir", out, "--run-name", "st", "--label-horizons", "1", "--k-values", "1,2", "--score-normalizations", "none", "--score-smoothing-methods", "none,ema_3", *months])
    assert len(pd.read_csv(f"{out}/runs/st/strategy_ablation_summary.csv")) == 4
    assert runs.load_registry(spark, f"{out}/run_registry.csv").count() == 7 and os.path.exists(f"{out}/champions/best_by_sharpe.json")


def test_command_line_parsers():
    assert cli.tokens(" a, b,,a ") == ["a", "b"] and cli.numbers("1, 2", int) == [1, 2] and cli.model_params("linear", 1.0, 0.5) == {} and cli.model_params("elasticnet", 1.0, 0.5) == {"alpha": 1.0, "l1_ratio": 0.5} and cli.shown(float("nan")) == "unavailable"
    with pytest.raises(ValueError):
        cli.choices("x", ("none",), "methods")
    a = cli.parser().parse_args(["xs-model", "--input-dir", "d"])
    assert (a.model_name, a.alpha, a.k, a.label_horizon, a.train_months, a.test_months, a.start_date) == ("ridge", 1.0, 3, 1, 9, 1, "2018-01-01")


def test_price_files_are_whole_or_not_there(spark, tmp_path):
    panel = price_panel([f"T{i:03d}" for i in range(60)] + ["a b", "x/y"], 9)
    (tmp_path / "other.csv").write_text("stays")
    made = sinks.write_price_files(frame(spark, panel.sample(frac=1, random_state=1)).repartition(7), str(tmp_path))
    assert len(made) == 62 and sorted(os.listdir(tmp_path)) == sorted([os.path.basename(m) for m in made] + ["other.csv"])
    back = pd.read_csv(tmp_path / "T007.csv")
    own = panel[panel["ticker"] == "T007"]
    assert list(back.columns) == ["Date", "Open", "High", "Low", "Close", "Volume"] and back["Date"].tolist() == [str(d) for d in own["date"]]
    np.testing.assert_array_equal(back["Close"], own["Close"])
    read = prices.load_price_panel(spark, str(tmp_path), tickers=["T001", "x%2Fy", "a b"])
    assert read.count() == 27 and {r.ticker for r in read.select("ticker").distinct().collect()} >= {"T001", "a b"}
    broken = frame(spark, panel).withColumn("ticker", F.when(F.col("ticker") == "T030", F.repeat(F.lit("n"), 300)).otherwise(F.col("ticker")))
    with pytest.raises(Exception, match="too long"):  # a name that no file can have
        sinks.write_price_files(broken, str(tmp_path / "new"))
    assert os.listdir(tmp_path / "new") == []


def test_many_files_with_several_headers(spark, tmp_path):
    """Other orders, other columns, quotes, a byte order mark, an empty file; all values under their own names."""
    for i in range(40):
        names = [["Date", "Close", "Volume"], ["Volume", "Date", "Close"], ['"Close"', '"Date"', '"Extra"', '"Volume"']][i % 3]
        rows = [{"Date": f"2020-01-0{d}", "Close": str(i + d / 10), "Volume": str(100 * i), "Extra": "e"} for d in (1, 2)]
        lines = [",".join(names), *(",".join(r[n.strip('"')] for n in names) for r in rows)]
        (tmp_path / f"f{i:02d}.csv").write_text(("\ufeff" if i == 0 else "") + "\n".join(lines) + "\n", encoding="utf-8")
    files = prices.select_files(spark, str(tmp_path))
    got = {(r["_file"].rsplit("/", 1)[1], r.Date): (r.Close, r.Volume, r.Extra) for r in prices.read_csvs(spark, files, ["Date", "Close"]).collect()}
    assert got == {(f"f{i:02d}.csv", f"2020-01-0{d}"): (str(i + d / 10), str(100 * i), "e" if i % 3 == 2 else None) for i in range(40) for d in (1, 2)}
    with pytest.raises(ValueError, match="lacks columns \\['Extra'\\]"):
        prices.read_csvs(spark, files, ["Date", "Extra"])
    (tmp_path / "g.csv").write_text("")
    with pytest.raises(ValueError, match="header"):
        prices.read_csvs(spark, [*files, str(tmp_path / "g.csv")], ["Date"])


def test_registry_rows_of_a_table(spark, tmp_path):
    path = str(tmp_path / "registry.csv")
    rows = spark.createDataFrame([("a", "single_run", '{"x": 1, "y": "b, c"}', None, 0.5), ("b", "ablation", "", 3, None)], "run_name string, run_type string, parameters string, k int, sharpe_net double")
    runs.append_registry(spark, path, rows)
    runs.append_registry(spark, path, rows.where("false"))
    runs.append_registry(spark, path, [row(run_name="c")])
    got = {r.run_name: r for r in runs.load_registry(spark, path).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].parameters == '{"x": 1, "y": "b, c"}' and (got["a"].k, got["b"].k, got["b"].sharpe_net) == (None, 3, None)
    with pytest.raises(ValueError):
        runs.append_registry(spark, path, rows.withColumnRenamed("k", "nope"))


def test_best_configs_with_ties_and_missing_measures(spark):
    rows = spark.createDataFrame(
        [("x", 20, 0.5, 1.0, None), ("x", 10, 0.5, 1.0, 0.1), ("x", 10, 0.25, 1.0, None), ("y", 10, 0.25, None, None), ("y", 40, 0.25, None, None)],
        "ticker string, n int, step_frac double, mean_fold_sharpe double, total_return double",
    )
    got = {(r.ticker, r.chosen_by): (r.n, r.step_frac) for r in best_configs(rows, keys=["ticker"]).collect()}
    assert got == {("x", "mean_fold_sharpe"): (10, 0.25), ("x", "total_return"): (10, 0.5), ("y", "mean_fold_sharpe"): (10, 0.25), ("y", "total_return"): (10, 0.25)}
    assert best_configs(rows.where("false")).count() == 0


def test_results_are_read_with_their_types(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 0.1, "a, \"b\"", True), (2, 7, None, None, None)], "a long, b int, c double, d string, e boolean").withColumn("t", F.lit("2020-01-02").cast("timestamp"))
    one, many = sinks.write_csv(rows, str(tmp_path / "one.csv"), order=["a"]), sinks.write_csv_folder(rows, str(tmp_path / "many"), order=["a"])
    for path in (one, many):
        assert sinks.read_results(spark, path, dict(rows.dtypes)).orderBy("a").collect() == rows.orderBy("a").collect()
