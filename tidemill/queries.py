"""The registered queries: each operator on a panel of weekly bars made of the order lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.scan import compounded
from tidemill.functions.series import over
from tidemill.operators import metrics
from tidemill.operators.backtest import ZScoreConfig, backtest_logret, rate_limited, walkforward_backtest, zscore_position
from tidemill.operators.experiments import Experiment, best_configs, model_ablation, param_sweep, run_experiment, strategy_ablation, walkforward_predictions
from tidemill.operators.features import FEATURES, add_forward_return_labels, make_daily_features
from tidemill.operators.models import complete
from tidemill.operators.portfolio import portfolio_daily, ticker_selection, top_bottom_weights
from tidemill.operators.returns import add_returns, ensure_returns, first_of_each
from tidemill.operators.signals import normalize_scores, prepare_scores, smooth_scores
from tidemill.plans.grids import model_grid, strategy_grid, sweep_grid
from tidemill.plans.walkforward import as_of, calendar_positions, fold_rows, label_cutoffs, shared_calendar, walkforward_plan
from tidemill.reporting import compared_curves, curves_of_first_folds, drawdown_data
from tidemill.runs import REGISTRY, append_registry, champions, load_registry
from tidemill.schema import PLAN_COLUMNS, PRICE_COLUMNS, number
from tidemill.shared import freeing, keep, passing_path, settle, stored
from tidemill.sources.files import write_named
from tidemill.sources.prices import bars_from_trades, load_dates, load_price_csv, load_price_panel, panel_from_trades, select_files
from tidemill.sources.sinks import read_plan, read_results, read_table, write_csv, write_csv_folder, write_plan, write_price_files, write_table

Query = Callable[[SparkSession, str], DataFrame]
PLAN = {"train_months": 12, "test_months": 3, "step_months": 3, "start_date": "1995-01-15"}
COST = 10.0
#: The bars' prices are those of unlike parts and multiply within weeks; curves hold a five-hundredth of the capital in them.
SHARE = 500.0


def rounded(df: DataFrame, digits: int = 8, **others: int) -> DataFrame:
    """Doubles rounded (``others``: digits by column), without negative zeros."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.round(c, others.get(c, digits)) + F.lit(0.0) for c, t in kinds.items() if t == "double"})


def panel(spark: SparkSession, d: str) -> DataFrame:
    return panel_from_trades(spark, d)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return add_forward_return_labels(make_daily_features(panel(spark, d)))


def plan_of(rows: DataFrame) -> DataFrame:
    return walkforward_plan(rows.select("date"), **PLAN)


def plan(spark: SparkSession, d: str) -> DataFrame:
    return plan_of(panel(spark, d))


def kept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The labelled panel and its plan for queries that read them in several jobs."""
    rows = keep(labelled(spark, d))
    return rows, keep(plan_of(rows))


def kept_share(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """As ``kept``, with labels that are returns of the share of the capital that is held."""
    rows = labelled(spark, d)
    rows = keep(rows.withColumns({c: F.col(c) / F.lit(SHARE) for c in rows.columns if c.startswith("label_")}))
    return rows, keep(plan_of(rows))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Momentum: the return over five bars as a score for the next, with a five-hundredth of the capital."""
    return labelled(spark, d).select("date", "ticker", F.col("ret_5d").alias("score"), (F.col("label_1d_fwd") / F.lit(SHARE)).alias("forward_ret"))


def weights(spark: SparkSession, d: str) -> DataFrame:
    return top_bottom_weights(scores(spark, d), k=2)


def days(spark: SparkSession, d: str) -> DataFrame:
    return portfolio_daily(weights(spark, d), cost_bps=COST)


def held(rows: DataFrame) -> DataFrame:
    """Returns of the share of the capital that is held."""
    rows = add_returns(rows, "Close", keys=["ticker"])
    return rows.withColumns({"ret_held": F.col("ret") / F.lit(SHARE), "log_held": F.col("log_ret") / F.lit(SHARE)})


def positions(spark: SparkSession, d: str) -> DataFrame:
    return zscore_position(held(panel(spark, d)), keys=["ticker"])


def detail(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d)
    return walkforward_backtest(held(rows), plan_of(rows), keys=["ticker"], ret_col="ret_held", cost_bps=5.0)


def curve(spark: SparkSession, d: str, window: int | None = None) -> DataFrame:
    return metrics.stitched_curve(detail(spark, d), keys=["ticker"], on_duplicates="sum", window=window)


def benchmarks(spark: SparkSession, d: str) -> DataFrame:
    pred = keep(scores(spark, d))
    first = pred.agg(F.min("ticker")).first()[0]
    return metrics.benchmark_curves(pred, portfolio_daily(top_bottom_weights(pred, k=2), cost_bps=COST), label_col="forward_ret", spy_ticker=first)


def ic(spark: SparkSession, d: str) -> DataFrame:
    return metrics.daily_ic(scores(spark, d))


def spread(spark: SparkSession, d: str) -> DataFrame:
    return metrics.long_short_spread(weights(spark, d))


def _wf(name: str, features, digits: int = 8, **params) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows, folds = kept(spark, d)
        got = walkforward_predictions(rows, folds, features=features, label_col="label_1d_fwd", model_name=name, model_params=params)
        return rounded(got.select("date", "ticker", "fold_id", "score"), digits)

    return query


def _summary(df: DataFrame) -> DataFrame:
    return rounded(df, 6, mean_turnover=8, mean_cost=8)


def registry_of_orders(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    kind = F.element_at(F.array(F.lit("ablation"), F.lit("single_run"), F.lit("strategy_ablation")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return o.select(F.col("o_orderpriority").alias("run_name"), kind.alias("run_type"), F.col("o_orderkey").cast("string").alias("experiment_name"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("o_totalprice").alias("sharpe_net"), (F.col("o_custkey") % 1013).cast("double").alias("sortino_net"), (F.col("o_orderkey") % 97).cast("double").alias("mean_ic"), *more)


def purge(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d)
    return label_cutoffs(plan_of(rows), calendar_positions(rows), 1).select("fold_id", "train_end", "label_cutoff")


def asof(spark: SparkSession, d: str) -> DataFrame:
    asks = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").cast("timestamp").alias("t")).distinct()
    return as_of(asks, panel(spark, d).select("date"))


def per_source_plan(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_shipdate")
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("source_file"))
    dates = lines.join(parts, "l_partkey").select("source_file", F.date_trunc("week", "l_shipdate").alias("date"))
    return walkforward_plan(dates, keys=["source_file"], **PLAN)


def gaps(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(over(["ticker"], "date"))
    return scores(spark, d).withColumn("n", n).withColumn("score", F.when(F.col("n") % 7 != 0, F.col("score"))).drop("n")


def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    rows = rounded(panel(spark, d))
    return rows.select("date", "ticker", "Close").unionByName(rows.select("date", "ticker", "Volume"), allowMissingColumns=True)


def spec_grid(spark: SparkSession, d: str) -> DataFrame:
    """The strategy grid, each spec with the labels that the panel has for its horizon."""
    grid = spark.createDataFrame([(s.horizon, s.k, s.normalization, s.smoothing, s.name) for s in strategy_grid()], "horizon int, k int, normalization string, smoothing string, experiment_name string")
    counts = labelled(spark, d).agg(F.map_from_arrays(F.array(F.lit(1), F.lit(3), F.lit(5)), F.array(*[F.count(f"label_{h}d_fwd") for h in (1, 3, 5)])).alias("_n"))
    return grid.crossJoin(F.broadcast(counts)).withColumn("n_labels", F.element_at("_n", F.col("horizon"))).drop("_n")  # one row


def fold_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d)
    rows = fold_rows(rows, plan_of(rows), start="train_start", end="test_end")
    return rows.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.round(F.sum("Close"), 6).alias("close_sum"))


def logret(spark: SparkSession, d: str) -> DataFrame:
    return rounded(backtest_logret(positions(spark, d), logret_col="log_held", keys=["ticker"]).select("date", "ticker", "pnl", "cum_pnl", "equity"), cum_pnl=6, equity=6)


def add_pnl(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.add_pnl(positions(spark, d), keys=["ticker"], start=2.0, ret_col="ret_held").select("date", "ticker", "pnl", "equity", "cum_pnl"), equity=6, cum_pnl=6)


def minus_benchmark(spark: SparkSession, d: str) -> DataFrame:
    curves = benchmarks(spark, d)
    both = metrics.join_rows([metrics.portfolio_summary(days(spark, d)).select("total_return_net"), metrics.benchmark_summary(curves, return_col="eq_universe_return", prefix="eq_universe")], ())
    return rounded(both.select((F.col("total_return_net") - F.col("eq_universe_total_return")).alias("strategy_minus_eq_universe_total_return")), 6)


def sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = panel(spark, d)
    return rounded(param_sweep(held(rows), plan_of(rows), sweep_grid(), keys=["ticker"], ret_col="ret_held", cost_bps=5.0, on_duplicates="sum"), 6)


def ablation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(model_ablation(*kept_share(spark, d), model_grid(), label_col="label_1d_fwd", cost_bps=COST), 6)


def strategies(spark: SparkSession, d: str) -> DataFrame:
    return rounded(strategy_ablation(*kept_share(spark, d), strategy_grid(), cost_bps=COST), 6)


def price_files(spark: SparkSession, d: str) -> str:
    """A folder with the bars of each ticker in a CSV file of its own."""
    folder = passing_path(spark, "prices")
    write_price_files(bars_from_trades(spark, d), folder)
    return folder


def csv_price_scan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(load_price_csv(spark, select_files(spark, price_files(spark, d))[0]).select("date", *PRICE_COLUMNS))


def csv_dates(spark: SparkSession, d: str) -> DataFrame:
    folder = price_files(spark, d)
    return load_dates(spark, select_files(spark, folder), directory=folder)


def csv_plan(spark: SparkSession, d: str) -> DataFrame:
    return read_plan(spark, write_plan(walkforward_plan(csv_dates(spark, d), keys=["source_file"], **PLAN), f"{passing_path(spark, 'plan')}/plan.csv")).select("source_file", *PLAN_COLUMNS)


def adjusted_returns(spark: SparkSession, d: str) -> DataFrame:
    """Returns of the adjusted close, which is taken where there is one."""
    return rounded(add_returns(panel(spark, d).withColumn("Adj_Close", F.col("Close") * 0.5 + 1), keys=["ticker"]).select("date", "ticker", "ret", "log_ret"))


def return_fill_in(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ensure_returns(panel(spark, d).withColumn("ret", F.col("Volume") / 1000), keys=["ticker"]).select("date", "ticker", "ret", "log_ret"))


def source_backtest(spark: SparkSession, d: str) -> DataFrame:
    """A plan of two sources, of which one is run."""
    rows = panel(spark, d)
    folds = plan_of(rows)
    both = folds.withColumn("source_file", F.lit("bars.csv")).unionByName(folds.withColumns({"fold_id": F.col("fold_id") + 1000, "source_file": F.lit("other.csv")}))
    got = walkforward_backtest(held(rows), both, keys=["ticker"], ret_col="ret_held", cost_bps=5.0, source_file="bars.csv")
    return rounded(got.select("date", "ticker", "source_file", "fold_id", "pnl"))


def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of a run's summary, of a ridge model on one feature."""
    got = run_experiment(*kept_share(spark, d), Experiment("label_1d_fwd", features=("ret_5d",), k=2, cost_bps=COST))["summary"]
    names = [k for k, v in got.items() if isinstance(v, (int, float)) and k not in ("alpha", "k", "label_horizon", "cost_bps_per_turnover")]
    made = spark.createDataFrame([tuple(None if got[k] != got[k] else got[k] for k in names)], ", ".join(f"{k} {'long' if k.startswith('n_') else 'double'}" for k in names))
    return _summary(made)


def minus_spy(spark: SparkSession, d: str) -> DataFrame:
    both = metrics.join_rows([metrics.portfolio_summary(days(spark, d)).select("total_return_net"), metrics.benchmark_summary(benchmarks(spark, d), return_col="spy_return", prefix="spy")], ())
    return rounded(both.select((F.col("total_return_net") - F.col("spy_total_return")).alias("strategy_minus_spy_total_return")), 6)


def curves_compared(spark: SparkSession, d: str) -> DataFrame:
    other = benchmarks(spark, d).where("spy_return IS NOT NULL").select("date", F.col("spy_equity").alias("equity"))
    return rounded(compared_curves(days(spark, d), other), 6)


def model_specs(spark: SparkSession, d: str) -> DataFrame:
    """The model grid, each spec with the complete rows that the panel has for a fit."""
    grid = spark.createDataFrame([(s.name, s.model_name, s.model_params.get("alpha"), s.model_params.get("l1_ratio")) for s in model_grid()], "experiment_name string, model_name string, alpha double, l1_ratio double")
    return grid.crossJoin(F.broadcast(labelled(spark, d).agg(F.count_if(complete([*FEATURES, "label_1d_fwd"])).alias("n_rows"))))  # one row


def sweep_specs(spark: SparkSession, d: str) -> DataFrame:
    """The sweep's grid, each configuration with the rows of the panel that have a history of n rows."""
    grid = spark.createDataFrame(sweep_grid(), "n int, step_frac double")
    place = panel(spark, d).withColumn("_place", F.row_number().over(over(["ticker"], "date")))
    counts = place.select(F.explode(F.filter(F.array(F.lit(10), F.lit(20), F.lit(40)), lambda n: n <= F.col("_place"))).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("n_rows"))
    return grid.join(counts, "n")


def wide_panel(spark: SparkSession, d: str) -> DataFrame:
    """Weekly bars by supplier: tickers grow with the tables, and come and go between dates."""
    return settle(bars_from_trades(spark, d, ticker="l_suppkey"))


def wide_labelled(spark: SparkSession, d: str) -> DataFrame:
    return add_forward_return_labels(make_daily_features(wide_panel(spark, d)))


def wide_scores(spark: SparkSession, d: str) -> DataFrame:
    return wide_labelled(spark, d).select("date", "ticker", F.col("ret_5d").alias("score"), (F.col("label_1d_fwd") / F.lit(SHARE)).alias("forward_ret"))


def wide_backtest(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(bars_from_trades(spark, d, ticker="l_suppkey").select("date", "ticker", "Close"))
    got = walkforward_backtest(held(rows).select("date", "ticker", "Close", "ret_held"), plan_of(rows), keys=["ticker"], ret_col="ret_held", cost_bps=5.0, columns=[])
    return rounded(got.select("date", "ticker", "fold_id", "target_pos", "z", "pos", "pos_lag", "ret", "pnl_gross", "turnover", "cost", "pnl", "cum_pnl", "equity"), z=6, equity=6)


def wide_models(keys: list[str]) -> Query:
    """Ridge scores from one feature: pooled, or from models of each ticker's own."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = keep(wide_labelled(spark, d))
        got = walkforward_predictions(rows, plan_of(rows), features=["ret_5d"], label_col="label_1d_fwd", model_params={"alpha": 1.0}, keys=keys)
        return rounded(got.select("date", "ticker", "fold_id", "score"))

    return query


def order_series(spark: SparkSession, d: str) -> DataFrame:
    """All orders as one series by date and key: a value in [-1, 1), missing for some customers."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    value = F.pmod(F.round(F.col("o_totalprice")).cast("long"), F.lit(2000)) / F.lit(1000.0) - F.lit(1.0)
    return o.select(F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_orderkey").alias("fold_id"), F.lit("orders").alias("ticker"), F.when(F.col("o_custkey") % 7 != 0, value).alias("score"))


def one_series_position(spark: SparkSession, d: str) -> DataFrame:
    got = rate_limited(order_series(spark, d), target="score", out="pos", keys=["ticker"], order=["date", "fold_id"], K=1.0, step_frac=0.125)
    return rounded(got.select(F.col("fold_id").alias("o_orderkey"), "pos"))


def one_series_average(spark: SparkSession, d: str) -> DataFrame:
    got = smooth_scores(order_series(spark, d), smoothing="ema_5")
    return rounded(got.select(F.col("fold_id").alias("o_orderkey"), "score_smoothed"))


def one_series_curve(spark: SparkSession, d: str) -> DataFrame:
    """Orders' values as returns of a thousandth, compounded over all of them."""
    rows = order_series(spark, d).select(F.struct("date", "fold_id").alias("at"), "fold_id", (F.col("score") / F.lit(1000.0)).alias("r"))
    return rounded(compounded(rows, "r", keys=[], date="at").select(F.col("fold_id").alias("o_orderkey"), "equity", "drawdown"))


def tickers_held(spark: SparkSession, d: str, worst: bool) -> DataFrame:
    return metrics.leaders(rounded(ticker_selection(weights(spark, d)).select("ticker", "total_contribution"), 6), "total_contribution", n=5, ties=["ticker"], worst=worst)


def leaderboard(made: Query, n: int) -> Query:
    """The n experiments of a grid with the highest Sharpe ratio, with their places."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        best = metrics.leaders(made(spark, d), "sharpe_net", n=n, ties=["experiment_name"])
        place = F.row_number().over(over([], F.col("sharpe_net").desc_nulls_last(), "experiment_name"))  # n rows
        return best.select(place.alias("place"), "experiment_name", "sharpe_net", "total_return_net", "mean_ic", "max_drawdown_net")

    return query


def registered_orders(spark: SparkSession, d: str) -> DataFrame:
    """A row of the registry for each order, appended in two batches and loaded again; every fifth has no parameters, horizon and model."""
    some = F.col("o_orderkey") % 5 != 0
    text = F.concat(F.lit('{"alpha": '), (F.col("o_custkey") % 10).cast("string"), F.lit(', "note": "'), F.lower("o_orderpriority"), F.lit(', kept"}'))
    rows = registry_of_orders(
        spark, d, (F.col("o_orderkey") % 2).alias("_batch"), F.when(some, text).otherwise(F.lit("")).alias("parameters"), F.when(some, F.lit("ridge")).alias("model_name"),
        F.when(some, F.col("o_custkey") % 7).alias("horizon"), F.col("o_orderstatus").alias("smoothing"), (F.col("o_totalprice") / F.lit(7.0)).alias("total_return_net"),
    )
    path = passing_path(spark, "registry")
    for part in (0, 1):
        append_registry(spark, path, rows.where(F.col("_batch") == part).drop("_batch"))
    return load_registry(spark, path)


def registry_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return registered_orders(spark, d).select(*[F.coalesce(n, F.lit("")).alias(n) if n == "parameters" else n for n in REGISTRY.names])


def registry_champions(spark: SparkSession, d: str) -> DataFrame:
    return champions(registered_orders(spark, d)).select("champion_metric", "champion_value", "run_name", "run_type", "experiment_name", "timestamp", "smoothing")


def detail_of_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(detail(spark, d).select("date", "ticker", "fold_id", "pos", "turnover", "pnl", "equity"), equity=6)


def csv_result_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The backtest's rows as a folder of CSV files, read again."""
    rows = detail_of_report(spark, d)
    return read_results(spark, write_csv_folder(rows, passing_path(spark, "detail"), order=["date", "ticker"]), dict(rows.dtypes))


def fold_folders(spark: SparkSession, d: str) -> DataFrame:
    """The backtest's rows in a folder for each fold, of which those of two folds are read."""
    path = write_table(detail_of_report(spark, d).repartition("fold_id"), passing_path(spark, "folds"), by=["fold_id"])
    return read_table(spark, path, F.col("fold_id").isin(2, 3)).select("date", "ticker", "fold_id", "pnl", "equity")


def report_ticker_summary(spark: SparkSession, d: str) -> DataFrame:
    """The ticker report as one CSV file; place: a row's place in the file."""
    rows = rounded(ticker_selection(weights(spark, d)), total_contribution=6)
    path = write_csv(rows, f"{passing_path(spark, 'report')}/ticker_summary.csv", order=[F.desc("total_contribution"), F.col("ticker")])
    got = read_results(spark, path, dict(rows.dtypes))
    return got.withColumn("place", F.monotonically_increasing_id() + 1)  # a row per ticker: the file is not split


def messy_files(spark: SparkSession, d: str, undated: bool = False) -> str:
    """A file per ticker as such files come: late dates first, each date again further down with other prices, dates in four
    forms, volumes that are no numbers, and under two headers. undated: with lines whose date is none."""
    bars = settle(bars_from_trades(spark, d)).withColumn("n", F.row_number().over(over(["ticker"], "date")))
    n, at = F.col("n"), lambda form: F.date_format("date", form)
    date = F.when(n % 4 == 0, at("yyyy-MM-dd")).when(n % 4 == 1, at("yyyy-MM-dd HH:mm:ss")).when(n % 4 == 2, at("yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit("-05:00")))
    volume = F.when(n % 5 == 0, F.lit("n/a")).otherwise(F.col("Volume").cast("string"))
    prices = [F.col(c).cast("string") for c in ("Open", "High", "Low", "Close")]
    again = [(F.col(c) * 2).cast("string") for c in ("Open", "High", "Low", "Close")]
    turned = F.crc32(F.encode("ticker", "UTF-8")) % 2 == 0

    def line(when, some, note):
        return F.when(turned, F.concat_ws(",", when, *some, volume, F.lit(note))).otherwise(F.concat_ws(",", volume, *some[::-1], when))

    lines = [F.struct((-n).alias("at"), line(date, prices, '"first, of two"').alias("line")), F.struct(n.alias("at"), line(date, again, "second").alias("line"))]
    if undated:
        lines.append(F.struct((n + F.lit(100_000)).alias("at"), F.when(n % 10 == 0, line(F.lit("soon"), prices, "")).alias("line")))
    rows = bars.select("ticker", F.explode(F.array(*lines)).alias("r")).select("ticker", "r.at", "r.line").where("line IS NOT NULL")
    header = F.when(turned, F.lit("Date,Open,High,Low,Close,Volume,Note")).otherwise(F.lit('"Volume","Close","Low","High","Open","Date"'))
    heads = bars.select("ticker").distinct().select("ticker", F.lit(-1_000_000).alias("at"), header.alias("line"))
    folder = passing_path(spark, "messy")
    rows = heads.unionByName(rows).repartition("ticker").sortWithinPartitions("ticker", "at")
    write_named(rows.select(F.concat("ticker", F.lit(".csv")).alias("file"), "line"), folder, note=passing_path(spark, "files"))
    return folder


def csv_messy_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(load_price_panel(spark, messy_files(spark, d)).select("date", "ticker", *PRICE_COLUMNS))


def csv_messy_dates(spark: SparkSession, d: str) -> DataFrame:
    folder = messy_files(spark, d, undated=True)
    return load_dates(spark, select_files(spark, folder), directory=folder)


def csv_selected_tickers(spark: SparkSession, d: str) -> DataFrame:
    """The panel of the two first tickers, on the dates that these two share."""
    some = [r["ticker"] for r in bars_from_trades(spark, d).select("ticker").distinct().orderBy("ticker").limit(2).collect()]
    return rounded(load_price_panel(spark, price_files(spark, d), tickers=some))


@lru_cache(1)
def queries() -> dict[str, Query]:
    one = ["ret_5d"]
    made: dict[str, Query] = {
        "momentum_net_performance": lambda s, d: _summary(metrics.portfolio_summary(days(s, d))),
        "panel_bars": lambda s, d: rounded(panel(s, d)),
        "shared_calendar": lambda s, d: shared_calendar(panel(s, d)),
        "calendar_positions": lambda s, d: calendar_positions(panel(s, d)),
        "dedupe_keep_first": lambda s, d: first_of_each(s.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id"),
        "numeric_coercion": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", number(F.get_json_object("props", "$.k")).alias("k"), number("event_type").alias("not_a_number")),
        "date_range_filter": lambda s, d: rounded(panel(s, d).where(F.col("date").between("1997-01-01", "1998-12-31")).select("date", "ticker", "Close")),
        "union_by_name": union_by_name,
        "simple_log_returns": lambda s, d: rounded(add_returns(panel(s, d), "Close", keys=["ticker"]).select("date", "ticker", "ret", "log_ret")),
        "features_returns": lambda s, d: rounded(make_daily_features(panel(s, d)).select("date", "ticker", *FEATURES[:3])),
        "features_volatility": lambda s, d: rounded(make_daily_features(panel(s, d)).select("date", "ticker", *FEATURES[3:5])),
        "features_ma_distance": lambda s, d: rounded(make_daily_features(panel(s, d)).select("date", "ticker", *FEATURES[5:7])),
        "features_volume_ratio": lambda s, d: rounded(make_daily_features(panel(s, d)).select("date", "ticker", FEATURES[7])),
        "forward_labels": lambda s, d: rounded(add_forward_return_labels(panel(s, d)).select("date", "ticker", "label_1d_fwd", "label_3d_fwd", "label_5d_fwd")),
        "global_wf_plan": plan,
        "per_source_wf_plan": per_source_plan,
        "fold_range_join": fold_counts,
        "label_purge_cutoff": purge,
        "asof_first_last_dates": asof,
        "zscore_signal": lambda s, d: rounded(positions(s, d).select("date", "ticker", "z"), 6),
        "rung_target": lambda s, d: positions(s, d).select("date", "ticker", "target_pos"),
        "rate_limited_position": lambda s, d: rounded(positions(s, d).select("date", "ticker", "target_pos", "pos")),
        "wf_backtest_detail": lambda s, d: rounded(detail(s, d).select("date", "ticker", "fold_id", "target_pos", "z", "pos", "pos_lag", "ret", "pnl_gross", "turnover", "cost", "pnl", "cum_pnl", "equity"), z=6, equity=6),
        "backtest_logret": logret,
        "fold_summary": lambda s, d: rounded(metrics.fold_summary(detail(s, d), keys=["ticker"]), 6),
        "add_pnl": add_pnl,
        "stitched_curve": lambda s, d: rounded(curve(s, d), 6, pnl=8),
        "fold_local_curves": lambda s, d: rounded(metrics.fold_local_curves(detail(s, d), keys=["ticker"]).select("date", "ticker", "fold_id", "equity_local", "dd_local"), 6),
        "rolling_sharpe": lambda s, d: rounded(curve(s, d, 63).select("date", "ticker", "rolling_sharpe"), 5),
        "buy_hold_curve": lambda s, d: rounded(metrics.buy_hold_curve(detail(s, d), keys=["ticker"], on_duplicates="sum", window=None), 6, pnl=8),
        "perf_stats": lambda s, d: rounded(metrics.perf_stats(curve(s, d), "pnl", keys=["ticker"]), 6),
        "sortino": lambda s, d: rounded(add_returns(panel(s, d), "Close", keys=["ticker"]).groupBy("ticker").agg(metrics.sortino(F.col("ret"), 0.001, 52).alias("sortino")), 6),
        "ols_univariate_wf": _wf("linear", one),
        "ridge_univariate_wf": _wf("ridge", one, alpha=1.0),
        "lasso_univariate_wf": _wf("lasso", one, alpha=0.0001),
        "elasticnet_univariate_wf": _wf("elasticnet", one, alpha=0.0001, l1_ratio=0.5),
        "ridge_wf_scores": _wf("ridge", FEATURES, 6, alpha=1.0),
        "lasso_wf_scores": _wf("lasso", FEATURES, 6, alpha=0.001),
        "elasticnet_wf_scores": _wf("elasticnet", FEATURES, 6, alpha=0.001, l1_ratio=0.5),
        "score_zscore": lambda s, d: rounded(normalize_scores(scores(s, d), normalization="zscore", out_col="score_signal").select("date", "ticker", "score_signal"), 6),
        "score_rank": lambda s, d: rounded(normalize_scores(scores(s, d), normalization="rank_to_minus1_plus1", out_col="score_signal").select("date", "ticker", "score_signal"), 6),
        "score_ema": lambda s, d: rounded(smooth_scores(gaps(s, d), smoothing="ema_3").select("date", "ticker", "score_smoothed")),
        "top_bottom_weights": lambda s, d: rounded(weights(s, d).select("date", "ticker", "weight", "prev_weight", "abs_weight_change", "contribution", "is_constant_score_day", "n_valid_scores")),
        "portfolio_daily": lambda s, d: rounded(days(s, d), equity=6),
        "ticker_selection": lambda s, d: rounded(ticker_selection(weights(s, d)), total_contribution=6),
        "daily_ic": lambda s, d: rounded(ic(s, d), 6),
        "ic_summary": lambda s, d: rounded(metrics.ic_summary(ic(s, d)), 6),
        "long_short_spread": lambda s, d: rounded(spread(s, d)),
        "spread_summary": lambda s, d: rounded(metrics.spread_summary(spread(s, d))),
        "portfolio_perf_summary": lambda s, d: _summary(metrics.portfolio_summary(days(s, d))),
        "benchmark_curves": lambda s, d: rounded(benchmarks(s, d), strategy_equity=6, eq_universe_equity=6, spy_equity=6),
        "benchmark_perf": lambda s, d: rounded(metrics.benchmark_summary(benchmarks(s, d), return_col="eq_universe_return", prefix="eq_universe"), 6),
        "strategy_minus_benchmark": minus_benchmark,
        "param_sweep_grid": sweep,
        "model_grid_summary": ablation,
        "strategy_grid_summary": strategies,
        "best_sweep_configs": lambda s, d: best_configs(sweep(s, d), keys=["ticker"]),
        "model_leaderboard": leaderboard(ablation, 5),
        "strategy_leaderboard": leaderboard(strategies, 10),
        "registry_round_trip": registry_round_trip,
        "registry_champions": registry_champions,
        "csv_result_round_trip": csv_result_round_trip,
        "fold_folders": fold_folders,
        "report_ticker_summary": report_ticker_summary,
        "curves_of_first_folds": lambda s, d: rounded(curves_of_first_folds(detail(s, d), most=5, keys=["ticker"]), 6),
        "csv_messy_panel": csv_messy_panel,
        "csv_messy_dates": csv_messy_dates,
        "csv_selected_tickers": csv_selected_tickers,
        "spec_grid": spec_grid,
        "champion_by_metric": lambda s, d: champions(registry_of_orders(s, d)).select("champion_metric", "champion_value", "run_name", "run_type", "experiment_name", "timestamp"),
        "csv_price_scan": csv_price_scan,
        "csv_panel_scan": lambda s, d: rounded(load_price_panel(s, price_files(s, d))),
        "csv_panel_all_dates": lambda s, d: rounded(load_price_panel(s, price_files(s, d), intersect_dates=False)),
        "csv_dates": csv_dates,
        "csv_plan_round_trip": csv_plan,
        "adjusted_returns": adjusted_returns,
        "return_fill_in": return_fill_in,
        "source_backtest": source_backtest,
        "experiment_summary": experiment_summary,
        "strategy_minus_spy": minus_spy,
        "curves_compared": curves_compared,
        "drawdown_curve": lambda s, d: rounded(drawdown_data(days(s, d)), 6),
        "score_ema_5": lambda s, d: rounded(smooth_scores(gaps(s, d), smoothing="ema_5").select("date", "ticker", "score_smoothed")),
        "prepared_scores": lambda s, d: rounded(prepare_scores(gaps(s, d), smoothing="ema_3", normalization="zscore").select("date", "ticker", "score_signal"), 6),
        "model_specs": model_specs,
        "sweep_specs": sweep_specs,
        "best_tickers": lambda s, d: tickers_held(s, d, False),
        "worst_tickers": lambda s, d: tickers_held(s, d, True),
        "rolling_ic": lambda s, d: rounded(metrics.rolling_ic(ic(s, d)), 6),
        "wide_panel_bars": lambda s, d: rounded(wide_panel(s, d)),
        "wide_features_volatility": lambda s, d: rounded(make_daily_features(wide_panel(s, d)).select("date", "ticker", *FEATURES[3:5])),
        "wide_forward_labels": lambda s, d: rounded(add_forward_return_labels(wide_panel(s, d)).select("date", "ticker", "label_1d_fwd", "label_3d_fwd", "label_5d_fwd")),
        "wide_score_rank": lambda s, d: rounded(normalize_scores(wide_scores(s, d), normalization="rank_to_minus1_plus1", out_col="score_signal").select("date", "ticker", "score_signal"), 6),
        "wide_top_bottom_weights": lambda s, d: rounded(top_bottom_weights(wide_scores(s, d), k=2).select("date", "ticker", "weight", "prev_weight", "abs_weight_change", "contribution", "is_constant_score_day", "n_valid_scores")),
        "wide_portfolio_daily": lambda s, d: rounded(portfolio_daily(top_bottom_weights(wide_scores(s, d), k=2), cost_bps=COST), equity=6),
        "wide_daily_ic": lambda s, d: rounded(metrics.daily_ic(wide_scores(s, d)), 6),
        "wide_rate_limited_position": lambda s, d: rounded(zscore_position(held(wide_panel(s, d)), keys=["ticker"]).select("date", "ticker", "target_pos", "pos")),
        "wide_wf_backtest_detail": wide_backtest,
        "wide_ridge_univariate_wf": wide_models([]),
        "wide_ticker_models": wide_models(["ticker"]),
        "one_series_position": one_series_position,
        "one_series_average": one_series_average,
        "one_series_curve": one_series_curve,
        "cumulative_legs": lambda s, d: rounded(metrics.cumulative_legs(spread(s, d)), 6),
    }
    return {name: freeing(query) for name, query in made.items()}
