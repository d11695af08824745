"""``python -m tidemill.cli COMMAND``: downloads, plans, backtests, cross-sectional runs and grids."""

from __future__ import annotations

import argparse
import math
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import reporting, runs
from tidemill.operators import metrics
from tidemill.operators.backtest import ZScoreConfig, walkforward_backtest
from tidemill.operators.experiments import Experiment, best_configs, model_ablation, param_sweep, run_experiment, strategy_ablation
from tidemill.operators.features import add_forward_return_label, add_forward_return_labels, label_name, make_daily_features
from tidemill.operators.models import MODELS
from tidemill.operators.portfolio import ticker_selection
from tidemill.operators.returns import ensure_returns
from tidemill.operators.signals import NORMALIZATIONS, SMOOTHINGS
from tidemill.plans.grids import ModelSpec, model_grid, strategy_grid, sweep_grid
from tidemill.plans.walkforward import walkforward_plan
from tidemill.sources import market, prices, sinks


def tokens(text: str | None) -> list[str]:
    """Comma-separated values, trimmed, without blanks, each once."""
    return list(dict.fromkeys(x.strip() for x in (text or "").split(",") if x.strip()))


def numbers(text: str, kind: type = float) -> list:
    out = [kind(x) for x in tokens(text)]
    if not out:
        raise ValueError("at least one number is needed")
    return out


def choices(text: str, known: Sequence[str], what: str) -> list[str]:
    out = [x.lower() for x in tokens(text)]
    bad = [x for x in out if x not in known]
    if bad or not out:
        raise ValueError(f"{what} {bad} are not among {list(known)}")
    return out


def model_params(name: str, alpha: float | None, l1_ratio: float | None) -> dict[str, float]:
    out = {"alpha": float(alpha)} if name != "linear" and alpha is not None else {}
    return out | ({"l1_ratio": float(l1_ratio)} if name == "elasticnet" and l1_ratio is not None else {})


def shown(x: float | None) -> str:
    return "unavailable" if x is None or math.isnan(x) else f"{x:.6f}"


def session() -> SparkSession:
    return SparkSession.builder.appName("tidemill").config("spark.sql.session.timeZone", "UTC").getOrCreate()


# The options of each command and their defaults (windows of months, grids, models, columns) are those that users' scripts rely on.
def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *groups) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for g in groups:
            g(p)
        return p

    def plan_args(train: int, test: int, step: int, start: str):
        def group(p):
            p.add_argument("--train-months", type=int, default=train)
            p.add_argument("--test-months", type=int, default=test)
            p.add_argument("--step-months", type=int, default=step)
            p.add_argument("--start-date", default=start)

        return group

    def panel_args(p):
        p.add_argument("--input-dir", required=True)
        p.add_argument("--date-col", default="Date")
        p.add_argument("--tickers")
        p.add_argument("--recursive", action="store_true")

    def run_args(name: str):
        def group(p):
            p.add_argument("--plan")
            p.add_argument("--out-dir", default="outputs")
            p.add_argument("--run-name", default=name)
            p.add_argument("--cost-bps-per-turnover", type=float, default=0.0)

        return group

    def asset_args(p):
        p.add_argument("--data", required=True)
        p.add_argument("--date-col", default="Date")
        p.add_argument("--price-col", default="Close")
        p.add_argument("--ret-col", default="ret")
        p.add_argument("--source-file")
        p.add_argument("--K", type=float, default=1.0)
        p.add_argument("--ddof", type=int, default=0)

    p = add("pull")
    p.add_argument("--ticker", action="append")
    p.add_argument("--tickers")
    p.add_argument("--default-etf-universe", action="store_true")
    p.add_argument("--start", default="2018-01-01")
    p.add_argument("--end")
    p.add_argument("--out-dir")
    p = add("make-demo")
    p.add_argument("--out-dir", required=True)
    for name, value in (("num-tickers", 8), ("years", 3), ("seed", 7)):
        p.add_argument(f"--{name}", type=int, default=value)
    add("plan", panel_args, plan_args(9, 1, 1, "2018-01-01")).add_argument("--out", required=True)
    add("global-plan", panel_args, plan_args(9, 1, 1, "2018-01-01")).add_argument("--out", required=True)
    p = add("backtest", asset_args, run_args("zscore_mr"))
    p.add_argument("--n", type=int, default=20)
    p.add_argument("--step-frac", type=float, default=0.25)
    p.add_argument("--save-per-fold", action="store_true")
    p = add("sweep", asset_args, run_args("results_grid"))
    p.add_argument("--n-grid", default="10,20,40")
    p.add_argument("--step-frac-grid", default="0.25,0.5")
    p = add("xs-model", panel_args, run_args("xs_model"), plan_args(9, 1, 1, "2018-01-01"))
    p.add_argument("--model-name", default="ridge", choices=MODELS)
    p.add_argument("--alpha", type=float, default=1.0)
    p.add_argument("--l1-ratio", type=float)
    p.add_argument("--label-horizon", type=int, default=1)
    p.add_argument("--k", type=int, default=3)
    p.add_argument("--score-normalization", default="none", choices=NORMALIZATIONS)
    p.add_argument("--score-smoothing", default="none", choices=SMOOTHINGS)
    p = add("xs-ablation", panel_args, run_args("model_grid"), plan_args(12, 3, 3, "2020-01-01"))
    p.add_argument("--label-horizon", type=int, default=1)
    p.add_argument("--k", type=int, default=2)
    p.add_argument("--score-normalization", default="none", choices=NORMALIZATIONS)
    p.add_argument("--score-smoothing", default="none", choices=SMOOTHINGS)
    for name, value in (("model-names", ",".join(MODELS)), ("ridge-alphas", "0.1,1.0,10.0"), ("lasso-alphas", "0.0001,0.001,0.01"), ("elasticnet-alphas", "0.0001,0.001"), ("elasticnet-l1-ratios", "0.25,0.5,0.75")):
        p.add_argument(f"--{name}", default=value)
    p = add("strategy-ablation", panel_args, run_args("strategy_grid"), plan_args(12, 3, 3, "2020-01-01"))
    p.add_argument("--model-name", default="elasticnet", choices=MODELS)
    p.add_argument("--alpha", type=float, default=0.001)
    p.add_argument("--l1-ratio", type=float, default=0.5)
    for name, value in (("label-horizons", "1,3,5"), ("k-values", "2,3,4"), ("score-normalizations", ",".join(NORMALIZATIONS)), ("score-smoothing-methods", "none,ema_3")):
        p.add_argument(f"--{name}", default=value)
    return top


def _panel(spark: SparkSession, a) -> DataFrame:
    return prices.load_price_panel(spark, a.input_dir, date_col=a.date_col, tickers=tokens(a.tickers) or None, recursive=a.recursive)


def _plan(spark: SparkSession, a, panel: DataFrame) -> DataFrame:
    if a.plan:
        return sinks.read_plan(spark, a.plan)
    return walkforward_plan(panel.select("date"), train_months=a.train_months, test_months=a.test_months, step_months=a.step_months, start_date=a.start_date).persist()


def _warn_k(panel: DataFrame, k: int) -> None:
    n = panel.select("ticker").distinct().count()
    if n < max(2, 2 * k):
        print(f"warning: k={k}, but there are {n} tickers; k is clipped to half of them")


def pull(spark: SparkSession, a) -> None:
    tickers = market.resolve_tickers(a.ticker, a.tickers, use_default_universe=a.default_etf_universe)
    out = a.out_dir or os.path.join("data", "real_etf_xs" if len(tickers) > 1 else "")
    done, failed = market.download(spark, tickers, out, start=a.start, end=a.end)
    for d in done:
        print(f"{d.ticker}: {d.rows} rows, {d.date_start} to {d.date_end}: {d.path}")
    for t, e in failed.items():
        print(f"{t} failed: {e}")


def make_demo(spark: SparkSession, a) -> None:
    print("\n".join(market.write_synthetic(spark, a.out_dir, num_tickers=a.num_tickers, years=a.years, seed=a.seed)))


def plan(spark: SparkSession, a) -> None:
    files = prices.select_files(spark, a.input_dir, tickers=tokens(a.tickers) or None, recursive=a.recursive)
    dates = prices.load_dates(spark, files, directory=a.input_dir, date_col=a.date_col)
    made = walkforward_plan(dates, train_months=a.train_months, test_months=a.test_months, step_months=a.step_months, start_date=a.start_date, keys=["source_file"])
    if not made.take(1):
        raise RuntimeError("no valid folds")
    print(sinks.write_plan(made, a.out))


def global_plan(spark: SparkSession, a) -> None:
    made = walkforward_plan(_panel(spark, a).select("date"), train_months=a.train_months, test_months=a.test_months, step_months=a.step_months, start_date=a.start_date)
    if not made.take(1):
        raise RuntimeError("no valid folds")
    print(sinks.write_plan(made, a.out))


def _asset(spark: SparkSession, a) -> tuple[DataFrame, DataFrame, str | None]:
    df = ensure_returns(prices.load_price_csv(spark, a.data, date_col=a.date_col), price_col=a.price_col, ret_col=a.ret_col)
    folds = sinks.read_plan(spark, a.plan)
    return df, folds, a.source_file or (os.path.basename(a.data) if "source_file" in folds.columns else None)


def backtest(spark: SparkSession, a) -> None:
    df, folds, source = _asset(spark, a)
    cfg = ZScoreConfig(n=a.n, K=a.K, step_frac=a.step_frac, ddof=a.ddof)
    detail = walkforward_backtest(df, folds, price_col=a.price_col, ret_col=a.ret_col, cfg=cfg, source_file=source, cost_bps=a.cost_bps_per_turnover, check=True).persist()
    summary = metrics.fold_summary(detail)
    curve, held = metrics.stitched_curve(detail, window=None), metrics.buy_hold_curve(detail, window=None)
    stats = metrics.perf_stats(curve, "pnl").select(F.lit("strategy").alias("series"), "*").unionByName(metrics.perf_stats(held, "pnl").select(F.lit("benchmark_buy_hold").alias("series"), "*"))
    at = lambda name: os.path.join(a.out_dir, f"{a.run_name}_{name}")
    print(sinks.write_csv(detail, at("test_detail.csv"), order=["date", "fold_id"]), sinks.write_csv(summary, at("fold_summary.csv"), order=["fold_id"]), sinks.write_csv(stats, at("perf_summary.csv"), order=["series"]))
    if a.save_per_fold:
        sinks.write_table(detail, os.path.join(a.out_dir, "folds"), by=["fold_id"])
    sinks.write_json(at("config.json"), {"run_name": a.run_name, "data_path": a.data, "plan_path": a.plan, "date_col": a.date_col, "price_col": a.price_col, "ret_col": a.ret_col, "source_file": source, "cfg": vars(cfg)})
    reporting.single_asset_report(os.path.join(a.out_dir, "plots", a.run_name), detail=detail, folds=summary, benchmark=held)


def sweep(spark: SparkSession, a) -> None:
    df, folds, source = _asset(spark, a)
    grid = sweep_grid(numbers(a.n_grid, int), numbers(a.step_frac_grid))
    made = param_sweep(df, folds, grid, price_col=a.price_col, ret_col=a.ret_col, K=a.K, ddof=a.ddof, cost_bps=a.cost_bps_per_turnover, source_file=source).persist()
    best = best_configs(made).toPandas().set_index("chosen_by", drop=False)  # a row per measure
    rows = made.toPandas()  # a row per configuration
    columns = ["n", "step_frac", "K", "cost_bps_per_turnover", "mean_fold_sharpe", "total_return", "cagr", "sharpe", "max_drawdown"]
    os.makedirs(a.out_dir, exist_ok=True)
    by_sharpe = rows.sort_values("mean_fold_sharpe", ascending=False, kind="stable")
    rows.to_csv(os.path.join(a.out_dir, f"{a.run_name}.csv"), index=False)
    parts = [f"# Param sweep results ({a.run_name})"]
    for title, some in (("Best config by mean fold Sharpe", best.loc[["mean_fold_sharpe"]]), ("Best config by stitched total return", best.loc[["total_return"]]), ("Full grid (sorted by mean fold Sharpe)", by_sharpe)):
        parts += [f"## {title}", sinks.markdown_table(some, columns)]
    with open(os.path.join(a.out_dir, f"{a.run_name}_best.md"), "w", encoding="utf-8") as f:
        f.write("\n\n".join(parts))


def xs_model(spark: SparkSession, a) -> None:
    now, paths = runs.utc_now(), runs.init_run_paths(a.out_dir, a.run_name)
    panel = _panel(spark, a)
    _warn_k(panel, a.k)
    label = label_name(a.label_horizon)
    panel = add_forward_return_label(make_daily_features(panel), a.label_horizon).persist()
    folds = _plan(spark, a, panel)
    runs.save_plan_snapshot(folds, paths)
    params = model_params(a.model_name, a.alpha, a.l1_ratio)
    spec = Experiment(label, a.label_horizon, ModelSpec(a.model_name, params), smoothing=a.score_smoothing, normalization=a.score_normalization, k=a.k, cost_bps=a.cost_bps_per_turnover)
    got = run_experiment(panel, folds, spec)
    s = got["summary"]
    tickers = ticker_selection(got["portfolio_detail"], score_col=s["score_col"])
    curves = metrics.benchmark_curves(got["predictions"], got["portfolio_daily"], label_col=label).persist()
    for column, prefix in (("spy_return", "spy"), ("eq_universe_return", "eq_universe")):
        stats = metrics.benchmark_summary(curves, return_col=column, prefix=prefix).first().asDict()
        s.update({k: float("nan") if v is None else v for k, v in stats.items()})
        s[f"strategy_minus_{prefix}_total_return"] = s["total_return_net"] - s[f"{prefix}_total_return"]
    first, last = panel.agg(F.min("date"), F.max("date")).first()
    s.update(date_start=str(first.date()), date_end=str(last.date()), plan_path=os.path.join(paths.run_dir, "plan.csv"))
    for name in ("predictions", "portfolio_detail"):
        sinks.write_csv_folder(got[name], os.path.join(paths.run_dir, f"{name}.csv"), order=["date", "ticker"])
    for name, order in (("portfolio_daily", ["date"]), ("ic_daily", ["date"]), ("spread_daily", ["date"])):
        sinks.write_csv(got[name], os.path.join(paths.run_dir, f"{name}.csv"), order=order)
    sinks.write_csv(tickers, os.path.join(paths.run_dir, "ticker_summary.csv"), order=[F.desc("total_contribution"), F.col("ticker")])
    sinks.write_json(os.path.join(paths.run_dir, "xs_summary.json"), s)
    runs.write_run_config(paths, run_name=a.run_name, run_type="single_run", timestamp=now, input_dir=a.input_dir, repo_root=os.getcwd(), config=vars(a))
    runs.append_registry(spark, paths.registry_path, [_registered(s, now, a, "single_run", paths)])
    runs.update_champions(spark, paths.registry_path, paths.champions_dir)
    reporting.cross_sectional_report(paths.plots_dir, daily=got["portfolio_daily"], ic=got["ic_daily"], spread=got["spread_daily"], tickers=tickers, benchmarks=curves)
    best, worst = (metrics.leaders(tickers, "total_contribution", n=1, ties=["ticker"], worst=w).first()["ticker"] for w in (False, True))
    print(f"mean IC {shown(s['mean_ic'])}, Sharpe {shown(s['sharpe_net'])}, total return {shown(s['total_return_net'])}, SPY {shown(s['spy_total_return'])}; best {best}, worst {worst}")


def _registered(s, now: str, a, kind: str, paths: runs.RunPaths) -> dict:
    value = lambda k: None if s.get(k) is None or isinstance(s.get(k), float) and math.isnan(s[k]) else s[k]
    return runs.registry_row(
        timestamp=now, run_name=a.run_name, run_type=kind, experiment_name=s.get("experiment_name"), model_name=s["model_name"], parameters=s.get("model_params", s.get("parameters")), horizon=s.get("label_horizon", s.get("horizon")), k=s["k"],
        normalization=s.get("score_normalization", s.get("normalization")), smoothing=s.get("score_smoothing", s.get("smoothing")), path_to_run_dir=paths.run_dir,
        **{k: value(k) for k in ("mean_ic", "mean_spread", "total_return_net", "sharpe_net", "sortino_net", "max_drawdown_net", "n_constant_score_days")},
    )


def _grid(spark: SparkSession, a, kind: str, file: str, made, top: int) -> None:
    """Runs a grid, writes its table, registers its rows and shows the best."""
    now, paths = runs.utc_now(), runs.init_run_paths(a.out_dir, a.run_name)
    panel = make_daily_features(_panel(spark, a))
    rows, folds = made(panel)
    runs.save_plan_snapshot(folds, paths)
    rows = rows.persist()
    sinks.write_csv(rows, os.path.join(paths.run_dir, file), order=["experiment_name"])
    runs.write_run_config(paths, run_name=a.run_name, run_type=kind, timestamp=now, input_dir=a.input_dir, repo_root=os.getcwd(), config=vars(a))
    runs.append_registry(spark, paths.registry_path, [_registered(r.asDict(), now, a, kind, paths) for r in rows.collect()])  # a row per experiment
    runs.update_champions(spark, paths.registry_path, paths.champions_dir)
    metrics.leaders(rows, "sharpe_net", n=top, ties=["experiment_name"]).show(top, truncate=False)


def xs_ablation(spark: SparkSession, a) -> None:
    names = choices(a.model_names, MODELS, "models")
    specs = model_grid(names, ridge_alphas=numbers(a.ridge_alphas), lasso_alphas=numbers(a.lasso_alphas), elasticnet_alphas=numbers(a.elasticnet_alphas), elasticnet_l1_ratios=numbers(a.elasticnet_l1_ratios))

    def made(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
        _warn_k(panel, a.k)
        panel = add_forward_return_label(panel, a.label_horizon).persist()
        folds = _plan(spark, a, panel)
        return model_ablation(panel, folds, specs, label_col=label_name(a.label_horizon), horizon=a.label_horizon, k=a.k, normalization=a.score_normalization, smoothing=a.score_smoothing, cost_bps=a.cost_bps_per_turnover), folds

    _grid(spark, a, "ablation", "ablation_summary.csv", made, 5)


def strategy(spark: SparkSession, a) -> None:
    specs = strategy_grid(numbers(a.label_horizons, int), numbers(a.k_values, int), choices(a.score_normalizations, NORMALIZATIONS, "normalizations"), choices(a.score_smoothing_methods, SMOOTHINGS, "smoothing methods"))

    def made(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
        panel = add_forward_return_labels(panel, sorted({s.horizon for s in specs})).persist()
        folds = _plan(spark, a, panel)
        return strategy_ablation(panel, folds, specs, model_name=a.model_name, model_params=model_params(a.model_name, a.alpha, a.l1_ratio), cost_bps=a.cost_bps_per_turnover), folds

    _grid(spark, a, "strategy_ablation", "strategy_ablation_summary.csv", made, 10)


COMMANDS = {"pull": pull, "make-demo": make_demo, "plan": plan, "global-plan": global_plan, "backtest": backtest, "sweep": sweep, "xs-model": xs_model, "xs-ablation": xs_ablation, "strategy-ablation": strategy}


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](session(), a)


if __name__ == "__main__":
    main()
