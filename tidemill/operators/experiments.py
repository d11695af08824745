"""Walk-forward experiments: fit, predict, smooth, normalise, hold, measure; and grids of them in one plan."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.series import over
from tidemill.operators import metrics
from tidemill.operators.backtest import ZScoreConfig, rate_limited, rows_of_folds, rung_target, tested_rows, zscore
from tidemill.operators.features import FEATURES, label_name
from tidemill.operators.models import complete, fit_all, moments, moments_of_folds, predict, resolve_model_params
from tidemill.operators.portfolio import portfolio_daily, top_bottom_weights
from tidemill.operators.signals import normalize_scores, prepare_scores, smooth_scores
from tidemill.plans.grids import ModelSpec, StrategySpec
from tidemill.plans.walkforward import calendar_positions, elementary_intervals, fold_rows, label_cutoffs, normalized_plan
from tidemill.schema import number, require_columns
from tidemill.shared import keep, stored


def _by_horizon(labels: Mapping[int, str], *, label: str) -> Column:
    """A row's horizons with the label of each, to be made rows."""
    return F.array(*[F.struct(F.lit(int(h)).alias("horizon"), F.col(c).alias(label)) for h, c in labels.items()])


def training_moments(panel: DataFrame, plan: DataFrame, *, features: Sequence[str], labels: Mapping[int, str], keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(test rows of all folds, (keys, horizon, fold_id, n, parts)), labels being a column by horizon; parts are the moments of training rows.

    A training row's label must be known by train_end, so training ends ``horizon`` positions
    of the calendar earlier. Folds without test rows are left out; without keys, a fold with test rows but
    without complete training rows is an error, and always a train_end off the calendar. Time is cut
    at all borders of folds: a row counts in one interval, whose moments all folds share that cover it.
    """
    require_columns(panel, ["date", "ticker", *labels.values(), *features], "the panel")
    plan = normalized_plan(plan)
    folds = stored(label_cutoffs(plan.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in labels]))), calendar_positions(panel), "horizon"))
    if bad := folds.where("NOT on_calendar OR label_cutoff IS NULL").orderBy("on_calendar", "horizon", "fold_id").first():
        if not bad["on_calendar"]:
            raise ValueError(f"train_end={bad['train_end']} is not a date of the panel's calendar")
        raise ValueError(f"too little history before train_end={bad['train_end']} for labels {bad['horizon']} rows ahead")
    rows = panel.drop(*(c for c in plan.columns if c in panel.columns))
    tests = fold_rows(rows, plan, start="test_start", end="test_end")
    tested = stored(tests.select("fold_id").distinct())
    intervals, spans = elementary_intervals(folds.join(tested, "fold_id", "left_semi"), start="train_start", end="label_cutoff", by=["horizon"])
    trains = rows.where(complete(features)).select(*keys, "date", *features, F.explode(_by_horizon(labels, label="_label")).alias("_h")).select(*keys, "date", *features, "_h.*").where(complete(["_label"]))
    trains = fold_rows(trains, intervals, start="at", end="to", keys=["horizon"])
    parts = moments(trains, features, "_label", (*keys, "horizon", "interval"))
    found = stored(moments_of_folds(parts, spans, keys=keys, by=["horizon"]))
    if not keys:
        wanted = tested.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in labels])))
        if bare := wanted.join(found, ["horizon", "fold_id"], "left_anti").orderBy("horizon", "fold_id").take(5):
            raise ValueError(f"folds {[r['fold_id'] for r in bare]} have no training row with all features and the label")
    if not tested.take(1):
        raise RuntimeError("no fold has test rows in the panel")
    return tests, found


def walkforward_predictions(panel: DataFrame, plan: DataFrame, *, features: Sequence[str] = FEATURES, label_col: str, horizon: int = 1, model_name: str = "ridge", model_params: Mapping[str, Any] | None = None, score_col: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """The test rows of all folds with their fold's model's score.

    With keys (such as ticker) each of their values has models of its own; where it has no complete
    training rows in a fold, scores are NULL.
    """
    tests, found = training_moments(panel, plan, features=features, labels={horizon: label_col}, keys=keys)
    on = (*keys, "fold_id")
    coefs = stored(fit_all(found, [(model_name, model_params)], features, keys=on).drop("spec_id"))
    return predict(tests, coefs, features, on=on, score_col=score_col, how="left" if keys else "inner")


@dataclass(frozen=True)
class Experiment:
    """What is fitted, how scores become weights, and what trades cost.

    ``model`` carries the model's name and parameters; ``features`` and ``label`` are columns of
    the panel, the label being the return ``horizon`` rows ahead.
    """

    label: str
    horizon: int = 1
    model: ModelSpec = ModelSpec("ridge")
    features: tuple[str, ...] = tuple(FEATURES)
    smoothing: str = "none"
    normalization: str = "none"
    k: int = 3
    cost_bps: float = 0.0

    def described(self) -> dict[str, Any]:
        """The part of a run's summary that is known before it runs."""
        params = resolve_model_params(self.model.model_name, self.model.model_params)
        # The names of a summary's entries.
        return {
            "model_name": self.model.model_name, "model_params": params, "alpha": params.get("alpha", 1.0), "k": self.k, "score_normalization": self.normalization, "score_smoothing": self.smoothing,
            "cost_bps_per_turnover": float(self.cost_bps), "label_horizon": self.horizon, "label_col": self.label, "score_col": "score_signal", "raw_score_col": "score",
            "turnover_convention": "one_way_half_abs_change", "feature_cols": list(self.features),
        }


def run_experiment(panel: DataFrame, plan: DataFrame, spec: Experiment) -> dict[str, Any]:
    """predictions, portfolio_detail, portfolio_daily, ic_daily, spread_daily (DataFrames) and summary (a dict; NaN is unknown).

    The first three are cached; the caller unpersists them. The summary's numbers come from an
    aggregation of the predictions and one of the days, a row each.
    """
    pred = walkforward_predictions(panel, plan, features=spec.features, label_col=spec.label, horizon=spec.horizon, model_name=spec.model.model_name, model_params=spec.model.model_params)
    pred = keep(prepare_scores(pred, smoothing=spec.smoothing, normalization=spec.normalization))
    detail = keep(top_bottom_weights(pred, score_col="score_signal", forward_ret_col=spec.label, k=spec.k))
    by_date = [*metrics.ic_columns("score_signal", spec.label), metrics.leg_columns()[-1]]
    daily = keep(portfolio_daily(detail, cost_bps=spec.cost_bps, others=by_date))
    rows = pred.agg(F.count(F.lit(1)).alias("n_prediction_rows"), F.count("score_signal").alias("n_scored_rows"), F.count_distinct("ticker").alias("n_tickers")).first()
    counts = [F.count(F.lit(1)).alias("n_portfolio_days"), F.count_if("is_constant_score_day").alias("n_constant_score_days")]
    days = metrics.portfolio_summary(daily, others=[*counts, *metrics.ic_summary_columns(), *metrics.spread_summary_columns()]).first()
    folds = plan.select("fold_id").distinct().count()
    measured = {k: float("nan") if v is None else v for k, v in {**rows.asDict(), **days.asDict()}.items()}
    return {
        "predictions": pred,
        "portfolio_detail": detail,
        "portfolio_daily": daily.drop("n_assets", "ic_pearson", "spread"),
        "ic_daily": metrics.daily_ic(pred, score_col="score_signal", forward_ret_col=spec.label),
        "spread_daily": metrics.long_short_spread(detail),
        "summary": {"n_folds": folds, **spec.described(), **measured},
    }


def _measured(pred: DataFrame, keys: Sequence[str], *, score_col: str, forward_ret_col: str, k, cost_bps: float) -> DataFrame:
    """One row per keys with the columns of a grid's summary: an aggregation by date, and one of the days."""
    detail = top_bottom_weights(pred, score_col=score_col, forward_ret_col=forward_ret_col, k=k, keys=keys)
    daily = portfolio_daily(detail, cost_bps=cost_bps, keys=keys, others=[*metrics.ic_columns(score_col, "forward_ret"), metrics.leg_columns()[-1]])
    days = [*metrics.ic_summary_columns(), *metrics.spread_summary_columns(), F.count_if("is_constant_score_day").alias("n_constant_score_days")]
    tickers = pred.groupBy(*keys).agg(F.count_distinct("ticker").alias("n_tickers"))
    return tickers.join(metrics.portfolio_summary(daily, keys=keys, others=days), list(keys))


MODEL_ROW = ("experiment_name", "model_name", "parameters", "horizon", "k", "normalization", "smoothing", "n_tickers", "n_traded_days", "n_constant_score_days", "mean_ic", "ic_ir", "mean_spread", "total_return_net", "cagr_net", "sharpe_net", "sortino_net", "max_drawdown_net", "mean_turnover")
STRATEGY_ROW = tuple(c for c in MODEL_ROW if c not in ("ic_ir", "cagr_net"))


def model_ablation(panel: DataFrame, plan: DataFrame, specs: Sequence[ModelSpec], *, feature_cols: Sequence[str] = FEATURES, label_col: str, horizon: int = 1, k: int = 2, normalization: str = "none", smoothing: str = "none", cost_bps: float = 0.0) -> DataFrame:
    """A row of MODEL_ROW for each spec. All specs share one moments aggregation; spec_id is a key of every later step."""
    if not specs:
        raise ValueError("the grid has no experiments")
    spark = panel.sparkSession
    tests, found = training_moments(panel, plan, features=feature_cols, labels={horizon: label_col})
    coefs = stored(fit_all(found, [(s.model_name, s.model_params) for s in specs], feature_cols))
    pred = predict(tests, coefs, feature_cols)
    pred = keep(prepare_scores(pred, out_col="score_signal", smoothing=smoothing, normalization=normalization, keys=["spec_id"]))
    names = spark.createDataFrame([(i, s.name, s.model_name, json.dumps(resolve_model_params(s.model_name, s.model_params), sort_keys=True)) for i, s in enumerate(specs)], "spec_id int, experiment_name string, model_name string, parameters string")
    rows = _measured(pred, ["spec_id"], score_col="score_signal", forward_ret_col=label_col, k=k, cost_bps=cost_bps).join(names, "spec_id")
    fixed = {"horizon": F.lit(horizon), "k": F.lit(k), "normalization": F.lit(normalization), "smoothing": F.lit(smoothing)}
    return rows.withColumns(fixed).select(*MODEL_ROW)


def strategy_ablation(panel: DataFrame, plan: DataFrame, specs: Sequence[StrategySpec], *, feature_cols: Sequence[str] = FEATURES, model_name: str = "elasticnet", model_params: Mapping[str, Any] | None = None, cost_bps: float = 0.0) -> DataFrame:
    """A row of STRATEGY_ROW for each spec: one fit per horizon from one aggregation, one smoothing per method, one normalisation per both."""
    if not specs:
        raise ValueError("the grid has no experiments")
    params = resolve_model_params(model_name, {"alpha": 0.001, "l1_ratio": 0.5} if model_params is None and model_name == "elasticnet" else model_params)
    labels = {h: label_name(h) for h in dict.fromkeys(s.horizon for s in specs)}
    tests, found = training_moments(panel, plan, features=feature_cols, labels=labels)
    coefs = stored(fit_all(found, [(model_name, params)], feature_cols, keys=("horizon", "fold_id")))
    each = tests.select("date", "ticker", "fold_id", *feature_cols, F.explode(_by_horizon(labels, label="forward_ret")).alias("_h")).select("date", "ticker", "fold_id", *feature_cols, "_h.*")
    pred = predict(each, coefs.drop("spec_id"), feature_cols, on=("horizon", "fold_id")).drop(*feature_cols)
    # All smoothings and normalisations are columns of one row, made side by side, and become rows afterwards.
    signals = []
    for smoothing in dict.fromkeys(s.smoothing for s in specs):
        pred = smooth_scores(pred, smoothing=smoothing, out_col=f"_{smoothing}", keys=["horizon"])
        for normalization in dict.fromkeys(s.normalization for s in specs):
            pred = normalize_scores(pred, score_col=f"_{smoothing}", normalization=normalization, out_col=f"_{smoothing}_{normalization}", keys=["horizon"])
            signals.append(F.struct(F.lit(smoothing).alias("smoothing"), F.lit(normalization).alias("normalization"), F.col(f"_{smoothing}_{normalization}").alias("score_signal")))
    pred = pred.withColumn("_signal", F.explode(F.array(*signals))).select("horizon", "date", "ticker", "fold_id", "forward_ret", "_signal.*")
    grid = panel.sparkSession.createDataFrame([(s.horizon, s.k, s.normalization, s.smoothing) for s in specs], "horizon int, k int, normalization string, smoothing string")
    pred = keep(pred.join(F.broadcast(grid), ["horizon", "normalization", "smoothing"]))  # a row per spec
    rows = _measured(pred, ["horizon", "k", "normalization", "smoothing"], score_col="score_signal", forward_ret_col="forward_ret", k=F.col("k"), cost_bps=cost_bps)
    name = F.format_string("h%d__k%d__norm_%s__smooth_%s", "horizon", "k", "normalization", "smoothing")
    return rows.withColumns({"experiment_name": name, "model_name": F.lit(str(model_name)), "parameters": F.lit(json.dumps(params, sort_keys=True))}).select(*STRATEGY_ROW)


def param_sweep(df: DataFrame, plan: DataFrame, grid: Sequence[tuple[int, float]], *, price_col: str = "Close", ret_col: str = "ret", K: float = 1.0, ddof: int = 0, cost_bps: float = 0.0, source_file: str | None = None, on_duplicates: str = "raise", keys: Sequence[str] = ()) -> DataFrame:
    """(n, step_frac, K, ddof, cost_bps_per_turnover, mean_fold_sharpe, STATS) for each (n, step_frac), and for each of ``keys`` if df holds several series."""
    if not grid:
        raise ValueError("the grid has no configurations")
    cfgs = {n: ZScoreConfig(n=n, K=K, step_frac=step, ddof=ddof).checked() for n, step in grid}
    by = [*keys, "n", "step_frac"]
    # One join with the folds and one window by their rows: a column of targets for each n, of which the specs become rows.
    _, inside = rows_of_folds(df, plan, source_file=source_file, keys=keys)
    w = over([*keys, "fold_id"], "date")
    targets = inside.withColumns({f"_to_{n}": rung_target(zscore(number(price_col), cfg, w), K) for n, cfg in cfgs.items()})
    specs = F.array(*[F.struct(F.lit(int(n)).alias("n"), F.lit(float(step)).alias("step_frac"), F.col(f"_to_{n}").alias("target_pos")) for n, step in grid])
    each = targets.select(*keys, "fold_id", "date", "test_start", "test_end", number(ret_col).alias(ret_col), F.explode(specs).alias("_spec")).select("*", "_spec.*").drop("_spec")
    moved = rate_limited(each, target="target_pos", out="pos", keys=[*by, "fold_id"], order=["date"], K=K, step_frac="step_frac")
    tested = keep(tested_rows(moved, ret_col=ret_col, keys=[*by, "fold_id"], cost_bps=cost_bps).select(*by, "date", "fold_id", "pnl"))
    sharpe = metrics.fold_summary(tested, keys=by).groupBy(*by).agg(F.avg("sharpe").alias("mean_fold_sharpe"))
    curve = metrics.stitched_curve(tested, keys=by, window=None, on_duplicates=on_duplicates)
    stats = metrics.perf_stats(curve, "pnl", keys=by)
    fixed = {"K": F.lit(float(K)), "ddof": F.lit(int(ddof)), "cost_bps_per_turnover": F.lit(float(cost_bps))}
    return sharpe.join(stats, by).withColumns(fixed).select(*by, *fixed, "mean_fold_sharpe", *metrics.STATS)


def best_configs(rows: DataFrame, measures: Sequence[str] = ("mean_fold_sharpe", "total_return"), *, keys: Sequence[str] = ()) -> DataFrame:
    """Of ``param_sweep``'s rows the one with the highest of each measure (chosen_by), for each of ``keys``.

    A missing measure is never the best unless a series has no other; of equals the smaller n, then step, wins.
    One aggregation finds them all, so a series' rows are neither sorted nor gathered.
    """
    columns = rows.columns
    whole = F.struct(*columns)
    # The highest measure with the smallest configuration: the maximum of a struct with these turned round.
    rank = lambda m: F.struct(F.col(m).isNotNull(), F.col(m), -F.col("n"), -F.col("step_frac"))
    best = rows.groupBy(*keys).agg(*[F.max_by(whole, rank(m)).alias(m) for m in measures])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("chosen_by"), F.col(m).alias("row")) for m in measures]))
    return best.select(each.alias("_b")).where("_b.row IS NOT NULL").select("_b.chosen_by", *[F.col("_b.row").getField(c).alias(c) for c in columns])
