"""Report data as DataFrames, and figures of it where matplotlib is installed."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import metrics

#: Most folds that get a figure of their own.
MOST_FOLDS = 24


def can_draw() -> bool:
    return importlib.util.find_spec("matplotlib") is not None


def draw(data: DataFrame, *, x: str, ys: Sequence[str], title: str, path: str, kind: str = "line", y_label: str = "") -> str | None:
    """A line or bar figure of report-sized data; None without matplotlib."""
    if not can_draw():
        return None
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    rows = data.select(x, *ys).toPandas()
    rows = rows.sort_values(x) if kind == "line" else rows
    fig, ax = plt.subplots(figsize=(10, 4))
    for y in ys:
        ax.plot(rows[x], rows[y], label=y) if kind == "line" else ax.bar(rows[x].astype(str), rows[y], label=y)
    ax.set_title(title)
    ax.set_ylabel(y_label or ys[0])
    ax.legend()
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fig.savefig(path, dpi=150, bbox_inches="tight")
    plt.close(fig)
    return path


def compared_curves(a: DataFrame, b: DataFrame, *, names: tuple[str, str] = ("strategy", "benchmark")) -> DataFrame:
    """Two equity curves on the dates that both have."""
    return a.select("date", F.col("equity").alias(names[0])).join(b.select("date", F.col("equity").alias(names[1])), "date")


def drawdown_data(daily: DataFrame, *, equity_col: str = "equity") -> DataFrame:
    from tidemill.functions.series import drawdown, over

    return daily.select("date", drawdown(F.col(equity_col), over([], "date")).alias("drawdown"))


def cross_sectional_report(out_dir: str, *, daily: DataFrame, ic: DataFrame, spread: DataFrame, tickers: DataFrame, benchmarks: DataFrame) -> dict[str, DataFrame]:
    """The data of the seven figures by file name; draws them if it can."""
    data = {
        "equity_net": (daily.select("date", "equity"), "date", ["equity"], "line"),
        "drawdown_net": (drawdown_data(daily), "date", ["drawdown"], "line"),
        "turnover": (daily.select("date", "turnover"), "date", ["turnover"], "line"),
        "rolling_ic": (metrics.rolling_ic(ic), "date", ["ic_pearson", "rolling_ic"], "line"),
        "long_short_spread_cumulative": (metrics.cumulative_legs(spread), "date", ["long_curve", "short_curve", "spread_curve"], "line"),
        "ticker_contribution": (tickers.select("ticker", "total_contribution").orderBy(F.desc("total_contribution"), "ticker"), "ticker", ["total_contribution"], "bar"),
        "benchmark_overlay": (benchmarks.select("date", "strategy_equity", "eq_universe_equity", "spy_equity"), "date", ["strategy_equity", "eq_universe_equity", "spy_equity"], "line"),
    }
    for name, (df, x, ys, kind) in data.items():
        draw(df, x=x, ys=ys, title=name.replace("_", " "), path=os.path.join(out_dir, f"{name}.png"), kind=kind)
    return {name: d[0] for name, d in data.items()}


def curves_of_first_folds(detail: DataFrame, *, most: int = MOST_FOLDS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold_id, date, equity_local, dd_local) of the ``most`` first folds that have rows."""
    first = detail.select("fold_id").distinct().orderBy("fold_id").limit(most)
    return metrics.fold_local_curves(detail, keys=keys).join(first, "fold_id", "left_semi").select(*keys, "fold_id", "date", "equity_local", "dd_local")


def single_asset_report(out_dir: str, *, detail: DataFrame, folds: DataFrame, benchmark: DataFrame, window: int = 63, per_fold: bool = True) -> dict[str, DataFrame]:
    """The data of the backtest's figures by file name: curves, folds, comparison, and the curves of the first folds."""
    curve = metrics.stitched_curve(detail, window=window)
    first = folds.select("fold_id").orderBy("fold_id").limit(MOST_FOLDS)
    data = {
        "equity": (curve.select("date", "equity"), "date", ["equity"], "line"),
        "drawdown": (curve.select("date", "drawdown"), "date", ["drawdown"], "line"),
        "rolling_sharpe": (curve.select("date", "rolling_sharpe"), "date", ["rolling_sharpe"], "line"),
        "fold_total_return": (folds.select("fold_id", "total_return"), "fold_id", ["total_return"], "bar"),
        "fold_sharpe": (folds.select("fold_id", "sharpe"), "fold_id", ["sharpe"], "bar"),
        "equity_compare": (compared_curves(curve, benchmark), "date", ["strategy", "benchmark"], "line"),
    }
    out = {name: d[0] for name, d in data.items()}
    for name, (df, x, ys, kind) in data.items():
        draw(df, x=x, ys=ys, title=name.replace("_", " "), path=os.path.join(out_dir, f"{name}.png"), kind=kind)
    if per_fold:
        curves = out["fold_curves"] = curves_of_first_folds(detail)
        for r in first.collect() if can_draw() else ():  # MOST_FOLDS rows at most
            for column, what in (("equity_local", "equity"), ("dd_local", "drawdown")):
                draw(curves.where(F.col("fold_id") == r["fold_id"]), x="date", ys=[column], title=f"fold {r['fold_id']} {what}", path=os.path.join(out_dir, "folds", f"fold_{r['fold_id']}_{what}.png"))
    return out
