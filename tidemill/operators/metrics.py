"""Curves, performance statistics, information coefficients, spreads and benchmarks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scan import compounded
from tidemill.functions.series import drawdown, growth, over, ranked, rolling_mean, rolling_sharpe, running
from tidemill.schema import FOLD_DATES, finite, number, ordered, require_columns

STATS = ("total_return", "cagr", "ann_vol", "sharpe", "sortino", "max_drawdown")


def pnl_column(df: DataFrame, *, keys: Sequence[str] = (), date: str = "date", ret_col: str = "ret", pos_col: str = "pos", pos_lag_col: str = "pos_lag", pnl_col: str = "pnl") -> Column:
    """pnl if df has it, else the lagged position times the return; missing values are 0."""
    if pnl_col in df.columns:
        return F.coalesce(number(pnl_col), F.lit(0.0))
    if ret_col not in df.columns:
        raise ValueError(f"pnl needs {pnl_col!r} or {ret_col!r}")
    if pos_lag_col in df.columns:
        held = F.coalesce(number(pos_lag_col), F.lit(0.0))
    elif pos_col in df.columns:
        held = F.coalesce(F.lag(number(pos_col)).over(over(keys, date)), F.lit(0.0))
    else:
        raise ValueError(f"pnl needs {pos_lag_col!r} or {pos_col!r}")
    return F.coalesce(finite(held * F.coalesce(number(ret_col), F.lit(0.0))), F.lit(0.0))


def add_pnl(df: DataFrame, *, keys: Sequence[str] = (), date: str = "date", start: float = 1.0, **columns: str) -> DataFrame:
    """df with pnl, pos_lag where it can be made, equity, and cum_pnl = equity - start."""
    w = over(keys, date)
    pos, lag = columns.get("pos_col", "pos"), columns.get("pos_lag_col", "pos_lag")
    if lag not in df.columns and pos in df.columns:
        df = df.withColumn(lag, F.coalesce(F.lag(number(pos)).over(w), F.lit(0.0)))
    rows = df.withColumn(columns.get("pnl_col", "pnl"), pnl_column(df, keys=keys, date=date, **columns))
    rows = rows.withColumn("equity", growth(F.col(columns.get("pnl_col", "pnl")), w, start))
    return rows.withColumn("cum_pnl", F.col("equity") - F.lit(start))


def fold_local_curves(detail: DataFrame, *, keys: Sequence[str] = (), date: str = "date", fold_col: str = "fold_id", **columns: str) -> DataFrame:
    """detail with equity_local and dd_local, which begin anew in each fold."""
    require_columns(detail, [fold_col, date], "the test detail")
    by = [*keys, fold_col]
    w = over(by, date)
    rows = detail.withColumn("_pnl", pnl_column(detail, keys=by, date=date, **columns))
    rows = rows.withColumn("equity_local", growth(F.col("_pnl"), w))
    return rows.withColumn("dd_local", drawdown(F.col("equity_local"), w)).drop("_pnl")


def stitched_curve(detail: DataFrame, *, keys: Sequence[str] = (), date: str = "date", on_duplicates: str = "raise", window: int | None = 63, periods: int = 252, **columns: str) -> DataFrame:
    """(keys, date, pnl, equity, drawdown[, rolling_sharpe]): one curve over all test rows.

    Dates that repeat are an error, found by one aggregation, or are summed. The curve runs
    over one row per date; with keys, one curve for each. Curves of any length lie in many tasks.
    """
    if on_duplicates not in ("raise", "sum"):
        raise ValueError(f"on_duplicates is 'raise' or 'sum', not {on_duplicates!r}")
    rows = detail.select(*keys, F.col(date).alias("date"), pnl_column(detail, keys=keys, date=date, **columns).alias("pnl"))
    if on_duplicates == "raise":
        twice = rows.groupBy(*keys, "date").count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"dates repeat, for example {[str(r['date']) for r in twice]}")
    else:
        rows = rows.groupBy(*keys, "date").agg(F.sum("pnl").alias("pnl"))
    w = over(keys, "date")
    rows = compounded(rows, "pnl", keys=keys, date="date")
    return rows.withColumn("rolling_sharpe", rolling_sharpe(F.col("pnl"), window, w, periods)) if window is not None and window >= 5 else rows


def buy_hold_curve(detail: DataFrame, *, ret_col: str = "ret", keys: Sequence[str] = (), date: str = "date", on_duplicates: str = "raise", window: int | None = 63, periods: int = 252) -> DataFrame:
    """The stitched curve of the asset itself."""
    require_columns(detail, [ret_col], "the test detail")
    held = detail.withColumn("_pnl_bh", F.coalesce(number(ret_col), F.lit(0.0)))
    return stitched_curve(held, keys=keys, date=date, on_duplicates=on_duplicates, window=window, periods=periods, pnl_col="_pnl_bh")


def sortino(x: Column, target: float = 0.0, periods: int = 252) -> Column:
    """Aggregate: the mean excess over the deviation (ddof 0) of what falls below the target, annualised."""
    below = F.stddev_pop(F.when(x < F.lit(target), x - F.lit(target)))
    return finite(F.try_divide(F.avg(x - F.lit(target)) * F.lit(float(periods)), F.when(below > 0, below) * F.sqrt(F.lit(float(periods)))))


def annualized(total: Column, n: Column, periods: int) -> Column:
    return finite(F.pow(F.lit(1.0) + total, F.lit(float(periods)) / n) - F.lit(1.0))


def stats_of(rows: DataFrame, values: Mapping[str, str], *, keys: Sequence[str] = (), date: str = "date", periods: int = 252, others: Sequence[Column] = (), drawdowns: bool = False) -> DataFrame:
    """One row per keys with STATS of each of the period returns ``values``, named by its pattern, and other aggregates: one aggregation.

    values: a name pattern such as ``{}_net`` -> column. Missing returns are left out of the
    statistics, but a key without any still has its row. Drawdowns are those of a window over
    each key, for rows that are one per date, or with ``drawdowns`` columns of rows (_dd0, ...).
    """
    w = over(keys, date)
    rows = rows.withColumns({f"_x{i}": number(c) for i, c in enumerate(values.values())})
    if not drawdowns:
        rows = rows.withColumns({f"_eq{i}": growth(F.col(f"_x{i}"), w) for i in range(len(values))})
        known = lambda i: F.when(F.col(f"_x{i}").isNotNull(), F.col(f"_eq{i}"))
        rows = rows.withColumns({f"_dd{i}": F.try_divide(known(i), F.max(known(i)).over(running(w))) - F.lit(1.0) for i in range(len(values))})
    out, root = [*others], F.sqrt(F.lit(float(periods)))
    for i, pattern in enumerate(values):
        x, n = F.col(f"_x{i}"), F.count(f"_x{i}")
        spread = F.when(n > 1, F.stddev_pop(x))
        total = F.when(n > 0, F.product(F.lit(1.0) + x) - F.lit(1.0))
        made = {
            "total_return": total,
            "cagr": F.when(n > 0, annualized(total, F.nullif(n, F.lit(0)), periods)),
            "ann_vol": spread * root,
            "sharpe": F.try_divide(F.avg(x), F.when(spread > 0, spread)) * root,
            "sortino": sortino(x, 0.0, periods),
            "max_drawdown": F.min(f"_dd{i}"),
        }
        out += [v.alias(pattern.format(k)) for k, v in made.items()]
    return rows.groupBy(*keys).agg(*out)


def perf_stats(df: DataFrame, value: str, *, keys: Sequence[str] = (), date: str = "date", periods: int = 252, prefix: str = "") -> DataFrame:
    """One row per keys with STATS of the period returns ``value``. Missing returns are left out of all of them.

    Drawdowns come from a segmented scan, so that a key's rows, however many, are aggregated where they lie.
    """
    rows = df.select(*keys, F.col(date).alias("_date"), number(value).alias("_value"))
    rows = compounded(rows, "_value", keys=keys, date="_date", equity="_eq0", drawdown="_dd0")
    return stats_of(rows, {prefix + "{}": "_value"}, keys=keys, date="_date", periods=periods, drawdowns=True)


def fold_summary(detail: DataFrame, *, keys: Sequence[str] = (), date: str = "date", fold_col: str = "fold_id", periods: int = 252, **columns: str) -> DataFrame:
    """One row per fold: rows, return, drawdown, annualised return and deviation, Sharpe ratio, share of gains."""
    require_columns(detail, [fold_col, date], "the test detail")
    by = [*keys, fold_col]
    w = over(by, date)
    rows = detail.withColumn("_pnl", pnl_column(detail, keys=by, date=date, **columns))
    rows = rows.withColumn("_eq", growth(F.col("_pnl"), w)).withColumn("_dd", drawdown(F.col("_eq"), w))
    x, n = F.col("_pnl"), F.count(F.lit(1))
    total, spread, root = F.product(F.lit(1.0) + x) - F.lit(1.0), F.when(n > 1, F.stddev_pop(x)), F.sqrt(F.lit(float(periods)))
    about = [c for c in (*FOLD_DATES, "source_file") if c in detail.columns and c not in by]
    out = rows.groupBy(*by).agg(
        *[F.min_by(c, date).alias(c) for c in about],
        n.alias("n_test_rows"),
        total.alias("total_return"),
        F.min("_dd").alias("max_drawdown"),
        annualized(total, n, periods).alias("ann_return"),
        (spread * root).alias("ann_vol"),
        (F.try_divide(F.avg(x), F.when(spread > 0, spread)) * root).alias("sharpe"),
        F.when(n > 1, F.avg((x > 0).cast("double"))).alias("win_rate"),
    )
    return ordered(out, ["source_file", fold_col, *FOLD_DATES])


def _correlation(a: Column, b: Column) -> Column:
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0)))


def ic_columns(score_col: str, forward_ret_col: str) -> list[Column]:
    """Aggregates over a date's rows: n_assets and ic_pearson of those with score and return."""
    a, b = number(score_col), number(forward_ret_col)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    spread = (F.count(a) >= 2) & (F.min(a) != F.max(a)) & (F.min(b) != F.max(b))
    return [F.count(a).alias("n_assets"), F.when(spread, _correlation(a, b)).alias("ic_pearson")]


def daily_ic(pred: DataFrame, *, score_col: str = "score", forward_ret_col: str = "forward_ret", keys: Sequence[str] = (), rank_ic: bool = True) -> DataFrame:
    """(keys, date, n_assets, ic_pearson, ic_spearman) over rows with score and return; NULL for fewer than 2 or without spread.

    Dates without such rows are kept.
    """
    require_columns(pred, ["date", score_col, forward_ret_col], "the predictions")
    rows = pred.select(*keys, "date", number(score_col).alias("a"), number(forward_ret_col).alias("b"))
    if not rank_ic:
        return rows.groupBy(*keys, "date").agg(*ic_columns("a", "b"), F.lit(None).cast("double").alias("ic_spearman"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = rows.select(*keys, "date", F.when(both, F.col("a")).alias("a"), F.when(both, F.col("b")).alias("b"))
    for value, rank in (("a", "ra"), ("b", "rb")):
        rows = ranked(rows, value, keys=[*keys, "date"], out=rank, count="_n").drop("_n")
    return rows.groupBy(*keys, "date").agg(*ic_columns("a", "b"), ic_columns("ra", "rb")[1].alias("ic_spearman"))


def ic_summary_columns(ic_col: str = "ic_pearson") -> list[Column]:
    x = number(ic_col)
    spread = F.stddev_pop(x)
    return [F.avg(x).alias("mean_ic"), spread.alias("ic_std"), F.try_divide(F.avg(x), F.when(spread > 0, spread)).alias("ic_ir"), F.count(x).alias("n_ic_days")]


def ic_summary(ic: DataFrame, *, ic_col: str = "ic_pearson", keys: Sequence[str] = ()) -> DataFrame:
    require_columns(ic, [ic_col], "the daily IC")
    return ic.groupBy(*keys).agg(*ic_summary_columns(ic_col))


def leg_columns(forward_ret_col: str = "forward_ret", weight_col: str = "weight") -> list[Column]:
    """Aggregates over a date's rows: counts and mean returns of the long and the short leg, and their difference."""
    w, r = number(weight_col), number(forward_ret_col)
    longs, shorts = F.when(w > 0, r), F.when(w < 0, r)
    return [F.count(longs).alias("n_longs"), F.count(shorts).alias("n_shorts"), F.avg(longs).alias("long_mean_ret"), F.avg(shorts).alias("short_mean_ret"), (F.avg(longs) - F.avg(shorts)).alias("spread")]


def long_short_spread(detail: DataFrame, *, forward_ret_col: str = "forward_ret", weight_col: str = "weight", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, date, n_longs, n_shorts, long_mean_ret, short_mean_ret, spread)."""
    require_columns(detail, ["date", weight_col, forward_ret_col], "the portfolio detail")
    return detail.groupBy(*keys, "date").agg(*leg_columns(forward_ret_col, weight_col))


def spread_summary_columns(spread_col: str = "spread") -> list[Column]:
    x = number(spread_col)
    return [F.avg(x).alias("mean_spread"), F.stddev_pop(x).alias("spread_std"), F.count(x).alias("n_spread_days")]


def spread_summary(spread: DataFrame, *, spread_col: str = "spread", keys: Sequence[str] = ()) -> DataFrame:
    require_columns(spread, [spread_col], "the daily spread")
    return spread.groupBy(*keys).agg(*spread_summary_columns(spread_col))


def portfolio_summary(daily: DataFrame, *, keys: Sequence[str] = (), periods: int = 252, others: Sequence[Column] = ()) -> DataFrame:
    """Gross and net statistics, mean turnover and cost over all days, the days with a position, and other aggregates of the days."""
    require_columns(daily, ["date", "portfolio_ret_gross", "portfolio_ret_net", "turnover", "cost"], "the portfolio days")
    traded = F.count_if(F.coalesce(number("gross_exposure"), F.lit(0.0)) > 0) if "gross_exposure" in daily.columns else F.count(number("portfolio_ret_net"))
    rest = [F.avg(number("turnover")).alias("mean_turnover"), F.avg(number("cost")).alias("mean_cost"), traded.alias("n_traded_days"), *others]
    made = stats_of(daily, {"{}_gross": "portfolio_ret_gross", "{}_net": "portfolio_ret_net"}, keys=keys, periods=periods, others=rest)
    return made.drop(*[f"{s}_gross" for s in STATS[1:]])


def join_rows(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Summaries side by side: by their keys, or, one row each, as they are."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys)) if keys else out.crossJoin(F.broadcast(p))  # one row
    return out


def benchmark_curves(pred: DataFrame, daily: DataFrame, *, label_col: str, equity_col: str = "equity", spy_ticker: str = "SPY") -> DataFrame:
    """The strategy's curve beside those of the equally weighted universe and of one ticker (NULL if it never appears)."""
    require_columns(pred, ["date", "ticker", label_col], "the predictions")
    require_columns(daily, ["date", equity_col], "the portfolio days")
    r = number(label_col)
    means = pred.groupBy("date").agg(F.avg(r).alias("eq_universe_return"), F.avg(F.when(F.col("ticker") == spy_ticker, r)).alias("spy_return"))
    rows = daily.select("date", number(equity_col).alias("strategy_equity")).join(means, "date", "left")
    w = over([], "date")
    curve = lambda c: growth(F.coalesce(F.col(c), F.lit(0.0)), w)
    known = F.count("spy_return").over(Window.partitionBy())
    return rows.withColumns({"eq_universe_equity": curve("eq_universe_return"), "spy_equity": F.when(known > 0, curve("spy_return"))})


def benchmark_summary(curves: DataFrame, *, return_col: str, prefix: str) -> DataFrame:
    """Five statistics of a benchmark, missing returns as 0; NULL if all are missing."""
    require_columns(curves, [return_col], "the benchmark curves")
    x = number(return_col)
    known = F.count(x).over(Window.partitionBy())
    rows = curves.select("date", F.when(known > 0, F.coalesce(x, F.lit(0.0))).alias("_r"))
    return perf_stats(rows, "_r", prefix=f"{prefix}_").drop(f"{prefix}_sortino")


def rolling_ic(ic: DataFrame, *, ic_col: str = "ic_pearson", window: int = 20) -> DataFrame:
    x = number(ic_col)
    return ic.select("date", x.alias(ic_col), rolling_mean(x, window, over([], "date"), max(3, window // 3)).alias("rolling_ic"))


def cumulative_legs(spread: DataFrame) -> DataFrame:
    """Compounded curves of the long leg, the short leg and the spread; missing values as 0."""
    w = over([], "date")
    return spread.select("date", *[growth(F.coalesce(number(c), F.lit(0.0)), w).alias(out) for c, out in (("long_mean_ret", "long_curve"), ("short_mean_ret", "short_curve"), ("spread", "spread_curve"))])


def leaders(df: DataFrame, value: str, *, n: int, ties: Sequence[str], worst: bool = False) -> DataFrame:
    """The n rows with the highest (``worst``: lowest) values, in order; missing values come last, ties by the columns named."""
    first = F.col(value).asc_nulls_last() if worst else F.col(value).desc_nulls_last()
    return df.orderBy(first, *ties).limit(n)
