"""Single-asset mean reversion: z-score signal, rate-limited position, pnl, and its walk-forward run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemill.functions.scan import RateLimited, segmented_scan
from tidemill.functions.series import growth, over, rolling_mean, rolling_std, running
from tidemill.plans.walkforward import fold_rows, normalized_plan
from tidemill.schema import FOLD_DATES, finite, number, ordered, require_columns
from tidemill.shared import settle


@dataclass(frozen=True)
class ZScoreConfig:
    """n rows of history, largest position K, share of K that a position moves per row, ddof of the deviation, rows that a z needs (n if None)."""

    n: int = 20
    K: float = 1.0
    step_frac: float = 0.25
    ddof: int = 0
    min_periods: int | None = None

    def checked(self) -> ZScoreConfig:
        if self.n < 2:
            raise ValueError(f"n is at least 2, not {self.n}")
        if self.K <= 0:
            raise ValueError(f"K is above 0, not {self.K}")
        if not 0 < self.step_frac <= 1:
            raise ValueError(f"step_frac is above 0 and at most 1, not {self.step_frac}")
        return self


def rung_target(z: Column, K: float) -> Column:
    """Against the sign of z, a quarter of K for each full deviation up to four; 0 where z is unknown."""
    size = F.least(F.floor(F.abs(z)), F.lit(4)) * F.lit(0.25)
    return F.coalesce(-F.signum(z) * size * F.lit(float(K)), F.lit(0.0)) + F.lit(0.0)


def rate_limited(df: DataFrame, *, target: str, out: str, keys: Sequence[str], order: Sequence[str], K: float, step_frac: float | str) -> DataFrame:
    """df with a position that starts at 0 for each key and moves to its target by at most step_frac * K a row, within ±K.

    step_frac is a number, or the name of a column that has one for each key. A missing target counts
    as 0. A series may be of any length: see ``segmented_scan``.
    """
    share = F.col(step_frac) if isinstance(step_frac, str) else F.lit(float(step_frac))
    rows = df.withColumns({"_to": number(target), "_most": share.cast("double") * F.lit(float(K))})
    least = df.agg(F.min(step_frac)).first()[0] if isinstance(step_frac, str) else step_frac
    limited = RateLimited(float(K), float(K) * float(1.0 if least is None else least))
    return segmented_scan(rows, keys=keys, order=order, inputs=["_to", "_most"], outs=[out], recurrence=limited).drop("_to", "_most")


def zscore(price: Column, cfg: ZScoreConfig, w: WindowSpec) -> Column:
    mean, spread = rolling_mean(price, cfg.n, w, cfg.min_periods), rolling_std(price, cfg.n, w, ddof=cfg.ddof, least=cfg.min_periods)
    return finite(F.try_divide(price - mean, F.nullif(spread, F.lit(0.0))))


def zscore_position(df: DataFrame, *, price_col: str = "Close", cfg: ZScoreConfig = ZScoreConfig(), keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """df with z, target_pos and pos. keys: what tells series apart; without any, df is one series."""
    cfg = cfg.checked()
    require_columns(df, [date, price_col], "the price table")
    one = [] if keys else ["_series"]
    rows = df.withColumn("_series", F.lit(0)) if one else df
    by = [*keys, *one]
    rows = rows.withColumn("z", zscore(number(price_col), cfg, over(by, date))).withColumn("target_pos", rung_target(F.col("z"), cfg.K))
    rows = rate_limited(rows, target="target_pos", out="pos", keys=by, order=[date], K=cfg.K, step_frac=cfg.step_frac)
    return rows.drop(*one)


def backtest_ret(df: DataFrame, *, pos: str = "pos", ret_col: str = "ret", keys: Sequence[str] = (), date: str = "date", fill_missing: bool = True, cost_bps: float = 0.0, before: str | None = None) -> DataFrame:
    """df with pos, pos_lag, ret, pnl_gross, turnover, cost, pnl, cum_pnl (sum) and equity (product).

    The position of a row earns the next row's return. Turnover is the change of the
    position, 0 on a series' first row. The return is always named ``ret``. before: the column that
    has the position a row earlier (NULL on the first), if it is known.
    """
    require_columns(df, [date, pos, ret_col], "the backtest table")
    w = over(keys, date)
    held, got = F.coalesce(number(pos), F.lit(0.0)), number(ret_col)
    rows = df.withColumns({"pos": held, "ret": F.coalesce(got, F.lit(0.0)) if fill_missing else got})
    last = F.col(before) if before else F.lag("pos").over(w)
    rows = rows.withColumns({"pos_lag": F.coalesce(last, F.lit(0.0)), "turnover": F.coalesce(F.abs(F.col("pos") - last), F.lit(0.0))})
    rows = rows.withColumns({"pnl_gross": F.col("pos_lag") * F.col("ret"), "cost": F.col("turnover") * F.lit(float(cost_bps) / 10_000.0)})
    rows = rows.withColumn("pnl", F.col("pnl_gross") - F.col("cost"))
    return with_curves(rows, w)


def with_curves(rows: DataFrame, w) -> DataFrame:
    """rows with cum_pnl and equity of pnl from the start of the window's partition."""
    pnl = F.coalesce(F.col("pnl"), F.lit(0.0))
    return rows.withColumns({"cum_pnl": F.sum(pnl).over(running(w)), "equity": growth(pnl, w)})


def backtest_logret(df: DataFrame, *, pos: str = "pos", logret_col: str = "log_ret", keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """df with pos_lag, pnl, cum_pnl and equity = exp(cum_pnl) from log returns; NULL where pnl is unknown."""
    require_columns(df, [date, pos, logret_col], "the backtest table")
    w = over(keys, date)
    rows = df.withColumns({"pos": number(pos), "log_ret": number(logret_col)}).withColumn("pos_lag", F.lag("pos").over(w))
    rows = rows.withColumn("pnl", F.col("pos_lag") * F.col("log_ret"))
    rows = rows.withColumn("cum_pnl", F.when(F.col("pnl").isNotNull(), F.sum("pnl").over(running(w))))
    return rows.withColumn("equity", F.exp("cum_pnl"))


DETAIL_FIRST = ("source_file", "fold_id", *FOLD_DATES, "z", "target_pos", "pos", "pos_lag", "ret", "pnl", "cum_pnl", "equity", "log_ret", "turnover", "cost", "pnl_gross")


def walkforward_backtest(
    df: DataFrame,
    plan: DataFrame,
    *,
    price_col: str = "Close",
    ret_col: str = "ret",
    cfg: ZScoreConfig = ZScoreConfig(),
    source_file: str | None = None,
    keys: Sequence[str] = (),
    date: str = "date",
    fill_missing: bool = True,
    cost_bps: float = 0.0,
    check: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The test rows of every fold with signal, position and pnl; cum_pnl and equity begin anew in each fold.

    Signal and position run from train_start on, all folds at once. Where a z needs all its n rows, a
    panel's rows are shuffled and stored once, not by fold (``fold_positions``); else, and without keys, they are
    dealt by (keys, fold_id). Of rows that repeat a date the least by all columns stays. With ``check``, a
    fold without test rows is an error (one small job more). columns: those of df besides keys and date that
    the result has; all if None.
    """
    shown = None if columns is None else [c for c in dict.fromkeys([*keys, date, *columns, ret_col]) if c not in plan.columns]
    by = [*keys, "fold_id"]
    if keys and (cfg.min_periods is None or cfg.min_periods >= cfg.n):
        folds, rows = one_row_a_date(df, plan, source_file=source_file, keys=keys, date=date)
        folds = settle(folds)
        signal = fold_positions(rows, folds, price_col=price_col, cfg=cfg, keys=keys, date=date, shown=shown)
        tested = tested_rows(signal, ret_col=ret_col, keys=by, date=date, fill_missing=fill_missing, cost_bps=cost_bps, before="_before").drop("_before")
    else:
        folds, inside = rows_of_folds(df, plan, source_file=source_file, keys=keys, date=date)
        signal = zscore_position(inside, price_col=price_col, cfg=cfg, keys=by, date=date)
        if shown is not None:
            signal = signal.select(*shown, *[c for c in (*folds.columns, "z", "target_pos", "pos") if c not in shown])
        tested = tested_rows(signal, ret_col=ret_col, keys=by, date=date, fill_missing=fill_missing, cost_bps=cost_bps)
    if check:
        empty = folds.join(tested.select("fold_id").distinct(), "fold_id", "left_anti").select("fold_id").take(5)
        if empty:
            raise ValueError(f"folds without test rows: {[r.fold_id for r in empty]}")
    if shown is not None and ret_col not in ("ret", *columns):
        tested = tested.drop(ret_col)
    return ordered(tested, DETAIL_FIRST)


def one_row_a_date(df: DataFrame, plan: DataFrame, *, source_file: str | None = None, keys: Sequence[str] = (), date: str = "date") -> tuple[DataFrame, DataFrame]:
    """(folds, df without their columns). Of rows that repeat a date the least by all columns stays."""
    folds = normalized_plan(plan)
    if source_file is not None and "source_file" in folds.columns:
        folds = folds.where(F.col("source_file") == source_file)
        if not folds.take(1):
            raise ValueError(f"no folds are left for source_file={source_file!r}")
    rows = df.drop(*(c for c in folds.columns if c in df.columns))
    rest = [c for c in rows.columns if c not in (*keys, date)]
    return folds, rows.groupBy(*keys, date).agg(F.min(F.struct(*rest)).alias("_row")).select(*(F.col(f"_row.{c}").alias(c) if c in rest else c for c in rows.columns))


def rows_of_folds(df: DataFrame, plan: DataFrame, *, source_file: str | None = None, keys: Sequence[str] = (), date: str = "date") -> tuple[DataFrame, DataFrame]:
    """(folds, the rows of each from train_start to test_end). Of rows that repeat a date the least by all columns stays."""
    folds, rows = one_row_a_date(df, plan, source_file=source_file, keys=keys, date=date)
    return folds, fold_rows(rows, folds, start="train_start", end="test_end", date=date)


def fold_positions(rows: DataFrame, folds: DataFrame, *, price_col: str, cfg: ZScoreConfig, keys: Sequence[str], date: str, shown: Sequence[str] | None = None) -> DataFrame:
    """The rows of every fold with z, target_pos, pos and _before, the position a row earlier (NULL on a fold's first row).

    A z that needs all its n rows is the same in each fold that has them. It is taken once for a series, and the
    date of the first of its rows tells the folds that know it. Rows are listed by fold in the
    task that has them, so what is shuffled and stored does not grow with the folds that a row lies in. shown: the
    columns of rows that are stored, all if None.
    """
    cfg = cfg.checked()
    require_columns(rows, [date, price_col], "the price table")
    w = over(keys, date)
    rows = rows.withColumns({"z": zscore(number(price_col), cfg, w), "_since": F.lag(date, cfg.n - 1).over(w)})
    if shown is not None:
        rows = rows.select(*shown, "z", "_since")

    def listed(settled: DataFrame) -> DataFrame:
        inside = fold_rows(settled, F.broadcast(folds), start="train_start", end="test_end", date=date)
        inside = inside.withColumn("z", F.when(F.col("_since") >= F.col("train_start"), F.col("z"))).drop("_since")
        inside = inside.withColumn("target_pos", rung_target(F.col("z"), cfg.K))
        return inside.withColumn("_most", F.lit(float(cfg.K) * float(cfg.step_frac)))

    limited = RateLimited(cfg.K, float(cfg.K) * float(cfg.step_frac), before=True)
    return segmented_scan(rows, keys=keys, order=[date], inputs=["target_pos", "_most"], outs=["pos", "_before"], recurrence=limited, listed=listed, within=["fold_id"]).drop("_most")


def tested_rows(signal: DataFrame, *, ret_col: str, keys: Sequence[str], date: str = "date", fill_missing: bool = True, cost_bps: float = 0.0, before: str | None = None) -> DataFrame:
    """The test rows of positions with pnl, and curves that begin with them. before: as for ``backtest_ret``; then no other rows are shuffled."""
    in_test = (F.col(date) >= F.col("test_start")) & (F.col(date) <= F.col("test_end"))
    options = {"ret_col": ret_col, "keys": keys, "date": date, "fill_missing": fill_missing, "cost_bps": cost_bps}
    if before:
        return backtest_ret(signal.where(in_test).repartition(*keys), before=before, **options)
    return with_curves(backtest_ret(signal, **options).where(in_test), over(keys, date))
