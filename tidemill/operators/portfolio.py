"""Daily long-short portfolios of the highest and lowest scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.series import growth, matched, over
from tidemill.schema import number, require_columns
from tidemill.shared import keep


def top_bottom_weights(pred: DataFrame, *, score_col: str = "score", forward_ret_col: str = "forward_ret", k: int | Column = 3, keys: Sequence[str] = ()) -> DataFrame:
    """pred with forward_ret, weight, is_constant_score_day, n_valid_scores, prev_weight, abs_weight_change and contribution.

    Candidates of a date have a score and a forward return. The k highest scores (ties by
    ticker) share +1 and the k lowest -1, with k at most half of the candidates; where both
    would take a row, the short side does. Dates of one distinct score stay flat. A date's two
    last rows, one of each side, are found from the first k of each task and mark the others, so dates may have any
    number of rows. The candidates are kept for that.
    """
    require_columns(pred, ["date", "ticker", score_col, forward_ret_col], "the predictions")
    if isinstance(k, int) and k < 1:
        raise ValueError(f"k is at least 1, not {k}")
    rows = pred.withColumns({"_score": number(score_col), "forward_ret": number(forward_ret_col)})
    tie, by = [c for c in ("fold_id",) if c in pred.columns], [*keys, "date"]
    # What orders a side's candidates; repeated rows follow by a number that the kept rows carry.
    side = lambda score: F.when(F.col("_ok"), F.struct(score.alias("score"), "ticker", *tie, "_row"))
    rows = rows.withColumns({"_ok": F.col("_score").isNotNull() & F.col("forward_ret").isNotNull(), "_row": F.monotonically_increasing_id()})
    rows = keep(rows.withColumns({"_long": side(-F.col("_score")), "_short": side(F.col("_score"))}))
    most = k if isinstance(k, int) else rows.agg(F.max(k)).first()[0] or 0
    score = F.when(F.col("_ok"), F.col("_score"))
    held = F.max(k) if isinstance(k, Column) else F.lit(k)
    days = rows.groupBy(*by).agg(
        F.count(score).alias("n_valid_scores"),
        F.coalesce(F.min(score) == F.max(score), F.lit(False)).alias("is_constant_score_day"),
        F.least(held, F.floor(F.count(score) / 2)).alias("_size"),
    )
    for name in ("_long", "_short"):
        # A limit on a rank is applied in each task before rows are shuffled, so a date brings a few rows of each task.
        first = rows.where("_ok").select(*by, name).withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(name))).where(F.col("_place") <= most)
        last = matched(first, days.select(*by, "_size"), by, "inner").where(F.col("_place") == F.col("_size")).select(*by, F.col(name).alias(f"{name}_last"))
        days = matched(days, last, by)
    rows = matched(rows, days, by)
    taken = F.col("_ok") & ~F.col("is_constant_score_day")
    inside = lambda name: F.coalesce(F.col(name) <= F.col(f"{name}_last"), F.lit(False))
    size = F.col("_size")
    weight = F.when(taken & inside("_short"), F.lit(-1.0) / size).when(taken & inside("_long"), F.lit(1.0) / size).otherwise(0.0)
    rows = rows.withColumn("weight", weight).drop("_score", "_ok", "_row", "_size", "_long", "_short", "_long_last", "_short_last")
    own = over([*keys, "ticker"], "date", *tie)
    rows = rows.withColumn("prev_weight", F.lag("weight", 1, 0.0).over(own))
    return rows.withColumns({"abs_weight_change": F.abs(F.col("weight") - F.col("prev_weight")), "contribution": F.when(F.col("weight") != 0, F.col("weight") * F.col("forward_ret")).otherwise(0.0)})


def portfolio_daily(detail: DataFrame, *, cost_bps: float = 0.0, keys: Sequence[str] = (), others: Sequence[Column] = ()) -> DataFrame:
    """One row per (keys, date): return, turnover, exposures, counts, cost, net return, the equity curve, and other aggregates of the rows."""
    require_columns(detail, ["date", "weight", "contribution", "abs_weight_change", "is_constant_score_day", "n_valid_scores"], "the portfolio detail")
    w = F.col("weight")
    daily = detail.groupBy(*keys, "date").agg(
        F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("portfolio_ret_gross"),
        (F.lit(0.5) * F.sum("abs_weight_change")).alias("turnover"),
        F.sum(F.abs(w)).alias("gross_exposure"),
        F.sum(w).alias("net_exposure"),
        F.count_if(w > 0).alias("n_longs"),
        F.count_if(w < 0).alias("n_shorts"),
        F.bool_or("is_constant_score_day").alias("is_constant_score_day"),
        F.max("n_valid_scores").alias("n_valid_scores"),
        *others,
    )
    daily = daily.withColumn("cost", F.col("turnover") * F.lit(float(cost_bps) / 10_000.0))
    daily = daily.withColumn("portfolio_ret_net", F.col("portfolio_ret_gross") - F.col("cost"))
    return daily.withColumn("equity", growth(F.col("portfolio_ret_net"), over(keys, "date")))


def top_bottom_portfolio(pred: DataFrame, *, score_col: str = "score", forward_ret_col: str = "forward_ret", k: int | Column = 3, cost_bps: float = 0.0, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(detail, daily)."""
    detail = top_bottom_weights(pred, score_col=score_col, forward_ret_col=forward_ret_col, k=k, keys=keys)
    return detail, portfolio_daily(detail, cost_bps=cost_bps, keys=keys)


def ticker_selection(detail: DataFrame, *, score_col: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """How often and how well each ticker was held, over all dates of the detail."""
    require_columns(detail, ["ticker", "date", score_col, "forward_ret", "weight", "contribution"], "the portfolio detail")
    w, r, c = F.coalesce(number("weight"), F.lit(0.0)), number("forward_ret"), F.coalesce(number("contribution"), F.lit(0.0))
    days = detail.groupBy(*keys).agg(F.count_distinct("date").alias("_days"))
    out = detail.groupBy(*keys, "ticker").agg(
        F.count_if(w > 0).alias("n_long_days"),
        F.count_if(w < 0).alias("n_short_days"),
        F.avg(number(score_col)).alias("avg_score"),
        F.avg(F.when(w > 0, r)).alias("avg_forward_return_when_long"),
        F.avg(F.when(w < 0, r)).alias("avg_forward_return_when_short"),
        F.avg(c).alias("mean_contribution"),
        F.sum(c).alias("total_contribution"),
        F.avg(F.when(w != 0, F.abs(w))).alias("avg_weight_when_selected"),
    )
    out = out.join(days, list(keys)) if keys else out.crossJoin(F.broadcast(days))  # one row
    return out.withColumns({"selection_rate_long": F.col("n_long_days") / F.col("_days"), "selection_rate_short": F.col("n_short_days") / F.col("_days")}).drop("_days")
