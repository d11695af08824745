"""Expressions over ordered series: returns, rolling statistics, curves and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.shared import keep


def over(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def change(c: Column, n: int, w: WindowSpec) -> Column:
    """c relative to n rows earlier, minus 1; NULL where that is unknown or zero."""
    return F.try_divide(c, F.lag(c, n).over(w)) - F.lit(1.0)


def log_change(c: Column, w: WindowSpec) -> Column:
    x = F.when(c > 0, c)
    return F.ln(x) - F.ln(F.lag(x, 1).over(w))


def ahead(c: Column, n: int, w: WindowSpec) -> Column:
    """c n rows later relative to now, minus 1."""
    return F.try_divide(F.lead(c, n).over(w), c) - F.lit(1.0)


def enough(c: Column, frame: WindowSpec, least: int, value: Column) -> Column:
    """value where the frame has at least ``least`` values of c."""
    return F.when(F.count(c).over(frame) >= least, value)


def rolling_mean(c: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    frame = last_rows(w, n)
    return enough(c, frame, n if least is None else least, F.avg(c).over(frame))


def rolling_std(c: Column, n: int, w: WindowSpec, *, ddof: int, least: int | None = None) -> Column:
    frame = last_rows(w, n)
    spread = F.stddev_samp(c) if ddof == 1 else F.stddev_pop(c)
    return enough(c, frame, n if least is None else least, spread.over(frame))


def growth(c: Column, w: WindowSpec, start: float = 1.0) -> Column:
    """The compounded curve of period returns; a missing return leaves it as it was."""
    return F.lit(start) * F.product(F.coalesce(F.lit(1.0) + c, F.lit(1.0))).over(running(w))


def drawdown(equity: Column, w: WindowSpec) -> Column:
    """Relative to the highest value so far, which does not include the start."""
    return F.try_divide(equity, F.max(equity).over(running(w))) - F.lit(1.0)


def rolling_sharpe(c: Column, n: int, w: WindowSpec, periods: int = 252) -> Column:
    """Mean over standard deviation of the last n rows, annualised; NULL where that is not defined."""
    least = max(5, n // 3)
    return F.try_divide(rolling_mean(c, n, w, least), F.nullif(rolling_std(c, n, w, ddof=0, least=least), F.lit(0.0))) * F.sqrt(F.lit(float(periods)))


def matched(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """rows with the other columns of a table that has one row for each value of keys; NULL keys match too."""
    named = table.select(*[F.col(k).alias(f"_m_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys], how).drop(*[f"_m_{k}" for k in keys])


def value_bin(c: Column) -> Column:
    """A number that never falls as c rises: sign and a sixteenth of a power of 2."""
    size = F.floor(F.log2(F.abs(c)) * 16) + F.lit(20_000)
    return F.when(c > 0, size).when(c < 0, -size).otherwise(F.lit(0)).cast("int")


def ranked(df: DataFrame, value: str, *, keys: Sequence[str], out: str, count: str) -> DataFrame:
    """df with ranks of a double from 1 within keys, ties at their mean, and the number of values; missing values have no rank.

    Two levels: equal values are counted before they are shuffled, ranked within bins of values, and
    the bins' totals, a row for each bin of a key, give each bin's first rank. So neither a key with most
    rows nor a value that most of them share is sorted in one task. df is kept for its two readers.
    """
    rows = keep(df)
    by_bin = [*keys, "_bin"]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties")).withColumn("_bin", value_bin(F.col(value)))
    counts = counts.withColumn("_upto", F.sum("_ties").over(running(over(by_bin, value))))
    bins = counts.groupBy(*by_bin).agg(F.sum("_ties").alias("_size"))
    below = F.coalesce(F.sum("_size").over(over(keys, "_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumns({"_below": below, count: F.sum("_size").over(Window.partitionBy(*keys))})
    found = matched(counts, bins, by_bin, "inner")
    rank = F.col("_below") + F.col("_upto") - (F.col("_ties") - F.lit(1.0)) / F.lit(2.0)
    return matched(rows, found.select(*keys, value, rank.alias(out), count), [*keys, value])
