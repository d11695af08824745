"""Column contracts and the policy for missing values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE_COLUMNS = ("Open", "High", "Low", "Close", "Volume")
PANEL_COLUMNS = ("date", "ticker", *PRICE_COLUMNS)
FOLD_DATES = ("train_start", "train_end", "test_start", "test_end")
PLAN_COLUMNS = ("fold_id", *FOLD_DATES)


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Raises ValueError that names the missing and the available columns. Runs no job."""
    wanted = list(columns)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it needs {wanted} and has {df.columns}")


def number(c: str | Column) -> Column:
    """A double; NULL for what is not a number, for NaN and for infinities."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def finite(c: Column) -> Column:
    """c with NaN and infinities as NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ordered(df: DataFrame, first: Iterable[str]) -> DataFrame:
    """The columns of ``first`` that df has, then its others."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])
