"""Simple and log returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.series import change, log_change, over
from tidemill.schema import number, require_columns


def price_column(df: DataFrame, price_col: str | None = None) -> str:
    """The named column, else Adj_Close, else Close."""
    for c in (price_col,) if price_col else ("Adj_Close", "Close"):
        if c in df.columns:
            return c
    raise ValueError(f"no price column {price_col or 'Adj_Close or Close'}; there are {df.columns}")


def add_returns(df: DataFrame, price_col: str | None = None, *, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """df with ``ret`` and ``log_ret``, which are overwritten if they exist. keys: what tells series apart."""
    p, w = number(price_column(df, price_col)), over(keys, date)
    return df.withColumns({"ret": change(p, 1, w), "log_ret": log_change(p, w)})


def ensure_returns(df: DataFrame, *, price_col: str = "Close", ret_col: str = "ret", log_ret_col: str = "log_ret", keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """df with those of the two return columns that it lacks."""
    if ret_col in df.columns and log_ret_col in df.columns:
        return df
    require_columns(df, [price_col], "the price table")
    p, w = number(price_col), over(keys, date)
    made = {ret_col: change(p, 1, w), log_ret_col: log_change(p, w)}
    return df.withColumns({k: v for k, v in made.items() if k not in df.columns})


def first_of_each(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """One row for each key: the one that comes first by ``position``."""
    w = over(keys, position)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
