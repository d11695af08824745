"""Backward-looking daily features and forward-return labels, per ticker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.series import ahead, change, over, rolling_mean, rolling_std
from tidemill.schema import PANEL_COLUMNS, number, require_columns

FEATURES = ("ret_1d", "ret_5d", "ret_10d", "vol_5d", "vol_20d", "dist_ma_5", "dist_ma_20", "vol_ratio_20")
HORIZONS = (1, 3, 5)


def make_daily_features(panel: DataFrame) -> DataFrame:
    """panel with FEATURES. All windows share one partitioning and order, so there is one shuffle and one sort."""
    require_columns(panel, PANEL_COLUMNS, "the panel")
    w = over(["ticker"], "date")
    close, volume = number("Close"), number("Volume")
    out = panel.withColumns({f"ret_{n}d": change(close, n, w) for n in (1, 5, 10)})
    ret = F.col("ret_1d")
    return out.withColumns(
        {
            **{f"vol_{n}d": rolling_std(ret, n, w, ddof=1) for n in (5, 20)},
            **{f"dist_ma_{n}": F.try_divide(close, rolling_mean(close, n, w)) - F.lit(1.0) for n in (5, 20)},
            "vol_ratio_20": F.try_divide(volume, rolling_mean(volume, 20, w)),
        }
    )


def label_name(horizon: int) -> str:
    return f"label_{horizon}d_fwd"


def add_forward_return_label(panel: DataFrame, horizon: int = 1, *, price_col: str = "Close", label_col: str | None = None) -> DataFrame:
    """panel with the return over the next ``horizon`` rows of its ticker; NULL on the last ones."""
    if horizon < 1:
        raise ValueError(f"a horizon is at least 1, not {horizon}")
    require_columns(panel, ["date", "ticker", price_col], "the panel")
    return panel.withColumn(label_col or label_name(horizon), ahead(number(price_col), horizon, over(["ticker"], "date")))


def add_forward_return_labels(panel: DataFrame, horizons: Sequence[int] = HORIZONS, *, price_col: str = "Close") -> DataFrame:
    """A label for each distinct horizon, in the order of their first mention."""
    for h in dict.fromkeys(horizons):
        panel = add_forward_return_label(panel, h, price_col=price_col)
    return panel
