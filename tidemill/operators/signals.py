"""Cross-sectional scores: smoothing by ticker, normalisation by date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scan import Smoothed, segmented_scan
from tidemill.functions.series import matched, ranked
from tidemill.schema import number, require_columns
from tidemill.shared import keep

NORMALIZATIONS = ("none", "zscore", "rank_to_minus1_plus1")
SMOOTHINGS = ("none", "ema_3", "ema_5")


def _one_of(name: str, known: Sequence[str], what: str) -> str:
    found = str(name).strip().lower()
    if found not in known:
        raise ValueError(f"{what} {name!r} is not one of {list(known)}")
    return found


def smooth_scores(df: DataFrame, *, score_col: str = "score", smoothing: str = "none", out_col: str = "score_smoothed", keys: Sequence[str] = ()) -> DataFrame:
    """df with an exponential average of each ticker's scores over its dates, through all folds.

    Recursive weights: a gap decays the weight of the past, and a row without a score gets none.
    A ticker's series may be of any length: see ``segmented_scan``.
    """
    method = _one_of(smoothing, SMOOTHINGS, "score smoothing")
    require_columns(df, ["date", "ticker", score_col], "the score table")
    rows = df.withColumn("_score", number(score_col))
    if method == "none":
        return rows.withColumn(out_col, F.col("_score")).drop("_score")
    alpha = 2.0 / (int(method.split("_")[1]) + 1.0)
    order = ["date", "fold_id"] if "fold_id" in df.columns else ["date"]
    by = [*keys, "ticker"]
    made = segmented_scan(rows.drop(out_col), keys=by, order=order, inputs=["_score"], outs=[out_col], recurrence=Smoothed(alpha))
    return made.drop("_score")


def normalize_scores(df: DataFrame, *, score_col: str = "score", normalization: str = "none", out_col: str = "score_normalized", keys: Sequence[str] = ()) -> DataFrame:
    """df with scores made comparable within each date; a date without spread gets 0, a missing score stays missing.

    Dates of any size: their statistics are aggregated before they are shuffled, and ranks are those of ``ranked``.
    """
    method = _one_of(normalization, NORMALIZATIONS, "score normalization")
    require_columns(df, ["date", score_col], "the score table")
    rows, by, x = df.withColumn("_score", number(score_col)), [*keys, "date"], F.col("_score")
    if method == "none":
        made = x
    elif method == "zscore":
        rows = keep(rows)
        rows = matched(rows, rows.groupBy(*by).agg(F.avg("_score").alias("_mean"), F.stddev_pop("_score").alias("_spread")), by)
        made = F.when(x.isNotNull(), F.when(F.col("_spread") > 0, (x - F.col("_mean")) / F.col("_spread")).otherwise(0.0))
    else:
        rows = ranked(rows, "_score", keys=by, out="_rank", count="_n")
        scaled = F.lit(2.0) * (F.col("_rank") - F.lit(1.0)) / F.nullif(F.col("_n") - 1, F.lit(0)) - F.lit(1.0)
        # A day of one value has no spread of ranks but its mean, which is 0 already.
        made = F.when(x.isNotNull(), F.when(F.col("_n") > 1, scaled).otherwise(0.0))
    return rows.withColumn(out_col, made).drop("_score", "_mean", "_spread", "_rank", "_n")


def prepare_scores(df: DataFrame, *, raw_score_col: str = "score", out_col: str = "score_signal", smoothing: str = "none", normalization: str = "none", keys: Sequence[str] = ()) -> DataFrame:
    """Smooths by ticker, then normalises by date."""
    smoothed = smooth_scores(df, score_col=raw_score_col, smoothing=smoothing, out_col="_smoothed", keys=keys)
    return normalize_scores(smoothed, score_col="_smoothed", normalization=normalization, out_col=out_col, keys=keys).drop("_smoothed")
