"""Small inputs."""

import math

import numpy as np
import pandas as pd


def asset(n=160):
    """A random walk on all days of the week."""
    moves = np.random.default_rng(12).normal(0, 0.02, n) * (np.arange(n) > 0)
    return pd.DataFrame({"date": pd.date_range("2021-03-01", periods=n), "Close": 40 * np.cumprod(1 + moves), "ret": moves})


def folds(days, train=40, test=15, step=25):
    """Folds by position, as long as the dates last."""
    starts = range(0, len(days) - train - test + 1, step)
    ends = [(s, s + train - 1, s + train, s + train + test - 1) for s in starts]
    return pd.DataFrame([{"fold_id": i, "train_start": days[a], "train_end": days[b], "test_start": days[c], "test_end": days[d]} for i, (a, b, c, d) in enumerate(ends)])


def price_panel(tickers=("AAA", "BBB"), n=30, start="2020-01-01"):
    days = pd.bdate_range(start, periods=n)
    rows = []
    for i, t in enumerate(tickers):
        for j, d in enumerate(days):
            c = 100 + 10 * i + j * (1 + 0.1 * i) + 3 * math.sin(j / 3 + i)
            rows.append((d, t, c - 0.5, c + 1, c - 1, c, 1000.0 + 100 * i + 37 * (j % 5) + j))
    return pd.DataFrame(rows, columns=["date", "ticker", "Open", "High", "Low", "Close", "Volume"])


def frame(spark, pdf):
    """A DataFrame whose missing values are NULL."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c, t in df.dtypes if t == "double"})
