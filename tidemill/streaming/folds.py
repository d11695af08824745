"""Smoothing and rate-limited positions over streams of bars, with a state of two numbers per ticker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


def _folded(stream: DataFrame, value: str, out: str, start: tuple[float | None, float], step: Callable[[tuple, float | None], tuple[tuple, float | None]]) -> DataFrame:
    """(ticker, date, value, out) of a stream. Rows of a trigger are taken by date; later triggers go on from the state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else start
        rows = pd.concat(list(parts)).sort_values("date", kind="mergesort")
        made = []
        for x in rows[value]:
            now, y = step(now, None if x is None or x != x else float(x))
            made.append(y)
        state.update(now)
        yield pd.DataFrame({"ticker": key[0], "date": rows["date"].to_numpy(), value: rows[value].to_numpy(float), out: pd.array(made, dtype="Float64").to_numpy(float, na_value=float("nan"))})

    return stream.select("ticker", "date", value).groupBy("ticker").applyInPandasWithState(run, f"ticker string, date timestamp, {value} double, {out} double", "a double, b double", "append", GroupStateTimeout.NoTimeout)


def stream_ema(stream: DataFrame, *, value: str = "score", span: int = 3, out: str = "score_smoothed") -> DataFrame:
    """The exponential average that ``smooth_scores`` makes of a whole table, trigger by trigger (NaN where the value is missing)."""
    alpha = 2.0 / (span + 1.0)

    def step(state: tuple, x: float | None) -> tuple[tuple, float | None]:
        y, w = state
        w *= 1 - alpha
        if x is None:
            return (y, w), None
        y = x if y is None or y != y else (w * y + alpha * x) / (w + alpha)
        return (y, 1.0), y

    return _folded(stream, value, out, (None, 1.0), step)


def stream_positions(stream: DataFrame, *, target: str = "target_pos", K: float = 1.0, step_frac: float = 0.25, out: str = "pos") -> DataFrame:
    """The position that follows its target by at most step_frac * K a row, within K; a missing target counts as 0."""
    most = step_frac * K

    def step(state: tuple, x: float | None) -> tuple[tuple, float | None]:
        p = min(K, max(-K, state[0] + min(most, max(-most, (x or 0.0) - state[0]))))
        return (p, 0.0), p

    return _folded(stream, target, out, (0.0, 0.0), step)
