"""Recurrences over ordered series of any length: segmented prefix scans.

Rows are range-partitioned by series and order, so a long series lies in many tasks. The steps of
a recurrence are functions of its state that can be composed as data. A first pass composes the steps
of the series that each task ends with, one summary per task; the driver chains those few summaries to the
state in which each task's first series begins; a second pass applies the steps. Inside a task,
stretches of rows (lanes) advance side by side in numpy, by the same composition.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemill.shared import settle

#: Rows that advance one after the other in a lane, and rows that are worked on at once.
LANE, ROWS = 256, 1 << 16


class Recurrence(Protocol):
    """Steps over rows of ``inputs`` numbers (NaN: missing). States and summaries are arrays of a few numbers."""

    def start(self) -> np.ndarray:
        """The state before a series' first row."""

    def summary(self, x: np.ndarray) -> np.ndarray:
        """The composed steps of rows that follow each other in one series."""

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The steps of a, then those of b."""

    def after(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        """The state that composed steps lead to."""

    def run(self, x: np.ndarray, first: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(output of each row, last state) of rows of which ``first`` begin series; ``state`` is that before the first row."""


def lanes(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, fresh) of stretches of at most LANE rows within series; fresh ones begin a series."""
    cuts = np.flatnonzero(first) if len(first) and first[0] else np.r_[0, np.flatnonzero(first)]
    sizes = np.diff(np.r_[cuts, len(first)])
    pieces = -(-sizes // LANE)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(cuts, pieces) + nth * LANE
    lengths = np.diff(np.r_[starts, len(first)])
    return starts, lengths, first[starts] & (nth == 0)


def _steps(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
    """(lanes that still run, their rows), step by step. Lanes must come by falling length."""
    for i in range(int(lengths.max(initial=0))):
        alive = int(np.searchsorted(-lengths, -i, "left"))
        yield slice(0, alive), starts[:alive] + i


class RateLimited:
    """A position that moves to its target by at most the row's limit and stays within ±bound. Inputs: target (NaN: 0), limit above 0.

    A composed step maps [-bound, bound] onto [low, high], rising by 1 or not at all. It is kept as low, high
    and the places of the image that an interval of starts falls on, with the interval's width. A step joins
    all places within its limit of the target, and those in between; each such join away from the ends
    takes twice the limit of the image, so there are at most bound / limit + 2 places. With ``before`` a second
    output is the position a row earlier (NaN on a series' first row).
    """

    def __init__(self, bound: float, least: float, *, before: bool = False):
        self.bound, self.places, self.before = float(bound), int(np.ceil(float(bound) / float(least))) + 4, before

    def start(self) -> np.ndarray:
        return np.zeros(1)

    def _inputs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.clip(np.nan_to_num(x[:, 0], nan=0.0, posinf=self.bound, neginf=-self.bound), -self.bound, self.bound), x[:, 1]

    def _composed(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A summary per lane: low, high, places, widths (0: unused)."""
        to, most = self._inputs(x)
        n, p = len(starts), self.places
        order = np.argsort(-lengths, kind="stable")
        low, high, at, wide = np.full(n, -self.bound), np.full(n, self.bound), np.zeros((n, p)), np.zeros((n, p))
        for some, rows in _steps(starts[order], lengths[order]):
            t, m = to[rows], most[rows]
            y, w = at[some], wide[some]
            joined = (np.abs(y - t[:, None]) <= m[:, None]) & (w > 0)
            more = np.maximum(0.0, np.minimum(high[some], t + m) - np.maximum(low[some], t - m)) + np.where(joined, w, 0).sum(axis=1)
            free = np.where(joined, 0, w) == 0
            if not free.any(axis=1).all():  # rounding alone can take more places than the bound says
                at, wide = np.pad(at, ((0, 0), (0, 4))), np.pad(wide, ((0, 0), (0, 4)))
                y, w, joined, free = at[some], wide[some], np.pad(joined, ((0, 0), (0, 4))), np.pad(free, ((0, 0), (0, 4)), constant_values=True)
            slot = np.where(joined.any(axis=1), joined.argmax(axis=1), free.argmax(axis=1))
            at[some] = self._moved(y, t[:, None], m[:, None])
            wide[some] = np.where(joined, 0, w)
            got = np.flatnonzero(more > 0)
            at[got, slot[got]], wide[got, slot[got]] = t[got], more[got]
            low[some], high[some] = self._moved(low[some], t, m), self._moved(high[some], t, m)
        made = np.c_[low, high, at, wide]
        out = np.empty_like(made)
        out[order] = made
        return out

    @staticmethod
    def _places(summary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in use and their widths, in order."""
        at, wide = np.split(summary[2:], 2)
        used = np.flatnonzero(wide > 0)
        used = used[np.argsort(at[used], kind="stable")]
        return at[used], wide[used]

    @staticmethod
    def _moved(p: np.ndarray, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.where(np.abs(t - p) <= m, t, p + np.where(t > p, m, -m))

    def after(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        low, high = summary[:2]
        at, wide = self._places(summary)
        begins = at - low + np.cumsum(wide) - wide
        into = float(state[0]) + self.bound - begins
        fallen = np.flatnonzero((into >= 0) & (into <= wide))
        if len(fallen):
            return at[fallen[:1]]
        return np.array([min(high, max(low, low + state[0] + self.bound - np.clip(into, 0, wide).sum()))])

    def summary(self, x: np.ndarray) -> np.ndarray:
        first = np.zeros(len(x), bool)
        starts, lengths, _ = lanes(first)
        made = self._composed(x, starts, lengths)
        out = made[0]
        for one in made[1:]:
            out = self.merged(out, one)
        return out

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = (self.after(a[i : i + 1], b)[0] for i in (0, 1))
        # The starts that b joins, where a's image has them, and those that a has joined already.
        at, wide = self._places(b)
        begins = at - b[0] + np.cumsum(wide) - wide - self.bound
        widths: dict[float, float] = {}
        for y, s, w in zip(at.tolist(), begins.tolist(), wide.tolist(), strict=True):
            if (own := min(a[1], s + w) - max(a[0], s)) > 0:
                widths[y] = widths.get(y, 0.0) + own
        for y, w in zip(*self._places(a), strict=True):
            to = float(self.after(np.array([y]), b)[0])
            widths[to] = widths.get(to, 0.0) + float(w)
        return np.array([low, high, *widths, *widths.values()])

    def run(self, x: np.ndarray, first: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, lengths, fresh = lanes(first)
        begin = np.zeros(len(starts))
        if len(starts) and not first[0]:
            begin[0] = state[0]
        onward = np.flatnonzero(~fresh[1:]) + 1  # lanes that go on from the one before
        if len(onward):
            made = self._composed(x, starts[onward - 1], lengths[onward - 1])
            for lane, one in zip(onward.tolist(), made, strict=True):
                begin[lane] = self.after(begin[lane - 1 : lane], one)[0]
        to, most = self._inputs(x)
        order = np.argsort(-lengths, kind="stable")
        p, out = begin[order], np.empty(len(x))
        for some, rows in _steps(starts[order], lengths[order]):
            p[some] = self._moved(p[some], to[rows], most[rows])
            out[rows] = p[some]
        if not self.before:
            return out[:, None], out[-1:].copy()
        earlier = np.r_[state[:1], out[:-1]]
        earlier[first] = np.nan
        return np.c_[out, earlier], out[-1:].copy()


class Smoothed:
    """An exponential average with recursive weights: a missing value decays the weight of the past and has no output. Input: value.

    State: average (NaN: none yet), rows since it was made. Summary: rows up to the first value, that
    value, the average's factor and shift over the later ones, rows after the last, whether there is a value.
    """

    def __init__(self, alpha: float):
        self.alpha = float(alpha)

    def start(self) -> np.ndarray:
        return np.array([np.nan, 0.0])

    def _weights(self, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shares of the past and of a new value after so many missing ones."""
        past = (1 - self.alpha) ** (gap + 1)
        return past / (past + self.alpha), self.alpha / (past + self.alpha)

    def _met(self, state: np.ndarray, gap: float, value: float) -> float:
        if np.isnan(state[0]):
            return value
        a, b = self._weights(state[1] + gap)
        return float(a * state[0] + b * value)

    @staticmethod
    def _composed(a: np.ndarray, b: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(-lengths, kind="stable")
        factor, shift = np.ones(len(starts)), np.zeros(len(starts))
        for some, rows in _steps(starts[order], lengths[order]):
            factor[some] *= a[rows]
            shift[some] = a[rows] * shift[some] + b[rows]
        out = np.empty((len(starts), 2))
        out[order] = np.c_[factor, shift]
        return out

    def summary(self, x: np.ndarray) -> np.ndarray:
        seen = np.flatnonzero(~np.isnan(x[:, 0]))
        if not len(seen):
            return np.array([len(x), 0.0, 1.0, 0.0, 0.0, 0.0])
        a, b = self._weights(np.diff(seen) - 1.0)
        factor, shift = 1.0, 0.0
        starts, lengths, _ = lanes(np.zeros(len(a), bool)) if len(a) else (np.zeros(0, int),) * 3
        for f, s in self._composed(a, b * x[seen[1:], 0], starts, lengths):
            factor, shift = f * factor, f * shift + s
        return np.array([seen[0], x[seen[0], 0], factor, shift, len(x) - 1 - seen[-1], 1.0])

    def after(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        lead, value, factor, shift, tail, has = summary
        if not has:
            return np.array([state[0], state[1] + lead])
        return np.array([factor * self._met(state, lead, value) + shift, tail])

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not a[5]:
            return np.array([a[0] + b[0], *b[1:]])
        if not b[5]:
            return np.array([*a[:4], a[4] + b[0], 1.0])
        past, new = self._weights(a[4] + b[0])
        return np.array([a[0], a[1], b[2] * past * a[2], b[2] * (past * a[3] + new * b[1]) + b[3], b[4], 1.0])

    def run(self, x: np.ndarray, first: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.full(len(x), np.nan)
        seen = np.flatnonzero(~np.isnan(x[:, 0]))
        series = np.cumsum(first)
        begins = np.flatnonzero(first)
        last_start = begins[-1] if len(begins) else -1
        if len(seen):
            values = x[seen, 0]
            fresh = np.r_[True, series[seen[1:]] != series[seen[:-1]]]
            a, b = self._weights(np.r_[0.0, np.diff(seen) - 1.0])
            a, b = np.where(fresh, 0.0, a), np.where(fresh, values, b * values)
            goes_on = series[seen[0]] == 0  # the series of the state
            if goes_on:
                b[0] = self._met(state, float(seen[0]), float(values[0]))
            starts, lengths, new = lanes(fresh)
            begin = np.zeros(len(starts))
            onward = np.flatnonzero(~new[1:]) + 1
            for lane, (factor, shift) in zip(onward.tolist(), self._composed(a, b, starts[onward - 1], lengths[onward - 1]), strict=True):
                begin[lane] = factor * begin[lane - 1] + shift
            order = np.argsort(-lengths, kind="stable")
            y, made = begin[order], np.empty(len(seen))
            for some, rows in _steps(starts[order], lengths[order]):
                y[some] = a[rows] * y[some] + b[rows]
                made[rows] = y[some]
            out[seen] = made
        if len(seen) and seen[-1] >= last_start:
            return out[:, None], np.array([out[seen[-1]], len(x) - 1.0 - seen[-1]])
        if last_start >= 0:
            return out[:, None], np.array([np.nan, float(len(x) - last_start)])
        return out[:, None], np.array([state[0], state[1] + len(x)])


class Compounded:
    """The compounded curve of period returns and its drawdown from the highest value so far, which leaves out the start. Input: return.

    A missing return leaves the curve as it was and has no drawdown. State: curve, peak. Summary: the
    product of a stretch of rows and the highest and lowest product on the way, which give the peak from any state.
    """

    def __init__(self, start: float = 1.0):
        self.first = float(start)

    def start(self) -> np.ndarray:
        return np.array([self.first, -np.inf])

    @staticmethod
    def _peak(equity: float | np.ndarray, peak: float | np.ndarray, high: float | np.ndarray, low: float | np.ndarray):
        known = np.isfinite(high)
        at = np.where(known, equity * np.where(known, np.where(equity >= 0, high, low), 0.0), -np.inf)
        return np.maximum(peak, at)

    @staticmethod
    def _composed(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(-lengths, kind="stable")
        made, high, low = np.ones(len(starts)), np.full(len(starts), -np.inf), np.full(len(starts), np.inf)
        for some, rows in _steps(starts[order], lengths[order]):
            r = x[rows, 0]
            known = ~np.isnan(r)
            made[some] *= np.where(known, 1 + r, 1.0)
            high[some] = np.where(known, np.maximum(high[some], made[some]), high[some])
            low[some] = np.where(known, np.minimum(low[some], made[some]), low[some])
        out = np.empty((len(starts), 3))
        out[order] = np.c_[made, high, low]
        return out

    def summary(self, x: np.ndarray) -> np.ndarray:
        starts, lengths, _ = lanes(np.zeros(len(x), bool))
        made = self._composed(x, starts, lengths)
        out = made[0]
        for one in made[1:]:
            out = self.merged(out, one)
        return out

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not np.isfinite(b[1]):
            return np.array([a[0] * b[0], a[1], a[2]])
        ends = sorted((a[0] * b[1], a[0] * b[2]))
        return np.array([a[0] * b[0], max(a[1], ends[1]), min(a[2], ends[0])])

    def after(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return np.array([state[0] * summary[0], float(self._peak(state[0], state[1], summary[1], summary[2]))])

    def run(self, x: np.ndarray, first: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, lengths, fresh = lanes(first)
        begin = np.tile(self.start(), (len(starts), 1))
        if not first[0]:
            begin[0] = state
        onward = np.flatnonzero(~fresh[1:]) + 1
        for lane, one in zip(onward.tolist(), self._composed(x, starts[onward - 1], lengths[onward - 1]), strict=True):
            begin[lane] = self.after(begin[lane - 1], one)
        order = np.argsort(-lengths, kind="stable")
        equity, peak = begin[order].T.copy()
        out, last = np.empty((len(x), 2)), np.empty((len(x), 1))
        for some, rows in _steps(starts[order], lengths[order]):
            r = x[rows, 0]
            known = ~np.isnan(r)
            equity[some] *= np.where(known, 1 + r, 1.0)
            peak[some] = np.where(known, np.maximum(peak[some], equity[some]), peak[some])
            whole = known & (peak[some] != 0)
            out[rows, 0], last[rows, 0] = equity[some], peak[some]
            out[rows, 1] = np.where(whole, equity[some] / np.where(whole, peak[some], 1.0) - 1.0, np.nan)
        return out, np.array([out[-1, 0], last[-1, 0]])


def compounded(df: DataFrame, value: str, *, keys: Sequence[str], date: str, equity: str = "equity", drawdown: str = "drawdown", start: float = 1.0) -> DataFrame:
    """df with the compounded curve of ``value`` and its drawdown, series of any length."""
    return segmented_scan(df, keys=keys, order=[date], inputs=[value], outs=[equity, drawdown], recurrence=Compounded(start))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, several as one."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """A number for each row, equal for rows that are equal in ``columns``."""
    codes = np.zeros(table.num_rows, np.int64)
    for c in columns:
        own = pc.dictionary_encode(table.column(c), null_encoding="encode").combine_chunks()
        own = (own if isinstance(own, pa.DictionaryArray) else own.chunk(0)).indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return codes


def _values(table: pa.Table, columns: Sequence[str], i: int) -> tuple:
    return tuple(table.column(c)[i].as_py() for c in columns)


def _series(table: pa.Table, keys: Sequence[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """(which rows begin a key, the last row's key); ``before`` is the key of the row before, None if there is none."""
    codes = _codes(table, keys)
    first = np.r_[_values(table, keys, 0) != before, codes[1:] != codes[:-1]]
    return first, _values(table, keys, table.num_rows - 1)


def _whole(tables: Iterator[pa.Table], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The tables cut so that one with several keys has all the rows that follow of each; a key that alone fills a table goes on in the next."""
    rest = None
    for table in tables:
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        codes = _codes(table, keys)
        cut = int(np.flatnonzero(codes != codes[-1]).max(initial=-1)) + 1
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        if rest.num_rows >= ROWS:
            yield rest
            rest = None
    if rest is not None:
        yield rest


def _parts(table: pa.Table, within: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray | slice]]:
    """(values of ``within``, the rows that have them, in order)."""
    if not within:
        yield (), slice(None)
        return
    codes = _codes(table, within)
    at = np.argsort(codes, kind="stable")
    for rows in np.split(at, np.flatnonzero(np.diff(codes[at])) + 1):
        yield _values(table, within, int(rows[0])), rows


def _numbers(table: pa.Table, inputs: Sequence[str]) -> np.ndarray:
    return np.stack([pc.fill_null(table.column(c).cast(pa.float64()), float("nan")).to_numpy() for c in inputs], axis=1)


def segmented_scan(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    outs: Sequence[str],
    recurrence: Recurrence,
    listed: Callable[[DataFrame], DataFrame] | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """df with the recurrence's outputs ``outs`` (NULL for NaN) over ``inputs`` in order, anew for each value of keys.

    Rows that share keys and order follow by inputs and then by their other columns. The rows are
    settled once in their ranges; to the driver comes a summary per task, of a size that the
    recurrence fixes.

    For series that overlap, ``listed`` makes of the settled rows a row for each series that they belong to,
    told apart by ``within``; it may make inputs too. It must leave rows in their tasks and in order, as a
    broadcast join does. So rows are shuffled and stored once, however many series they are in; to the
    driver comes a summary for each series that a task ends with.
    """
    spark = df.sparkSession
    df = df.drop(*outs)
    inner = [c for c in inputs if c in df.columns]
    ties = [f.name for f in df.schema.fields if f.name not in (*keys, *order, *inputs) and isinstance(f.dataType, T.AtomicType)]
    by = [*keys, *order]
    rows = settle(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, *inner, *ties))
    if listed:
        rows = listed(rows)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening, key, tail, single = None, None, None, True
        made: dict[tuple, np.ndarray] = {}

        def add(table: pa.Table) -> None:
            x = _numbers(table, inputs)
            for series, at in _parts(table, within):
                own = recurrence.summary(x[at])
                made[series] = recurrence.merged(made[series], own) if series in made else own

        for table in _tables(batches):
            first, after = _series(table, keys, key)
            if opening is None:
                opening, first[0] = _values(table, keys, 0), False
            key = after
            begins = np.flatnonzero(first)
            if len(begins):
                single = False
                made.clear()
            elif tail is not None:
                add(tail)
            tail = table.slice(int(begins[-1]) if len(begins) else 0)
        if tail is not None:
            add(tail)
            state = pickle.dumps((TaskContext.get().partitionId(), opening, key, single, {k: v.tolist() for k, v in made.items()}))
            yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], ["summary"])

    found = sorted((pickle.loads(r.summary) for r in rows.select(*keys, *within, *inputs).mapInArrow(summaries, "summary binary").collect()), key=lambda r: r[0])
    # The states that each task's first series are in when the task begins, for those that go on from the task before.
    begin: dict[int, dict[tuple, list[float]]] = {}
    key, states = None, {}
    for part, opening, closing, single, made in found:
        into = states if opening == key else {}
        begin[part] = {k: v.tolist() for k, v in into.items()}
        states = {k: recurrence.after(into[k] if single and k in into else recurrence.start(), np.array(v)) for k, v in made.items()}
        states = {**into, **states} if single else states
        key = closing

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, {k: np.array(v) for k, v in begin.get(TaskContext.get().partitionId(), {}).items()}
        for i, table in enumerate(_whole(_tables(batches), keys)):
            first, key = _series(table, keys, key)
            if not i:
                first[0] = not states
            if first[0]:
                states = {}
            later = np.flatnonzero(first[1:]) + 1
            n, x = int(later[0]) if len(later) else table.num_rows, _numbers(table, inputs)
            made = np.empty((len(x), len(outs)))
            for series, at in _parts(table.slice(0, n), within):  # of the first key, which may go on from the table before
                fresh = np.zeros(len(x[:n][at]), bool)
                fresh[0] = series not in states
                made[:n][at], states[series] = recurrence.run(x[:n][at], fresh, states.get(series, recurrence.start()))
            if n < len(x):  # the series of the other keys are whole
                codes, keyed = _codes(table.slice(n), within), np.cumsum(first[n:])
                at = np.lexsort((codes, keyed))
                fresh = np.r_[True, (np.diff(codes[at]) != 0) | (np.diff(keyed[at]) != 0)]
                made[n + at], _ = recurrence.run(x[n + at], fresh, recurrence.start())
                states = {}
            columns = [pa.array(made[:, j], from_pandas=True) for j in range(len(outs))]
            yield from pa.table([*table.columns, *columns], [*table.column_names, *outs]).to_batches()

    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in outs]])
    return rows.mapInArrow(apply, schema)
