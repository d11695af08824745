"""Segmented scans against loops over rows."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import scan
from tidemill.operators.backtest import rate_limited
from tidemill.operators.signals import smooth_scores


def follow(targets, most, bound=1.0, p=0.0):
    out = []
    for t in targets:
        t = 0.0 if t is None or t != t else t
        p = min(bound, max(-bound, p + min(most, max(-most, t - p))))
        out.append(p)
    return out


def ema(x, span=3):
    s = pd.Series(x, dtype=float)
    return s.ewm(span=span, adjust=False, ignore_na=False).mean().where(s.notna()).to_numpy()


numbers = st.one_of(st.none(), st.floats(-1.5, 1.5).map(lambda v: round(v, 3)), st.sampled_from([-1.0, -0.75, -0.25, 0.0, 0.5, 1.0]))


@settings(max_examples=300, deadline=None)
@given(st.lists(numbers, min_size=2, max_size=60), st.sampled_from([0.05, 0.25, 0.3, 1.0]), st.floats(-1, 1), st.data())
def test_composed_steps_lead_where_the_rows_lead(targets, most, begin, data):
    x = np.array([[np.nan if t is None else t, most] for t in targets])
    r = scan.RateLimited(1.0, most)
    cut = data.draw(st.integers(1, len(x) - 1))
    want = follow(targets, most, p=begin)[-1]
    whole, halves = r.summary(x), r.merged(r.summary(x[:cut]), r.summary(x[cut:]))
    for made in (whole, halves):
        assert r.after(np.array([begin]), made)[0] == pytest.approx(want, abs=1e-12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-9, 9)), min_size=2, max_size=60), st.data())
def test_smoothing_of_parts_and_of_several_series(values, data):
    x = np.array([[np.nan if v is None else v] for v in values])
    r = scan.Smoothed(0.5)
    cuts = sorted({0, *data.draw(st.lists(st.integers(1, len(x) - 1), max_size=3))})
    state = r.start()
    made = None
    for a, z in zip(cuts, [*cuts[1:], len(x)]):
        state = r.after(state, r.summary(x[a:z]))
        made = r.summary(x[a:z]) if made is None else r.merged(made, r.summary(x[a:z]))
    np.testing.assert_allclose(r.after(r.start(), made), state, rtol=1e-9, atol=1e-9)
    _, last = r.run(x, np.arange(len(x)) == 0, r.start())
    np.testing.assert_allclose(last, state, rtol=1e-9, atol=1e-9)
    first = np.isin(np.arange(len(x)), cuts)
    out, _ = r.run(x, first, r.start())
    want = np.concatenate([ema(x[a:z, 0]) for a, z in zip(cuts, [*cuts[1:], len(x)])])
    np.testing.assert_allclose(out[:, 0], want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("lane, rows", [(1, 1), (3, 7), (256, 1 << 16)])
def test_series_of_all_lengths(spark, monkeypatch, lane, rows):
    """Series over several tasks, within one, and of one row; a null key, ties, missing values."""
    monkeypatch.setattr(scan, "LANE", lane)
    monkeypatch.setattr(scan, "ROWS", rows)
    r = np.random.default_rng(5)
    data = [(k, i // 2, None if r.random() < 0.2 else float(round(r.normal(), 2)), i) for k, n in (("a", 40), (None, 9), ("long", 700), ("z", 1), ("zz", 333)) for i in range(n)]
    df = spark.createDataFrame(data, "ticker string, date int, score double, i int").repartition(5)
    got = rate_limited(df, target="score", out="pos", keys=["ticker"], order=["date"], K=1.0, step_frac=0.25)
    parts = got.where("ticker = 'long'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 1
    both = smooth_scores(got, smoothing="ema_3").toPandas()
    assert len(both) == len(data)
    for k, g in both.groupby("ticker", dropna=False):
        own = sorted((x for x in data if x[0] == (k if isinstance(k, str) else None)), key=lambda x: (x[1], x[2] is not None, x[2] or 0.0, x[3]))
        g = g.assign(none=g["score"].notna()).sort_values(["date", "none", "score", "i"])
        np.testing.assert_allclose(g["pos"], follow([x[2] for x in own], 0.25), atol=1e-12)
        np.testing.assert_allclose(g["score_smoothed"], ema([x[2] for x in own]), rtol=1e-9, atol=1e-12)


def test_no_keys_no_rows_and_limits_by_column(spark):
    df = spark.createDataFrame([(i, math.sin(i), 0.1 if i % 2 else 0.4) for i in range(500)], "t int, x double, share double")
    got = rate_limited(df, target="x", out="p", keys=[], order=["t"], K=2.0, step_frac=0.1).orderBy("t").toPandas()
    np.testing.assert_allclose(got["p"], follow(got["x"], 0.2, 2.0), atol=1e-12)
    got = rate_limited(df, target="x", out="p", keys=["share"], order=["t"], K=1.0, step_frac="share").toPandas()
    for share, g in got.groupby("share"):
        g = g.sort_values("t")
        np.testing.assert_allclose(g["p"], follow(g["x"], share), atol=1e-12)
    assert rate_limited(df.where("false"), target="x", out="p", keys=[], order=["t"], K=2.0, step_frac=0.1).count() == 0


returns = st.one_of(st.none(), st.floats(-0.5, 0.5), st.sampled_from([-1.0, -1.5, 0.0]))


@settings(max_examples=300, deadline=None)
@given(st.lists(returns, min_size=2, max_size=50), st.data())
def test_curves_and_drawdowns_of_parts(values, data):
    """Curves that touch and cross zero as well."""
    x = np.array([[np.nan if v is None else v] for v in values])
    r = scan.Compounded(2.0)
    cuts = sorted({0, *data.draw(st.lists(st.integers(1, len(x) - 1), max_size=3))})
    out, last = r.run(x, np.arange(len(x)) == 0, r.start())
    equity, peak = 2.0, -math.inf
    for v, (e, d) in zip(values, out):
        equity *= 1 + (v or 0.0)
        peak = peak if v is None else max(peak, equity)
        assert e == pytest.approx(equity, abs=1e-12)
        assert np.isnan(d) if v is None or peak == 0 else d == pytest.approx(equity / peak - 1, abs=1e-9)
    state, made = r.start(), None
    for a, z in zip(cuts, [*cuts[1:], len(x)]):
        own = r.summary(x[a:z])
        state, made = r.after(state, own), own if made is None else r.merged(made, own)
    for found in (state, r.after(r.start(), made)):
        np.testing.assert_allclose(found, last, rtol=1e-9, atol=1e-12)


def test_one_curve_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scan, "LANE", 7)
    df = spark.range(5000, numPartitions=3).selectExpr("id AS t", "IF(id % 11 = 0, NULL, sin(id * 1.3) / 20) AS r", "id % 2 AS k")
    got = scan.compounded(df, "r", keys=[], date="t").withColumn("part", F.spark_partition_id()).orderBy("t").toPandas()
    assert got["part"].nunique() > 1
    curve = (1 + got["r"].fillna(0)).cumprod()
    np.testing.assert_allclose(got["equity"], curve, rtol=1e-12)
    known = curve.where(got["r"].notna())
    np.testing.assert_allclose(got["drawdown"], known / known.cummax() - 1, atol=1e-12)
