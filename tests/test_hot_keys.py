"""One date with most rows, one value that a third of them share: whole results, and no task that sorts the date."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame
from tidemill.functions.series import ranked, value_bin
from tidemill.operators import metrics
from tidemill.operators.portfolio import top_bottom_weights
from tidemill.operators.signals import normalize_scores
from tidemill.plans.walkforward import shared_calendar


@pytest.fixture(scope="module")
def hot(spark):
    """30,000 rows on one date, few on others; a third of the scores are 0, some are missing."""
    r = np.random.default_rng(2)
    n = 30_000
    days = np.where(np.arange(n) < n - 40, "hot", np.array([f"d{i % 7}" for i in range(n)]))
    score = np.where(r.random(n) < 0.33, 0.0, r.normal(0, 1, n).round(3))
    table = pd.DataFrame({"date": days, "ticker": [f"t{i:05d}" for i in range(n)], "score": np.where(r.random(n) < 0.05, np.nan, score), "forward_ret": r.normal(0, 0.01, n).round(6)})
    return frame(spark, table).repartition(6).cache(), table


def physical(df):
    df.count()
    return df._jdf.queryExecution().toString().split("Physical Plan")[1]


def test_ranks(spark, hot):
    df, table = hot
    got = ranked(df, "score", keys=["date"], out="rank", count="n").toPandas().sort_values(["date", "ticker"]).reset_index(drop=True)
    table = table.sort_values(["date", "ticker"]).reset_index(drop=True)
    pd.testing.assert_series_equal(got["rank"].astype(float), table.groupby("date")["score"].rank(), check_names=False)
    known = got["score"].notna()
    assert (got.loc[known, "n"] == table.groupby("date")["score"].transform("count")[known]).all()
    for method in ("rank_to_minus1_plus1", "zscore"):
        made = normalize_scores(df, normalization=method).toPandas()
        assert made["score_normalized"].notna().sum() == known.sum() and abs(made["score_normalized"].sum()) < 1e-6
    ic = metrics.daily_ic(df).toPandas().set_index("date")
    both = table.dropna()
    for date, g in both.groupby("date"):
        assert ic.loc[date, "ic_spearman"] == pytest.approx(g["score"].rank().corr(g["forward_ret"].rank()), abs=1e-9)


def test_ranks_of_null_keys_and_signs(spark):
    values = [-1e300, -2.0, -1.0, -1e-300, -0.0, 0.0, 1e-300, 0.5, 1.0, 1.0, 3.0, None]
    df = spark.createDataFrame([(k, v) for k in ("a", None) for v in values], "k string, v double")
    got = ranked(df, "v", keys=["k"], out="rank", count="n")
    assert got.count() == 24 and [r.v for r in got.where("k IS NULL AND v IS NOT NULL").orderBy("rank", "v").collect()] == sorted(v for v in values if v is not None)
    assert got.where("v = 1.0").select("rank").distinct().first().rank == 9.5 and got.where("v = 0").select("rank").distinct().first().rank == 5.5
    bins = [r.b for r in df.where("v IS NOT NULL AND k = 'a'").orderBy("v").select(value_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins)


def test_top_and_bottom_of_a_hot_date(spark, hot):
    df, table = hot
    got = top_bottom_weights(df, k=5)
    assert "WindowGroupLimit" in physical(got)
    made = got.where("weight <> 0").toPandas()
    assert got.count() == len(table)
    for date, g in table.dropna().groupby("date"):
        k = min(5, len(g) // 2)
        longs = set(g.sort_values(["score", "ticker"], ascending=[False, True])["ticker"][:k])
        shorts = set(g.sort_values(["score", "ticker"])["ticker"][:k])
        own = made[made["date"] == date]
        assert set(own[own["weight"] > 0]["ticker"]) == longs - shorts and set(own[own["weight"] < 0]["ticker"]) == shorts
    twice = top_bottom_weights(df.where("date <> 'hot'").union(df.where("date <> 'hot'")), k=3).groupBy("date").agg(F.sum("weight").alias("w"), F.count_if(F.col("weight") < 0).alias("n")).collect()
    assert all(abs(r.w) < 1e-9 and r.n == 3 for r in twice)


def test_calendar_of_many_dates_and_repeated_rows(spark):
    """More dates than one bitmap has bits; a ticker without any row in some of them."""
    days = spark.range(70_000).select(F.timestamp_seconds(F.col("id") * 60).alias("date"), "id")
    rows = days.where("id % 3 <> 1").withColumn("ticker", F.lit("a")).union(days.where("id % 5 <> 2 AND id < 65000").withColumn("ticker", F.lit("b")))
    got = shared_calendar(rows.union(rows.where("id % 2 = 0")))
    want = days.where("id % 3 <> 1 AND id % 5 <> 2 AND id < 65000").select("date")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert shared_calendar(rows.where("id < 32000")).count() == want.where("date < timestamp_seconds(32000 * 60)").count()
    assert shared_calendar(rows.where("false")).count() == 0
