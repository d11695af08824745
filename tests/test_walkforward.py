"""As-of dates and elementary intervals against sorted lists."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.plans.walkforward import as_of, elementary_intervals, fold_rows

BEGIN = datetime(2020, 1, 1)


def day(n):
    return None if n is None else BEGIN + timedelta(hours=int(n))


@pytest.mark.parametrize("keyed", [False, True])
def test_as_of_over_many_parts(spark, keyed):
    """A third of the asks at one time, asks before, between and after all dates, gaps wider than a part, null keys and times."""
    r = np.random.default_rng(8)
    keys = ["k"] if keyed else []
    names = ["a", "b", None] if keyed else ["a"]
    at = {k: sorted(set(r.integers(100, 3000, 400).tolist()) | {5000}) for k in names}
    asks = [(k, int(t), i) for i, (k, t) in enumerate((k, t) for k in [*names, "none"][: len(names) + keyed] for t in [*r.integers(0, 6000, 600), *[2500] * 300])] + [("a", None, -1)]
    asked = spark.createDataFrame([(k, day(t), i) for k, t, i in asks], "k string, t timestamp, i int").repartition(7)
    dates = spark.createDataFrame([(k, day(t)) for k in names for t in at[k]] * 2 + [("a", None)], "k string, date timestamp").repartition(3)
    got = as_of(asked if keyed else asked.drop("k"), dates if keyed else dates.drop("k"), keys=keys)
    found = {x.i: (x.first_on_or_after, x.last_on_or_before) for x in got.collect()}
    assert len(found) == len(asks) == got.count()
    for k, t, i in asks:
        own = at.get(k, [])
        after = min((d for d in own if t is not None and d >= t), default=None)
        before = max((d for d in own if t is not None and d <= t), default=None)
        assert found[i] == (day(after), day(before))


def test_as_of_without_keys_has_no_window_over_all_times(spark):
    """The one window in a single task is that over the parts' borders."""
    times = spark.range(20_000).select(F.timestamp_seconds(F.col("id") * 7).alias("t"))
    got = as_of(times, times.select(F.col("t").alias("date")))
    plan = got._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan") :]
    single = [x for x in physical.splitlines() if "SinglePartition" in x]
    assert len(single) <= 1 and "HashAggregate" in physical
    assert got.where("t <> first_on_or_after OR t <> last_on_or_before").count() == 0


def test_intervals_share_the_rows_of_folds(spark):
    at = [(0, 30), (0, 10), (5, 30), (31, 40), (60, 60), (70, 65)]
    folds = spark.createDataFrame([(i, day(24 * a), day(24 * z)) for i, (a, z) in enumerate(at)], "fold_id int, a timestamp, z timestamp").withColumn("h", F.lit(1))
    intervals, spans = elementary_intervals(folds, start="a", end="z", by=["h"])
    rows = spark.createDataFrame([(day(24 * d + x), 1) for d in range(80) for x in (0, 5)], "date timestamp, h int")
    placed = fold_rows(rows, intervals, start="at", end="to", keys=["h"]).groupBy("interval").count().collect()
    counts = {r.interval: r["count"] for r in placed}
    got = {r.fold_id: sum(counts.get(i, 0) for i in range(r["first"], r["last"] + 1)) for r in spans.collect()}
    assert got == {i: sum(day(24 * a) <= day(24 * d + x) <= day(24 * z) for d in range(80) for x in (0, 5)) for i, (a, z) in enumerate(at) if a <= z}
    assert fold_rows(rows, intervals, start="at", end="to", keys=["h"]).groupBy("date").count().where("count > 1").count() == 0
