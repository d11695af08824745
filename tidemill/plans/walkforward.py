"""Walk-forward plans as relations: fold windows, their dates in a calendar, and joins by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.series import over
from tidemill.schema import FOLD_DATES, PLAN_COLUMNS, require_columns
from tidemill.shared import settle


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def window_end(start: Column, months: int | Column) -> Column:
    """The last day of a window of calendar months that begins with the month of ``start``."""
    if isinstance(months, int) and months <= 0:
        raise ValueError(f"a window has at least 1 month, not {months}")
    return F.date_sub(F.add_months(month_start(start), months), 1)


def calendar_positions(dates: DataFrame) -> DataFrame:
    """(date, pos): the distinct dates, numbered from 0. One row per date of a calendar."""
    days = dates.select("date").where(F.col("date").isNotNull()).distinct()
    return days.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def shared_calendar(panel: DataFrame) -> DataFrame:
    """The dates on which every ticker has a row.

    Each ticker's dates are a bitmap over the numbered dates, so rows are folded into bits before they are
    shuffled, repeated rows change nothing, and the bitmaps of all tickers are reduced by AND.
    """
    days = calendar_positions(panel).withColumn("_at", F.col("pos") + 1)
    days = days.select("date", F.bitmap_bucket_number("_at").alias("_bucket"), F.bitmap_bit_position("_at").alias("_bit"))
    own = panel.select("ticker", "date").join(days, "date").groupBy("ticker", "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    tickers = panel.select("ticker").distinct().agg(F.count(F.lit(1)).alias("_all"))
    every = own.groupBy("_bucket").agg(F.bitmap_and_agg("_bits").alias("_bits"), F.count(F.lit(1)).alias("_n"))
    every = every.join(F.broadcast(tickers), F.col("_n") == F.col("_all")).select("_bucket", "_bits")  # one row
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return days.join(every, "_bucket").where(F.floor(byte / F.pow(F.lit(2), F.col("_bit") % 8)).cast("int") % 2 == 1).select("date")


def align(panel: DataFrame) -> DataFrame:
    """The rows of the shared calendar."""
    return panel.join(shared_calendar(panel), "date", "left_semi").select(*panel.columns)


def as_of(asks: DataFrame, dates: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """asks (keys, t, ...) with the nearest dates (keys, date) at or after t and at or before it, NULL if there are none.

    A merge by ranges: distinct times of both are range-partitioned together, each part finds the
    neighbours that it holds, and the nearest dates of the parts around it, two for each part and key, are
    carried over its borders. So no key and no lack of keys brings all times into one task.
    """
    rest = [c for c in asks.columns if c not in (*keys, "t")]
    known = dates.where("date IS NOT NULL").select(*keys, F.col("date").alias("t"), "date").distinct()
    times = asks.where("t IS NOT NULL").select(*keys, "t").distinct()
    both = known.unionByName(times, allowMissingColumns=True)
    n_parts = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = settle(both.repartitionByRange(n_parts, *keys, "t").withColumn("_part", F.spark_partition_id()))
    inside = over([*keys, "_part"], "t")
    here = both.withColumns(
        {
            "_after": F.min("date").over(inside.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
            "_before": F.max("date").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    ends = both.groupBy(*keys, "_part").agg(F.min("date").alias("_least"), F.max("date").alias("_greatest"))
    beside = over(keys, "_part")  # a row per part of a key
    borders = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_k__part"),
        F.min("_least").over(beside.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
        F.max("_greatest").over(beside.rowsBetween(Window.unboundedPreceding, -1)).alias("_last"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_part")]
    found = here.where("date IS NULL").join(borders, same).select(
        *[F.col(k).alias(f"_f_{k}") for k in (*keys, "t")],
        F.coalesce("_after", "_next").alias("first_on_or_after"),
        F.coalesce("_before", "_last").alias("last_on_or_before"),
    )
    back = [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in (*keys, "t")]
    return asks.join(found, back, "left").select(*keys, "t", *rest, "first_on_or_after", "last_on_or_before")


def fold_windows(spans: DataFrame, *, train_months: int, test_months: int, step_months: int, start_date: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, k, *_cal): the calendar windows of the folds that begin before the last date.

    spans: (keys, max_date). Fold 0 trains from start_date itself, later folds from the first
    of a month; months are counted from the month of the training start.
    """
    for name, n in (("train_months", train_months), ("test_months", test_months), ("step_months", step_months)):
        if n < 1:
            raise ValueError(f"{name} is at least 1, not {n}")
    start = F.to_date(F.lit(str(start_date)[:10]))
    last = F.to_date("max_date")
    steps = F.greatest(F.floor(F.months_between(last, month_start(start)) / step_months).cast("int"), F.lit(0))
    out = spans.where(last >= start).select(*keys, "max_date", F.explode(F.sequence(F.lit(0), steps)).alias("k"))
    out = out.withColumn("train_start_cal", F.when(F.col("k") == 0, start).otherwise(F.add_months(month_start(start), F.col("k") * step_months)))
    first = month_start(F.col("train_start_cal"))
    out = out.withColumns(
        {
            "train_end_cal": window_end(F.col("train_start_cal"), train_months),
            "test_start_cal": F.add_months(first, train_months),
            "test_end_cal": F.date_sub(F.add_months(first, train_months + test_months), 1),
        }
    )
    return out.where((F.col("train_start_cal") <= last) & (F.col("test_start_cal") <= last)).drop("max_date")


def walkforward_plan(dates: DataFrame, *, train_months: int, test_months: int, step_months: int = 1, start_date: str = "2018-01-01", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold_id, FOLD_DATES) for each calendar of ``dates`` (keys, date).

    Window ends are the last dates that the calendar has up to them, and inclusive. Folds
    with an empty window are left out and take no fold_id. Null dates are ignored.
    """
    days = dates.select(*keys, F.to_timestamp(F.date_trunc("day", "date")).alias("date")).where(F.col("date").isNotNull()).distinct()
    spans = days.groupBy(*keys).agg(F.max("date").alias("max_date")).where(F.col("max_date").isNotNull())
    folds = fold_windows(spans, train_months=train_months, test_months=test_months, step_months=step_months, start_date=start_date, keys=keys)
    bounds = [F.struct(F.lit(c).alias("bound"), F.to_timestamp(F.col(f"{c}_cal")).alias("t")) for c in FOLD_DATES]
    asks = folds.select(*keys, "k", F.explode(F.array(*bounds)).alias("_b")).select(*keys, "k", "_b.bound", "_b.t")
    near = as_of(asks, days, keys=keys)
    at = lambda c: F.max(F.when(F.col("bound") == c, F.col("first_on_or_after" if c.endswith("start") else "last_on_or_before"))).alias(c)
    found = near.groupBy(*keys, "k").agg(*map(at, FOLD_DATES))
    valid = found.where("train_start IS NOT NULL AND train_end IS NOT NULL AND test_start IS NOT NULL AND test_end IS NOT NULL AND train_start <= train_end AND test_start <= test_end")
    return valid.withColumn("fold_id", F.row_number().over(over(keys, "k")) - 1).select(*keys, *PLAN_COLUMNS)


def normalized_plan(plan: DataFrame) -> DataFrame:
    """The plan with its dates as timestamps."""
    require_columns(plan, PLAN_COLUMNS, "the split plan")
    return plan.withColumns({c: F.to_timestamp(F.col(c)) for c in FOLD_DATES})


def fold_rows(rows: DataFrame, plan: DataFrame, *, start: str, end: str, date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """rows × plan where the date lies in [start, end] of the fold (columns of the plan).

    A range join as an equi-join: each fold is listed under every month that it touches, so
    each row meets the folds of its month only, and Spark picks broadcast or shuffle by size.
    """
    plan = plan.where(F.col(start) <= F.col(end))
    months = F.sequence(F.trunc(F.col(start), "MM"), F.trunc(F.col(end), "MM"), F.expr("interval 1 month"))
    listed = plan.withColumn("_month", F.explode(months))
    joined = rows.withColumn("_month", F.trunc(F.col(date), "MM")).join(listed, ["_month", *keys])
    return joined.where((F.col(date) >= F.col(start)) & (F.col(date) <= F.col(end))).drop("_month")


def elementary_intervals(folds: DataFrame, *, start: str, end: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """((by, interval, at, to), (by, fold_id, first, last)): time cut at every border of [start, end] of the folds, and the intervals of each fold.

    Intervals do not overlap, so a row lies in one of them however many folds cover it. Folds that
    end before they start are left out.
    """
    folds = folds.where(F.col(start) <= F.col(end)).withColumns({"_start": F.to_timestamp(F.col(start)), "_stop": F.timestamp_micros(F.unix_micros(F.to_timestamp(F.col(end))) + 1)})
    cuts = folds.select(*by, F.col("_start").alias("at")).union(folds.select(*by, "_stop")).distinct()
    w = over(by, "at")  # two rows for each fold at most
    cuts = cuts.withColumns({"interval": F.row_number().over(w), "_next": F.lead("at").over(w)}).where("_next IS NOT NULL")
    intervals = cuts.select(*by, "interval", "at", F.timestamp_micros(F.unix_micros("_next") - 1).alias("to"))
    firsts = cuts.select(*by, F.col("at").alias("_start"), F.col("interval").alias("first"))
    lasts = cuts.select(*by, F.col("_next").alias("_stop"), F.col("interval").alias("last"))
    spans = folds.select(*by, "fold_id", "_start", "_stop").join(firsts, [*by, "_start"]).join(lasts, [*by, "_stop"])
    return intervals, spans.select(*by, "fold_id", "first", "last")


def label_cutoffs(plan: DataFrame, calendar: DataFrame, horizon: int | str) -> DataFrame:
    """The plan with ``label_cutoff``: the date ``horizon`` positions before train_end, NULL if there is none.

    Labels of training rows up to there are known by train_end. ``on_calendar`` says whether
    train_end is a date of the calendar. horizon: a number, or the column of the plan that has it.
    """
    at = calendar.select(F.col("date").alias("train_end"), "pos")
    cut = calendar.select(F.col("date").alias("label_cutoff"), F.col("pos").alias("_cut"))
    found = plan.join(at, "train_end", "left").withColumn("on_calendar", F.col("pos").isNotNull())
    return found.join(cut, F.col("pos") - (F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)) == F.col("_cut"), "left").select(*plan.columns, "label_cutoff", "on_calendar")
