"""Results as files: Parquet for tables, CSV, JSON and Markdown for reports."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.schema import FOLD_DATES, PLAN_COLUMNS, require_columns
from tidemill.shared import passing_path
from tidemill.sources.files import write_named


def write_table(df: DataFrame, path: str, *, by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Parquet, with a folder per value of ``by`` (for example fold_id)."""
    out = df.write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)
    return path


def _create(spark: SparkSession, path: str):
    """A stream into a new file of any store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)  # other programs may change the file, which a checksum beside it would make unreadable
    try:
        return fs.create(where, True)
    finally:
        fs.setWriteChecksum(True)


def write_csv(df: DataFrame, path: str, *, order: Sequence[str] = ()) -> str:
    """One CSV file with a header, for results of report size: rows stream to the driver a partition at a time."""
    rows = df.orderBy(*order) if order else df
    out = _create(df.sparkSession, path)
    try:
        out.write(bytearray(pd.DataFrame(columns=rows.columns).to_csv(index=False).encode()))
        some: list[tuple] = []
        for r in rows.toLocalIterator():
            some.append(tuple(r))
            if len(some) == 10_000:
                out.write(bytearray(pd.DataFrame(some).to_csv(index=False, header=False).encode()))
                some = []
        if some:
            out.write(bytearray(pd.DataFrame(some).to_csv(index=False, header=False).encode()))
    finally:
        out.close()
    return path


def write_csv_folder(df: DataFrame, path: str, *, order: Sequence[str] = ()) -> str:
    """A folder of CSV files with headers that the executors write, for results that grow with the data; ordered from file to file."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("escape", '"').option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return path


def read_results(spark: SparkSession, path: str, kinds: Mapping[str, str]) -> DataFrame:
    """Columns (``kinds``: type by name) of a result that ``write_csv`` or ``write_csv_folder`` wrote; empty fields are NULL.

    Whole numbers may be written with a point, as columns with missing values are, and dates without a time.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    require_columns(rows, list(kinds), path)
    whole = ("tinyint", "smallint", "int", "bigint")
    return rows.select(*[(F.col(c).cast("decimal(38,1)") if t in whole else F.col(c)).cast(t).alias(c) for c, t in kinds.items()])


def read_table(spark: SparkSession, path: str, only: Column | None = None) -> DataFrame:
    """A table of ``write_table``; a condition on the columns of its folders leaves the other folders unread."""
    rows = spark.read.parquet(path)
    return rows if only is None else rows.where(only)


def write_price_files(panel: DataFrame, directory: str) -> list[str]:
    """A CSV file for each ticker, named after it and in the order of its dates, written and named by the executors; a failed run leaves none.

    Files of other tickers in the directory stay.
    """
    out = panel.withColumnRenamed("date", "Date")
    first = [c for c in ("Date", "Open", "High", "Low", "Close", "Volume") if c in out.columns]
    names = [*first, *[c for c in out.columns if c not in (*first, "ticker")]]
    line = F.to_csv(F.struct(*names), {"timestampFormat": "yyyy-MM-dd HH:mm:ss"})
    file = F.concat(F.replace(F.coalesce(F.col("ticker").cast("string"), F.lit("null")), F.lit("/"), F.lit("%2F")), F.lit(".csv"))
    rows = out.repartition("ticker").sortWithinPartitions("ticker", "Date").select(file.alias("file"), line.alias("line"))
    made = write_named(rows, directory, note=passing_path(panel.sparkSession, "files"), header=pd.DataFrame(columns=names).to_csv(index=False).strip())
    return [f"{directory.rstrip('/')}/{n}" for n in made]


def write_price_csv(prices: pd.DataFrame, path: str) -> str:
    """Date, Open, High, Low, Close, Volume first, then what else there is."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    out = prices.rename(columns={"date": "Date"})
    first = [c for c in ("Date", "Open", "High", "Low", "Close", "Volume") if c in out.columns]
    out[[*first, *[c for c in out.columns if c not in first]]].to_csv(path, index=False)
    return path


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan from a CSV file, with or without source_file."""
    plan = spark.read.option("header", True).csv(path)
    require_columns(plan, PLAN_COLUMNS, path)
    return plan.withColumns({"fold_id": plan["fold_id"].cast("int"), **{c: plan[c].cast("timestamp") for c in FOLD_DATES}})


def write_plan(plan: DataFrame, path: str) -> str:
    """A plan as a CSV file with ISO dates. A plan has some rows per month and source."""
    keys = [c for c in ("source_file",) if c in plan.columns]
    return write_csv(plan.withColumns({c: plan[c].cast("date").cast("string") for c in FOLD_DATES}), path, order=[*keys, "fold_id"])


def write_json(path: str, payload: Mapping[str, Any]) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(dict(payload), f, indent=2, default=str)
    return path


def markdown_table(rows: pd.DataFrame, columns: Sequence[str]) -> str:
    """Six significant digits for floats, blanks for what is missing."""

    def cell(v: Any) -> str:
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows[list(columns)].itertuples(index=False))])
