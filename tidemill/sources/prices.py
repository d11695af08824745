"""Price tables from CSV files, and dates from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.returns import first_of_each
from tidemill.plans.walkforward import align
from tidemill.schema import PRICE_COLUMNS, number, ordered, require_columns
from tidemill.shared import settle, stored


def wall_time(text: str | Column) -> Column:
    """A timestamp from date text; an offset at the end is dropped and the wall time kept. NULL if it is no date."""
    c = F.trim((F.col(text) if isinstance(text, str) else text).cast("string"))
    return F.try_to_timestamp(F.regexp_replace(c, r"(?<=\d)\s*(?:Z|UTC|[+-]\d{2}:?\d{2})$", ""))


def list_files(spark: SparkSession, directory: str, *, recursive: bool = False, suffix: str = ".csv") -> list[str]:
    """Paths of files in any store that Spark reads, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(f"no directory {directory}")
    found, each = [], fs.listFiles(path, recursive)
    while each.hasNext():
        name = each.next().getPath().toString()
        if name.endswith(suffix):
            found.append(name)
    return sorted(found)


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def select_files(spark: SparkSession, directory: str, *, tickers: Sequence[str] | None = None, recursive: bool = False) -> list[str]:
    """The price files of a directory, or those of the tickers; a ticker without a file is an error."""
    files = list_files(spark, directory, recursive=recursive)
    if not files:
        raise FileNotFoundError(f"no CSV files in {directory}")
    if tickers is None:
        return files
    missing = sorted(set(tickers) - {stem(f) for f in files})
    if missing:
        raise FileNotFoundError(f"no files for tickers {missing} in {directory}")
    return [f for f in files if stem(f) in set(tickers)]


def headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(_file, _names): each file's first line as names. Executors read the files; files without a line have no row."""
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    first = lines.where("_block = 0").groupBy("_file").agg(F.min_by("value", "_at").alias("_line"))
    bare = lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', "")
    return first.select("_file", F.transform(F.split(F.regexp_replace("_line", "^\ufeff", ""), ","), bare).alias("_names"))


def read_csvs(spark: SparkSession, paths: Sequence[str], required_columns: Sequence[str] = ()) -> DataFrame:
    """All rows of the files by column name, as text, with _file and _at (the row's place in its file).

    The driver sees the distinct headers, not the files' own. Under one header the files are scanned by it;
    under several they are scanned once by position, and each header names the rows of its files.
    """
    if not paths:
        raise FileNotFoundError("no files to read")
    found = stored(headers(spark, paths))
    lacks = F.array_except(F.array(*[F.lit(c) for c in required_columns]).cast("array<string>"), "_names")
    if bad := found.where(F.size(lacks) > 0).select("_file", "_names", lacks.alias("_lacks")).first():
        raise ValueError(f"{bad['_file']} lacks columns {bad['_lacks']}; it has {bad['_names']}")
    known = [r["_names"] for r in found.groupBy("_names").count().orderBy("_names").collect()]
    if required_columns and found.count() < len(set(paths)):
        raise ValueError(f"some of {len(paths)} files lack a header; they need columns {list(required_columns)}")
    place = {"_file": F.col("_metadata.file_path"), "_at": F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))}
    if len(known) <= 1:
        return spark.read.option("header", True).csv(list(paths)).withColumns(place)
    wide = ", ".join(f"_c{i} string" for i in range(max(map(len, known))))
    rows = spark.read.schema(wide).option("header", True).option("enforceSchema", True).csv(list(paths)).withColumns(place).join(found, "_file")
    columns = list(dict.fromkeys(c for names in known for c in names))
    at = {c: F.coalesce(*[F.when(F.col("_names") == F.array(*map(F.lit, names)), F.col(f"_c{names.index(c)}")) for names in known if c in names]) for c in columns}
    return rows.select(*[x.alias(c) for c, x in at.items()], "_file", "_at")


def dated(rows: DataFrame, *, date_col: str, keys: Sequence[str] = (), what: str = "the price file") -> DataFrame:
    """rows with ``date``, one for each date and key: the first in the file. An invalid date, or no row, is an error."""
    require_columns(rows, [date_col], what)
    out = rows.withColumn("_date", wall_time(date_col))
    n, bad = out.agg(F.count(F.lit(1)), F.count_if(F.col("_date").isNull())).first()
    if bad:
        raise ValueError(f"{what} has {bad} rows whose {date_col} is no date")
    if not n:
        raise ValueError(f"{what} has no rows")
    out = out.drop(date_col).withColumnRenamed("_date", "date")
    return first_of_each(out, [*keys, "date"], "_at").drop("_at")


def load_price_csv(spark: SparkSession, path: str, *, date_col: str = "Date", required_columns: Sequence[str] = PRICE_COLUMNS) -> DataFrame:
    """(date, prices as doubles, other columns as they are) of one file."""
    rows = read_csvs(spark, [path], required_columns).drop("_file")
    rows = dated(rows, date_col=date_col, what=path)
    return ordered(rows.withColumns({c: number(c) for c in rows.columns if c in (*PRICE_COLUMNS, "Adj_Close", "ret", "log_ret")}), ["date", *required_columns])


def load_price_panel(spark: SparkSession, directory: str, *, date_col: str = "Date", tickers: Sequence[str] | None = None, recursive: bool = False, intersect_dates: bool = True, required_columns: Sequence[str] = PRICE_COLUMNS) -> DataFrame:
    """(date, ticker, prices, others) of a directory with a file per ticker; with intersect_dates, on shared dates only."""
    rows = read_csvs(spark, select_files(spark, directory, tickers=tickers, recursive=recursive), required_columns)
    rows = rows.withColumn("ticker", F.regexp_extract(F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))), r"([^/]+)\.[^./]*$", 1)).drop("_file")
    rows = dated(rows, date_col=date_col, keys=["ticker"], what=directory)
    rows = rows.withColumns({c: number(c) for c in PRICE_COLUMNS if c in rows.columns})
    if intersect_dates:
        rows = align(rows)
        if not rows.take(1):
            raise ValueError("the tickers share no date")
    return ordered(rows, ["date", "ticker", *required_columns])


def load_dates(spark: SparkSession, files: Sequence[str], *, directory: str, date_col: str = "Date") -> DataFrame:
    """(source_file, date) of the files, relative to the directory; rows without a valid date are dropped."""
    root = directory.rstrip("/")
    rows = read_csvs(spark, files)
    require_columns(rows, [date_col], directory)
    name = F.element_at(F.split("_file", F.lit(f"\\Q{root.split(':', 1)[-1].lstrip('/')}/\\E"), 2), -1)
    return rows.select(name.alias("source_file"), wall_time(date_col).alias("date")).where("date IS NOT NULL").distinct()


def bars_from_trades(spark: SparkSession, sf_dir: str, *, ticker: str = "p_type", bar: str = "week") -> DataFrame:
    """Bars of order lines: extended price over quantity, by week (or day, month) and an attribute of the part or of the line itself (l_...)."""
    own = [ticker] if ticker.startswith("l_") else []
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", *own)
    if own:
        lines = lines.withColumn("ticker", F.col(ticker).cast("string"))
    else:
        lines = lines.join(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col(ticker).alias("ticker")), "l_partkey")
    px, q = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity")
    trades = lines.select(F.date_trunc(bar, "l_shipdate").alias("date"), "ticker", F.struct(F.col("l_orderkey"), F.col("l_linenumber"), px.alias("px"), q.alias("q")).alias("t"))
    # Aggregates of a struct order by its fields, so the first and last trade need no sort.
    bars = trades.groupBy("date", "ticker").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("t.px").alias("High"), F.min("t.px").alias("Low"), F.sum("t.q").alias("Volume"))
    return bars.select("date", "ticker", F.col("first.px").alias("Open"), "High", "Low", F.col("last.px").alias("Close"), "Volume")


def panel_from_trades(spark: SparkSession, sf_dir: str, *, ticker: str = "p_type", bar: str = "week") -> DataFrame:
    """The bars of order lines on the dates that all tickers have. The lines are read once: the bars, a row per date and ticker, are settled."""
    return align(settle(bars_from_trades(spark, sf_dir, ticker=ticker, bar=bar)))
