"""Helpers shared by the document operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemill.shared import passing_path, settle

__all__ = ["flat", "give_back", "lower_ascii", "partitions", "release", "settle", "steps", "stored", "table"]

#: Bytes of text that one numpy step works on. A longer single text is a step of its own.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Run ``df`` once and read it back as a Parquet table of the shared folder.

    For wider rows than ``settle`` is meant for: the table is compressed and read by column. It
    goes when the driver ends, as a result that is not read yet may need it.
    """
    spark = df.sparkSession
    path = passing_path(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of finished steps, which no table needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and each row's first byte with the end appended.

    Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text is at most ``most`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, end - first)
            first = end


def lower_ascii() -> bytes:
    """A translation table that maps A-Z to a-z and leaves other bytes as they are."""
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def give_back() -> None:
    """Returns memory that numpy and Arrow have freed to the system, so that a reused worker does not hold its highest use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)
