"""The folder that driver and executors share, files in it, and tables that are kept for a while."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def _until_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, or that its checkpoints go to.

    Where there is none, a session on one machine gets a temporary folder; on a cluster that is
    an error, as executors could not read it.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        found = tempfile.mkdtemp(prefix="tidemill-")
        _until_exit(spark, found)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def passing_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _until_exit(spark, path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Run ``df`` once and read it back from a Parquet table in the shared folder, whose size the planner knows.

    For small tables that several plans join: Spark broadcasts them if their size allows it.
    """
    path = passing_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: list[list[DataFrame]] = []


def keep(df: DataFrame) -> DataFrame:
    """df cached for the jobs that read it: under ``freeing`` until its result goes, else until the caller unpersists it."""
    df = df.persist()
    if _kept:
        _kept[-1].append(df)
    return df


def freeing(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query``, whose kept tables leave the cache when the DataFrame that it returns is dropped."""

    @wraps(query)
    def run(*args, **options) -> DataFrame:
        _kept.append([])
        try:
            out = query(*args, **options)
        finally:
            cached = _kept.pop()
        if cached:
            weakref.finalize(out, lambda: [df.unpersist() for df in cached]).atexit = False
        return out

    return run
