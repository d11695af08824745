"""Run folders, configurations, the run registry and champions."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.series import over
from tidemill.schema import number
from tidemill.sources.sinks import write_json, write_plan

# The columns of the registry, the kinds of runs that can be champions, and the champions' files.
_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()
REGISTRY = T.StructType([
    T.StructField(n, t)
    for n, t in (
        ("timestamp", _S), ("run_name", _S), ("run_type", _S), ("experiment_name", _S), ("model_name", _S), ("parameters", _S), ("horizon", _L), ("k", _L), ("normalization", _S), ("smoothing", _S),
        ("mean_ic", _D), ("mean_spread", _D), ("total_return_net", _D), ("sharpe_net", _D), ("sortino_net", _D), ("max_drawdown_net", _D), ("n_constant_score_days", _L), ("path_to_run_dir", _S),
    )
])
#: Metric by the name of its champion's file.
CHAMPIONS = {"best_by_sharpe.json": "sharpe_net", "best_by_sortino.json": "sortino_net", "best_by_mean_ic.json": "mean_ic"}
ELIGIBLE = ("single_run", "strategy_ablation")


def utc_now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


@dataclass(frozen=True)
class RunPaths:
    output_root: str
    run_dir: str
    plots_dir: str
    champions_dir: str
    registry_path: str
    config_path: str


def init_run_paths(output_root: str, run_name: str) -> RunPaths:
    run = os.path.join(output_root, "runs", str(run_name))
    paths = RunPaths(output_root, run, os.path.join(run, "plots"), os.path.join(output_root, "champions"), os.path.join(output_root, "run_registry.csv"), os.path.join(run, "run_config.json"))
    os.makedirs(paths.plots_dir, exist_ok=True)
    os.makedirs(paths.champions_dir, exist_ok=True)
    return paths


def git_commit(root: str) -> str | None:
    try:
        got = subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, check=False)
    except OSError:
        return None
    return got.stdout.strip() or None if got.returncode == 0 else None


def write_run_config(paths: RunPaths, *, run_name: str, run_type: str, timestamp: str, input_dir: str, repo_root: str, config: Mapping[str, Any]) -> str:
    fixed = {"run_name": run_name, "timestamp": timestamp, "run_type": run_type, "input_dir": str(input_dir), "run_dir": paths.run_dir, "git_commit_hash": git_commit(repo_root)}
    return write_json(paths.config_path, {**fixed, **config})


def save_plan_snapshot(plan: DataFrame, paths: RunPaths) -> str:
    return write_plan(plan, os.path.join(paths.run_dir, "plan.csv"))


def registry_row(**values: Any) -> dict[str, Any]:
    """A row with all columns of REGISTRY; parameters as JSON with sorted keys. Unknown columns are errors."""
    extra = sorted(set(values) - set(REGISTRY.names))
    if extra:
        raise ValueError(f"the registry has no columns {extra}")
    row = {n: values.get(n) for n in REGISTRY.names}
    p = row["parameters"]
    row["parameters"] = "" if p is None else p if isinstance(p, str) else json.dumps(dict(p), sort_keys=True)
    row["experiment_name"] = row["experiment_name"] or ""
    for n in REGISTRY:
        v = row[n.name]
        if v is not None:
            row[n.name] = float(v) if n.dataType == _D else int(v) if n.dataType == _L else str(v)
    return row


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry: CSV files with headers, or no rows if there are none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).option("header", True).option("escape", '"').csv(path)


def append_registry(spark: SparkSession, path: str, rows: Sequence[Mapping[str, Any]] | DataFrame) -> str:
    """Adds rows as further files of the table at ``path``; nothing is read or rewritten.

    A DataFrame's rows are written by the executors; columns that it lacks are NULL, columns that the registry lacks are errors.
    """
    if isinstance(rows, DataFrame):
        if extra := sorted(set(rows.columns) - set(REGISTRY.names)):
            raise ValueError(f"the registry has no columns {extra}")
        new = rows.select(*[(F.col(n.name) if n.name in rows.columns else F.lit(None)).cast(n.dataType).alias(n.name) for n in REGISTRY])
        new.write.mode("append").option("header", True).option("escape", '"').csv(path)
    elif rows:
        new = spark.createDataFrame([tuple(r[n] for n in REGISTRY.names) for r in rows], REGISTRY)
        new.coalesce(1).write.mode("append").option("header", True).option("escape", '"').csv(path)
    return path


def champions(registry: DataFrame, metrics: Sequence[str] = tuple(CHAMPIONS.values())) -> DataFrame:
    """(champion_metric, champion_value, registry columns): of eligible rows the highest of each metric, the latest of equals."""
    rows = registry.where(F.col("run_type").isin(*ELIGIBLE))
    out = None
    for m in metrics:
        value = rows.withColumns({"champion_metric": F.lit(m), "champion_value": number(m)}).where("champion_value IS NOT NULL")
        out = value if out is None else out.unionByName(value)
    w = over(["champion_metric"], F.col("champion_value").desc(), F.try_to_timestamp("timestamp").desc_nulls_last(), "run_name", "experiment_name")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def update_champions(spark: SparkSession, registry_path: str, champions_dir: str) -> list[str]:
    """Writes a file per metric and the current champion (by Sharpe ratio); none if no row is eligible."""
    registry = load_registry(spark, registry_path)
    if not registry.where(F.col("run_type").isin(*ELIGIBLE)).take(1):
        return []
    best = {r["champion_metric"]: r.asDict() for r in champions(registry).collect()}  # a row per metric
    now, written = utc_now(), []
    for name, metric in CHAMPIONS.items():
        row = best.get(metric, {"champion_metric": metric, "champion_value": None, "note": f"no run has a number for {metric} yet"})
        written.append(write_json(os.path.join(champions_dir, name), {**row, "updated_timestamp": now}))
        if metric == "sharpe_net":
            current = {**row, "updated_timestamp": now}
    written.append(write_json(os.path.join(champions_dir, "current_etf_xs_champion.json"), current))
    return written
