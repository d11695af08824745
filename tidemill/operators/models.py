"""Linear models of all folds from one aggregation of moments, merged and solved on the executors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.schema import require_columns

MODELS = ("linear", "ridge", "lasso", "elasticnet")
DEFAULTS: dict[str, dict[str, float]] = {"linear": {}, "ridge": {"alpha": 1.0}, "lasso": {"alpha": 1.0}, "elasticnet": {"alpha": 1.0, "l1_ratio": 0.5}}


def resolve_model_params(name: str, params: Mapping[str, Any] | None = None) -> dict[str, float]:
    """The model's parameters with defaults. Unknown names, unknown parameters and values out of range are errors."""
    model = str(name).strip().lower()
    if model not in MODELS:
        raise ValueError(f"model {name!r} is not one of {list(MODELS)}")
    given = dict(params or {})
    extra = sorted(set(given) - set(DEFAULTS[model]))
    if extra:
        raise ValueError(f"model {model!r} has no parameters {extra}")
    out = dict(DEFAULTS[model])
    for k, v in given.items():
        try:
            out[k] = float(v)
        except (TypeError, ValueError):
            raise ValueError(f"{k} of model {model!r} is a number, not {v!r}") from None
        if not math.isfinite(out[k]):
            raise ValueError(f"{k} of model {model!r} is finite, not {v!r}")
    if "alpha" in out and (out["alpha"] < 0 or model != "ridge" and out["alpha"] == 0):
        raise ValueError(f"alpha of model {model!r} is {'at least' if model == 'ridge' else 'above'} 0")
    if not 0 <= out.get("l1_ratio", 0.5) <= 1:
        raise ValueError("l1_ratio lies between 0 and 1")
    return out


def complete(columns: Sequence[str]) -> Column:
    """All of the columns are known."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def moments(rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ("fold_id",)) -> DataFrame:
    """(keys, n, mean, cov): for each key the count, means and centred second moments (upper triangle by rows) of complete rows: one aggregation."""
    require_columns(rows, [*features, label, *keys], "the training rows")
    d = [F.col(c).cast("double") for c in (*features, label)]
    pairs = [(i, j) for i in range(len(d)) for j in range(i, len(d))]
    return (
        rows.where(complete([*features, label]))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(x) for x in d]).alias("mean"), F.array(*[F.covar_pop(d[i], d[j]) for i, j in pairs]).alias("cov"))
    )


def moments_of_folds(parts: DataFrame, spans: DataFrame, *, by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, by, fold_id, n, parts): the moments of the intervals that each fold covers, of (keys, by, interval, n, mean, cov).

    spans: (by, fold_id, first, last). A key's intervals, at most two for each fold, come into one array, and
    folds take their stretch of it in the same task.
    """
    listed = parts.groupBy(*keys, *by).agg(F.collect_list(F.struct("interval", "n", "mean", "cov")).alias("_all"))
    joined = listed.join(spans, list(by))  # a row for each fold of each key
    inside = F.filter("_all", lambda m: m["interval"].between(F.col("first"), F.col("last")))
    made = joined.select(*keys, *by, "fold_id", F.transform(inside, lambda m: F.struct(m["n"].alias("n"), m["mean"].alias("mean"), m["cov"].alias("cov"))).alias("parts"))
    return made.withColumn("n", F.aggregate("parts", F.lit(0).cast("long"), lambda a, m: a + m["n"])).where("n > 0").select(*keys, *by, "fold_id", "n", "parts")


def merged(n: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and covariance (square) of several parts: centred moments plus those of the parts' means."""
    total = float(n.sum())
    middle = n @ mean / total
    size = mean.shape[1]
    upper = np.triu_indices(size)
    out = np.zeros((size, size))
    out[upper] = n @ cov / total
    away = mean - middle
    spread = (away * n[:, None]).T @ away / total
    return total, middle, np.triu(out) + np.triu(out, 1).T + spread


def _descent(a: np.ndarray, b: np.ndarray, yy: np.ndarray, l1: float, l2: float, w: np.ndarray, sweeps: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """Minimises w'aw/2 - b'w + l1 |w|₁ + l2 |w|²/2 for a batch of models from w on, by coordinate descent.

    A model is done when its duality gap is at most 1e-9 of the label's variance and a sweep moves
    no weight by more than tol of the largest.
    """
    w, open_ = w.copy(), np.arange(len(b))
    for _ in range(sweeps):
        if not len(open_):
            break
        aa, bb, ww = a[open_], b[open_], w[open_]
        before = ww.copy()
        for j in range(ww.shape[1]):
            own = aa[:, j, j]
            r = bb[:, j] - np.einsum("mk,mk->m", aa[:, j], ww) + own * ww[:, j]
            scale = own + l2
            ww[:, j] = np.where(scale > 0, np.sign(r) * np.maximum(np.abs(r) - l1, 0.0) / np.where(scale > 0, scale, 1.0), 0.0)
        w[open_] = ww
        aw = np.einsum("mjk,mk->mj", aa, ww)
        size, moved = np.abs(ww).max(axis=1, initial=0.0), np.abs(ww - before).max(axis=1, initial=0.0)
        squares = np.einsum("mj,mj->m", ww, ww)
        rest = yy[open_] - 2 * np.einsum("mj,mj->m", bb, ww) + np.einsum("mj,mj->m", aw, ww)
        slope = np.abs(bb - aw - l2 * ww).max(axis=1, initial=0.0)
        share = np.where(slope > l1, l1 / np.where(slope > 0, slope, 1.0), 1.0)
        gap = rest * (1 + share**2) / 2 + l1 * np.abs(ww).sum(axis=1) - share * (yy[open_] - np.einsum("mj,mj->m", bb, ww)) + l2 * (1 + share**2) * squares / 2
        open_ = open_[~((gap <= 1e-9 * yy[open_]) & (moved <= tol * np.maximum(1.0, size)))]
    return w


def solve_batch(n: np.ndarray, mean: np.ndarray, cov: np.ndarray, specs: Sequence[tuple[str, Mapping[str, float]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each spec (intercepts, weights) of all models, given counts, means and covariances of features and label.

    Minimises the squared error (ridge: its sum + alpha |w|²; lasso and elastic net: half its mean
    + alpha l1 |w|₁ + alpha (1 - l1)/2 |w|²) by normal equations or coordinate descent. Along falling
    alphas of one l1_ratio each descent begins where the last one ended.
    """
    a, b, yy = cov[:, :-1, :-1], cov[:, :-1, -1], cov[:, -1, -1]
    found: dict[int, np.ndarray] = {}
    paths: dict[float, list[int]] = {}
    for i, (name, params) in enumerate(specs):
        if name == "linear":
            found[i] = np.array([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(a, b, strict=True)]).reshape(b.shape)
        elif name == "ridge":
            own = params["alpha"] * np.eye(b.shape[1])
            found[i] = np.array([np.linalg.lstsq(k * x + own, k * y, rcond=None)[0] for k, x, y in zip(n, a, b, strict=True)]).reshape(b.shape)
        else:
            paths.setdefault(params.get("l1_ratio", 1.0), []).append(i)
    for ratio, own in paths.items():
        w = np.zeros_like(b)
        for i in sorted(own, key=lambda i: -specs[i][1]["alpha"]):
            l1 = specs[i][1]["alpha"] * ratio
            found[i] = w = _descent(a, b, yy, l1, specs[i][1]["alpha"] - l1, w)
    return [(mean[:, -1] - np.einsum("mj,mj->m", mean[:, :-1], found[i]), found[i]) for i in range(len(specs))]


def fit_all(found: DataFrame, specs: Sequence[tuple[str, Mapping[str, float] | None]], features: Sequence[str], *, keys: Sequence[str] = ("fold_id",)) -> DataFrame:
    """(spec_id, keys, _intercept, _weights): every spec (model name, parameters) on every row of moments (keys, parts), in batches where the rows are."""
    named = [(str(name).strip().lower(), resolve_model_params(name, params)) for name, params in specs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(len(keys)).to_pylist()
            models = [merged(np.array([p["n"] for p in some], float), np.array([p["mean"] for p in some]), np.array([p["cov"] for p in some])) for some in parts]
            n, mean, cov = (np.array(x) for x in zip(*models, strict=True))
            for i, (intercept, w) in enumerate(solve_batch(n, mean, cov, named)):
                own = [pa.array([i] * len(n), pa.int32()), *batch.columns[: len(keys)], pa.array(intercept), pa.array(list(w), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(own, ["spec_id", *keys, "_intercept", "_weights"])

    types = [T.StructField("spec_id", T.IntegerType()), *[found.schema[k] for k in keys], T.StructField("_intercept", T.DoubleType()), T.StructField("_weights", T.ArrayType(T.DoubleType()))]
    return found.select(*keys, "parts").mapInArrow(run, T.StructType(types))


def predict(rows: DataFrame, coefs: DataFrame, features: Sequence[str], *, on: Sequence[str] = ("fold_id",), score_col: str = "score", how: str = "inner") -> DataFrame:
    """rows with the model's score: NULL where a feature (``how`` left: or the model) is missing. coefs: a row per model, joined by its keys."""
    joined = rows.drop(score_col).join(coefs, list(on), how)
    score = F.col("_intercept")
    for i, f in enumerate(features):
        score = score + F.col("_weights")[i] * F.col(f).cast("double")
    return joined.withColumn(score_col, F.when(complete(features), score)).drop("_intercept", "_weights")


def fit_model(train: DataFrame, features: Sequence[str], *, label_col: str, model_name: str = "ridge", model_params: Mapping[str, Any] | None = None) -> tuple[float, np.ndarray]:
    """One model over all complete rows."""
    whole = moments(train.withColumn("fold_id", F.lit(0)), features, label_col).select("fold_id", F.array(F.struct("n", "mean", "cov")).alias("parts"))
    row = fit_all(whole, [(model_name, model_params)], features).first()
    if row is None:
        raise ValueError("no training row has all features and the label")
    return row["_intercept"], np.array(row["_weights"])


def fit_ridge_model(train: DataFrame, features: Sequence[str], *, label_col: str, alpha: float = 1.0) -> tuple[float, np.ndarray]:
    """A ridge model over all complete rows."""
    return fit_model(train, features, label_col=label_col, model_name="ridge", model_params={"alpha": alpha})
