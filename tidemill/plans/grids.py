"""Grids of experiments and their names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product


@dataclass(frozen=True)
class ModelSpec:
    model_name: str
    model_params: Mapping[str, float] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return "__".join([self.model_name, *(f"{k}_{v:g}" for k, v in sorted(self.model_params.items()))])


@dataclass(frozen=True)
class StrategySpec:
    horizon: int
    k: int
    normalization: str
    smoothing: str

    @property
    def name(self) -> str:
        return f"h{self.horizon}__k{self.k}__norm_{self.normalization}__smooth_{self.smoothing}"


def model_grid(
    models: Sequence[str] = ("linear", "ridge", "lasso", "elasticnet"),
    *,
    ridge_alphas: Sequence[float] = (0.1, 1.0, 10.0),
    lasso_alphas: Sequence[float] = (0.0001, 0.001, 0.01),
    elasticnet_alphas: Sequence[float] = (0.0001, 0.001),
    elasticnet_l1_ratios: Sequence[float] = (0.25, 0.5, 0.75),
) -> list[ModelSpec]:
    of = {
        "linear": [{}],
        "ridge": [{"alpha": float(a)} for a in ridge_alphas],
        "lasso": [{"alpha": float(a)} for a in lasso_alphas],
        "elasticnet": [{"alpha": float(a), "l1_ratio": float(r)} for a, r in product(elasticnet_alphas, elasticnet_l1_ratios)],
    }
    return [ModelSpec(m, p) for m in models for p in of[m]]


def strategy_grid(horizons: Sequence[int] = (1, 3, 5), ks: Sequence[int] = (2, 3, 4), normalizations: Sequence[str] = ("none", "zscore", "rank_to_minus1_plus1"), smoothings: Sequence[str] = ("none", "ema_3")) -> list[StrategySpec]:
    return [StrategySpec(*x) for x in product(horizons, ks, normalizations, smoothings)]


def sweep_grid(ns: Sequence[int] = (10, 20, 40), steps: Sequence[float] = (0.25, 0.5)) -> list[tuple[int, float]]:
    return list(product(ns, steps))
