"""One immutable settings object; presets for the three generations and overrides from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    min_support: int = 20
    knn_k: int = 15
    knn_feature_k: int = 10
    similarity_power: float = 4.0
    train_ratio: float = 0.8
    cut_day: str | None = None
    w_profit: float = 0.8
    w_capacity: float = 0.3
    w_bandwidth: float = 0.10
    gate_threshold: float = 0.9
    validation_share: float = 0.15
    cat_weight: float = 0.65
    num_weight: float = 0.35
    n_quantiles: int = 500
    full_window_days: int = 7
    pool_prefix: str = "ant"
    pool_side: str = ""            # "", "ant" (keep the prefix) or "nonant" (drop it)
    merge_families: bool = False
    gate: bool = False
    legacy_score: bool = False
    segment_min_rows: int = 3
    seed: int = 42
    sample_seed: int = 20260909
    n_trees: int = 500
    learning_rate: float = 0.05
    max_depth: int = 6
    min_child: int = 5
    row_sample: float = 0.85
    generation: int = 1            # of the score, whatever the pool side
    patience: int = 30             # rounds without gain before the trees end


COLDSTART = Settings(min_support=30, knn_k=10)
FULL_POOL = Settings(min_support=30, n_trees=600)
FIRST_GENERATION = Settings()
ABLATION = Settings(n_trees=700, learning_rate=0.04)
SECOND_GENERATION = Settings(generation=2, pool_side="nonant", merge_families=True, gate=True)


def _cast(current, text: str):
    if isinstance(current, bool):
        return text.strip().lower() in {"1", "true", "yes"}
    if isinstance(current, int):
        return int(text)
    if isinstance(current, float):
        return float(text)
    return text or None


def from_environment(base: Settings = FIRST_GENERATION, env: Mapping[str, str] | None = None,
                     prefix: str = "SETTLERANK_") -> Settings:
    """Override any field of ``base`` with ``<prefix><FIELD>`` from the environment."""
    env = os.environ if env is None else env
    changes = {f.name: _cast(getattr(base, f.name), env[prefix + f.name.upper()])
               for f in fields(base) if prefix + f.name.upper() in env}
    return replace(base, **changes)
