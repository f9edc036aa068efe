"""Settings of the resolution pipeline."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Prune:
    margin: float = 0.7
    floor: float = 0.0
    max_rank: int = 8


@dataclass(frozen=True)
class Decision:
    mode: str = "thr"  # thr or ef
    thr: float = 0.5
    pmin: float = 0.05
    ceil: float = 0.99


@dataclass(frozen=True)
class Cascade:
    low: float = 0.40
    high: float = 0.85
    weight: float = 0.65
    full_weight: float = 0.60


@dataclass(frozen=True)
class ErConfig:
    """``k`` best index records per pool record and channel, pruning, decision, rescoring and strategy."""

    k: int = 7
    threshold: float = 0.1
    max_df: float = 0.3
    variant: str = "g2"
    fold_dictionaries: bool = True
    strategy: str = "auto"  # auto, relational, block or lsh
    prune: Prune = field(default_factory=Prune)
    decision: Decision = field(default_factory=Decision)
    cascade: Cascade = field(default_factory=Cascade)
    rerank: str = "none"  # none, cascade or full

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> ErConfig:
        """The defaults with ``ER_K``, ``ER_BACKEND``, ``ER_THR`` and ``ER_CE_MODE`` of the environment applied."""
        env = dict(os.environ) if env is None else env
        out = ErConfig()
        if env.get("ER_K"):
            out = replace(out, k=int(env["ER_K"]))
        if env.get("ER_BACKEND"):
            out = replace(out, strategy={"cpu": "relational", "gpu": "block"}.get(env["ER_BACKEND"], env["ER_BACKEND"]))
        if env.get("ER_THR"):
            out = replace(out, decision=Decision("thr", float(env["ER_THR"])))
        if env.get("ER_CE_MODE"):
            out = replace(out, rerank=env["ER_CE_MODE"])
        return out
