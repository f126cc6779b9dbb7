"""Parameters; the defaults are the engine's own, every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchConfig:
    alpha: float = 0.55  # weight of the vector channel
    beta: float = 0.45  # weight of the text channel
    recall_k: int = 100
    top_k: int = 3
    very_high: float = 0.9
    high: float = 0.75
    gap_exact: float = 0.2
    gap_narrow: float = 0.08
    cosine_floor: float = 0.6
    verb_boost: float = 0.25
    coverage_boost: float = 0.12
    compat_terms: bool = True


@dataclass(frozen=True)
class JourneyConfig:
    burst_ms: int = 1500
    gap_ms: int = 45_000
    soft_gap_ms: int = 90_000
    max_events: int = 12
    max_queries: int = 8
    satisfied_above: float = 0.75
    weak_from: float = 0.4
    holdout: float = 0.2
