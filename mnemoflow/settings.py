"""Settings with their defaults and bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass


def clamp_setting(value: object, low: float, high: float, fallback: float) -> float:
    """A number within its bounds; blank and None count as 0, what isn't a finite number gives the fallback."""
    try:
        number = float(str(value).strip() or 0) if value is not None else 0.0
    except ValueError:
        return fallback
    return max(low, min(high, number)) if math.isfinite(number) else fallback


@dataclass(frozen=True)
class RecallSettings:
    """Out-of-range values are brought within bounds when the object is made."""

    strip_tags: str = ""
    model: str = ""
    dimensions: int | None = None
    batch_size: int = 8
    similarity_threshold: float = 50
    top_k: int = 10
    keep_floors: int = 50
    rerank_enabled: bool = False
    rerank_format: str = "jina"
    rerank_model: str = ""
    recall_threshold: float = 30
    rerank_candidates: int = 50
    rerank_threshold: float = 0.35

    def __post_init__(self) -> None:
        keep = clamp_setting(self.keep_floors, 0, float("inf"), 50)
        bounded = {
            "batch_size": int(clamp_setting(self.batch_size, 1, 16, 8)),
            "top_k": int(clamp_setting(self.top_k, 10, 20, 10)),
            "keep_floors": 0 if keep == 0 else max(30, min(80, math.floor(clamp_setting(self.keep_floors, 30, 80, 50) / 2 + 0.5) * 2)),
            "similarity_threshold": clamp_setting(self.similarity_threshold, 50, 100, 50),
            "recall_threshold": clamp_setting(self.recall_threshold, 30, 100, 30),
            "rerank_candidates": int(clamp_setting(self.rerank_candidates, 20, 100, 50)),
            "rerank_threshold": clamp_setting(self.rerank_threshold, 0, 1, 0.35),
        }
        for name, value in bounded.items():
            object.__setattr__(self, name, value)

    @property
    def threshold(self) -> float:
        """The least cosine of a candidate."""
        return (self.recall_threshold if self.rerank_enabled else self.similarity_threshold) / 100

    @property
    def candidate_limit(self) -> int:
        """How many candidates are selected; with reranking on but no model to do it, they all stay."""
        return self.rerank_candidates if self.rerank_enabled else self.top_k
