"""Knobs of the engine; all defaults are the published ones of the method."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # The published defaults.
    shortlist: dict[str, int] = field(default_factory=lambda: {"STRUCTURED": 30, "SEMANTIC": 55, "REASONING": 80})
    default_shortlist: int = 55
    rrf_k: int = 60
    weight_dense: float = 1.0
    weight_bm25: float = 0.7
    weight_code: float = 0.6
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    relax_below: int = 12
    qualify_batch: int = 8
    escalate: bool = True
    escalate_low: float = 0.35
    escalate_high: float = 0.72
    escalate_share: float = 0.25
    escalate_batch: int = 5
    unknown_penalty: float = 0.06
    min_score: float = 0.35
    fallback: int = 10
    embed_chars: int = 8000
    embed_batch: int = 25
    embed_dimension: int = 768
    # How a connector treats a service that fails or throttles.
    max_concurrency: int = 4
    max_retries: int = 5
    backoff_base: float = 1.8
    cooldown: float = 600.0
    generate_per_minute: int = 15
    embed_per_minute: int = 100
    use_cache: bool = True

    @property
    def max_shortlist(self) -> int:
        return max(*self.shortlist.values(), self.default_shortlist)


#: USD per million tokens (input, output) by model; fixed values of the cost report.
DEFAULT_PRICE = (0.30, 2.50)
EMBEDDING_PRICE = (0.15, 0.0)
LITE_PRICE = (0.10, 0.40)
