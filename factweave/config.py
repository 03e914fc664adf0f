"""Settings of the engine, passed explicitly."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    floor: float = 0.78  # least similarity of a candidate pair
    rule_floor: float = 0.88  # least similarity at which a rule may decide
    tolerance: float = 0.01  # relative difference of agreeing values
    top_k: int = 5
    budget: int = 60  # adjudications a document
    pages_per_chunk: int = 10
    facts_per_chunk: int = 25
    max_pages: int | None = None
    fuzzy: float = 0.88
    coverage: float = 0.8
    rule_confidence: float = 0.95
    default_confidence: float = 0.5
    head_pages: int = 3
    head_chars: int = 6000
    requests_per_minute: int = 10
    max_retries: int = 5
    backoff_cap_s: float = 60.0
    broadcast_bytes: int = 64 << 20  # vectors beyond this are joined block by block
