"""All tunables, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of the pipeline; sizes in words unless said otherwise."""

    chunk_size: int = 230
    chunk_overlap: int = 80
    min_size: int = 60
    embed_dim: int = 384
    embed_max_tokens: int = 512
    top_k: int = 5
    min_score: float = 0.20
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    dense_candidates: int = 3
    rerank: bool = True
    lexical_only_floor: float = 0.30
    rescue_min_score: float = 3.0
    rescue_ratio: float = 1.4
    max_sentences: int = 3
    grounding: bool = True
    memory_messages: int = 10
    schema_version: str = "1"

    def __post_init__(self) -> None:
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")
