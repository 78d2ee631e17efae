"""Settings that are parameters of queries."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 700
    chunk_overlap: int = 120
    top_k_dense: int = 30
    top_k_sparse: int = 30
    top_k_fused: int = 20
    top_k_rerank: int = 6
    rerank_threshold: float = 0.0
    neighbor_window: int = 1
    neighbor_max_total: int = 12
    neighbor_same_section: bool = True
    max_rounds: int = 3
    min_supporting: int = 2
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    lexical_coverage: float = 0.72

    @property
    def working_set(self) -> int:
        return max(self.top_k_rerank, self.neighbor_max_total)


DEFAULTS = Settings()
