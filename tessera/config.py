"""Settings: given values go before environment variables, and those before defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    store_path: str = "store"
    collection: str = "default"
    embedding_model: str = "bge-m3"
    chunk_size: int = 1000
    chunk_overlap: int = 400
    top_k: int = 4
    rerank_top_k: int | None = None
    expand_window: int = 2
    score_kind: str = "cosine_distance"
    confidence: float = 0.6
    coverage: float = 0.7
    contribution: float = 0.08

    def __post_init__(self) -> None:
        if self.top_k < 1 or (self.rerank_top_k is not None and not 1 <= self.rerank_top_k <= self.top_k):
            raise ValueError("top_k must be positive and rerank_top_k within it")
        if not 0 <= self.chunk_overlap < self.chunk_size or self.expand_window < 0:
            raise ValueError("the overlap must be under the chunk size, and the window not negative")


def load(prefix: str = "TESSERA_", **given) -> Config:
    """A Config of given values, PREFIX_NAME variables and defaults."""
    values = {}
    for f in fields(Config):
        text = os.environ.get(prefix + f.name.upper())
        if f.name in given:
            values[f.name] = given[f.name]
        elif text is not None:
            kind = type(f.default) if f.default is not None else int
            values[f.name] = kind(text)
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise TypeError(f"unknown settings: {sorted(unknown)}")
    return Config(**values)
