"""Parameters with their defaults, which environment variables can change."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    chunk_size: int = 500
    chunk_overlap: int = 100
    top_k_results: int = 5
    embedding_dimensions: int = 1024
    max_chars_for_embedding: int = 6000
    min_similarity: float = 0.5
    embedding_model: str = "bge-m3"
    embedding_url: str = "http://localhost:11434"

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Config:
        """A field is read from the variable of its name in capitals, where there is one."""
        return cls(**{f.name: type(f.default)(env[f.name.upper()]) for f in fields(cls) if f.name.upper() in env})
