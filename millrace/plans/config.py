"""Settings of the retrieval pipeline, from the environment or a ``.env`` file."""

from __future__ import annotations

import dataclasses
import os
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class Settings:
    """Defaults of all tunable values; names are read from the environment whatever their case."""

    embedding_model: str = "text-embedding-3-small"
    llm_model: str = "gpt-4o-mini"
    reranker_model: str = ""
    embedding_dimension: int = 384
    embedding_batch_size: int = 100
    request_timeout: int = 30
    max_retries: int = 3
    dense_top_k: int = 50
    bm25_top_k: int = 50
    rrf_constant: int = 60
    reranker_top_k: int = 30
    rerank_batch_size: int = 32
    final_context_k: int = 6
    similarity_threshold: float = 0.5
    chunk_size: int = 500
    chunk_overlap: int = 50
    min_chunk_size: int = 100
    max_chunk_size: int = 1000
    llm_temperature: float = 0.3
    llm_max_tokens: int = 2048
    cache_embedding_ttl: int = 604800
    cache_retrieval_ttl: int = 3600
    cache_context_ttl: int = 1800
    cache_llm_response_ttl: int = 3600
    slow_operation_ms: float = 1000.0
    index_dir: str = "data/index"
    cache_dir: str = "data/cache"
    logs_dir: str = "logs"
    log_level: str = "INFO"

    def ensure_directories(self) -> None:
        for d in (self.index_dir, self.cache_dir, self.logs_dir):
            Path(d).mkdir(parents=True, exist_ok=True)


def load_settings(env: dict[str, str] | None = None, dotenv: str | None = ".env") -> Settings:
    """Settings with overrides: defaults, then the ``.env`` file, then the environment. Bad numbers raise."""
    given: dict[str, str] = {}
    if dotenv and os.path.exists(dotenv):
        for line in Path(dotenv).read_text().splitlines():
            name, eq, value = line.partition("=")
            if eq and not name.lstrip().startswith("#"):
                given[name.strip().lower()] = value.strip().strip("'\"")
    given |= {k.lower(): v for k, v in (os.environ if env is None else env).items()}
    kinds = {"int": int, "float": float, "str": str}
    return Settings(**{f.name: kinds[str(f.type)](given[f.name]) for f in dataclasses.fields(Settings) if f.name in given})
