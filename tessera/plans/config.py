"""Settings that change results, from a mapping such as the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import ClassVar


@dataclass(frozen=True)
class Config:
    embed_dim: int = 256
    hybrid: bool = True
    sparse: str = "tf"
    retrieval: str = "scan"
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    reranker: str = "lexical"
    rerank_pool: int = 30
    trust: str = "heuristic"
    trust_weight: float = 0.15
    coverage_weight: float = 0.05
    usage_weight: float = 0.10
    enricher: str = "heuristic"
    index_prune: bool = True
    cache_ttl_seconds: float = 60.0
    cache_size: int = 512
    rrf_k: int = 2
    source: str = "file"
    embedder: str = "hash"
    embed_base_url: str = "http://localhost:11434/v1"
    embed_api_key: str = ""
    embed_model: str = "nomic-embed-text"
    llm_provider: str = "anthropic"
    llm_base_url: str = ""
    llm_api_key: str = ""
    llm_model: str = "claude-haiku-4-5"
    extract_tools: bool = False
    extract_concurrency: int = 8
    extract_timeout: float = 20.0
    extract_allow_private: bool = False
    extract_auth_token: str = ""
    index_concurrency: int = 8
    proxy_enabled: bool = True
    proxy_timeout: float = 30.0
    usage_path: str = ""
    http_addr: str = ":8080"

    KNOWN: ClassVar = (
        ("sparse", ("tf", "bm25")), ("retrieval", ("scan", "index")), ("reranker", ("lexical", "llm", "none")), ("trust", ("heuristic", "llm", "none")), ("enricher", ("heuristic", "llm", "none")),
        ("embedder", ("hash", "openai")), ("llm_provider", ("anthropic", "openai")),
    )

    def __post_init__(self):
        for name, known in self.KNOWN:
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name}: {getattr(self, name)}")
        if self.embedder == "openai" and not self.embed_model:
            raise ValueError("embed_model is needed for this embedder")
        if "llm" in (self.reranker, self.trust, self.enricher) and self.llm_provider == "anthropic" and not self.llm_api_key:
            raise ValueError("llm_api_key is needed for this provider")

    @classmethod
    def read(cls, env: Mapping[str, str]) -> Config:
        """Values that cannot be read leave the default."""
        given = {}
        for f in fields(cls):
            raw, kind = env.get(f.name.upper()), type(f.default)
            if raw in (None, ""):
                continue
            try:
                given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw.strip())
            except ValueError:
                continue
        return cls(**given)

    @property
    def sources(self) -> list[str]:
        return split_list(self.source)


def split_list(raw: str) -> list[str]:
    return [x.strip() for x in raw.split(",") if x.strip()]
