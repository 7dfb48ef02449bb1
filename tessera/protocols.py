"""The places where parts can be exchanged, by the form of what is handed in."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class Chat(Protocol):
    """A language model: an answer to a task and a question."""

    def __call__(self, system: str, user: str) -> str: ...


class Embedder(Protocol):
    """Vectors of a batch of texts, each with its index, in any order."""

    def __call__(self, texts: list[str]) -> list[tuple[int, list[float]]]: ...


class Fitter(Protocol):
    """Statistics (n, avgdl) of counts (doc, term, tf)."""

    def __call__(self, counts: DataFrame) -> DataFrame: ...


class Encoder(Protocol):
    """key, term, weight of counts (key, term, tf)."""

    def __call__(self, counts: DataFrame, key: str) -> DataFrame: ...


class Stage(Protocol):
    """Extractors, enrichers and scorers: a catalogue in, a catalogue with the same columns out."""

    def __call__(self, catalog: DataFrame) -> DataFrame: ...


class Reranker(Protocol):
    """Hits (qid, mcp_id, pos, score, ...) with new ``pos`` and ``score``."""

    def __call__(self, hits: DataFrame) -> DataFrame: ...


class Send(Protocol):
    """One request to another machine: status, headers and body of its answer."""

    def __call__(self, method: str, url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, dict, bytes]: ...
