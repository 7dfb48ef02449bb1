"""What the settings name, put together: clients of other machines, and the stages that use them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .. import remote
from ..clients import ChatClient, EmbeddingsClient, MessagesClient, ToolServer, sender
from ..protocols import Chat, Embedder
from .config import Config
from .index import Steps


@dataclass(frozen=True)
class Clients:
    """``chat(system, user)``, ``embed(texts)`` and ``tools``, which lists and calls tools; None where the settings need none."""

    chat: Chat | None = None
    embed: Embedder | None = None
    tools: ToolServer | None = None


def clients_for(config: Config, send=None) -> Clients:
    """Clients that connect, or speak through ``send`` where it is given."""
    wire = lambda public=False: send or sender(public=public)
    chat = None
    if "llm" in (config.enricher, config.trust, config.reranker):
        kind = MessagesClient if config.llm_provider == "anthropic" else ChatClient
        chat = kind(config.llm_api_key, config.llm_model, send=wire(), **({"base": config.llm_base_url} if config.llm_base_url else {}))
    embed = EmbeddingsClient(config.embed_api_key, config.embed_model, config.embed_base_url, send=wire()) if config.embedder == "openai" else None
    tools = None
    if config.extract_tools or config.proxy_enabled:
        tools = ToolServer(remote.headers_for({"token": config.extract_auth_token}, "", ""), config.extract_timeout, wire(public=not config.extract_allow_private))
    return Clients(chat, embed, tools)


def steps_for(config: Config, clients: Clients) -> Steps:
    """The stages of the indexing pass that the settings ask for beyond the heuristics."""
    extract = enrich = trust = embed = None
    if config.extract_tools and clients.tools:
        extract = lambda rows: remote.extract_tools(rows, clients.tools.list_tools, config.extract_concurrency, config.extract_timeout)
    if config.enricher == "llm" and clients.chat:
        enrich = lambda rows: remote.model_cards(rows, clients.chat, config.index_concurrency)
    if config.trust == "llm" and clients.chat:
        trust = lambda rows: remote.model_trust(rows, clients.chat, config.index_concurrency)
    if config.embedder == "openai" and clients.embed:

        def embed(texts: DataFrame) -> DataFrame:
            return remote.embed_texts(texts, "point_id", "text", clients.embed)

    return Steps(extract, enrich, trust, embed)
