"""HTTP clients of language models, embedding services and tool servers.

Each is made from ``send(method, url, headers, body, timeout)``, which gives
(status, headers, body); tests hand in fakes, ``sender`` is the one that
connects.  Clients are small picklable objects, so executors can hold them.
"""

from __future__ import annotations

import http.client
import json
import socket
import ssl
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlparse

from .protocols import Send
from .remote import guarded, may_redirect, with_retries

#: Longest answers that are read.
CHAT_BYTES, VECTOR_BYTES = 8 << 20, 32 << 20


def _addresses(host: str) -> list[str]:
    return sorted({info[4][0] for info in socket.getaddrinfo(host, None)})


@dataclass(frozen=True)
class sender:  # noqa: N801  used like a function
    """Sends over the network; ``public`` refuses hosts that resolve to blocked addresses, at the time of the connection, and redirects to other hosts."""

    public: bool = False
    most: int = VECTOR_BYTES

    def __call__(self, method: str, url: str, headers: dict, body: bytes = b"", timeout: float = 30.0) -> tuple[int, dict, bytes]:
        first = urlparse(url).hostname or ""
        for hop in range(11):
            parts = urlparse(url)
            host, secure = parts.hostname or "", parts.scheme == "https"
            where = guarded(_addresses)(host) if self.public else host
            plain = socket.create_connection((where, parts.port or (443 if secure else 80)), timeout)
            connection = http.client.HTTPConnection(host, parts.port, timeout=timeout)
            connection.sock = ssl.create_default_context().wrap_socket(plain, server_hostname=host) if secure else plain
            try:
                connection.request(method, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), body or None, headers)
                answer = connection.getresponse()
                got = answer.status, dict(answer.getheaders()), answer.read(self.most)
            finally:
                connection.close()
            if got[0] not in (301, 302, 303, 307, 308) or "Location" not in got[1]:
                return got
            url = urljoin(url, got[1]["Location"])
            if not may_redirect(first, urlparse(url).hostname or "", hop + 1):
                raise PermissionError(f"{first} redirects to another host or too often")
        raise PermissionError(f"{first} redirects too often")


def _asked(send: Send, url: str, headers: dict, body: dict, timeout: float, most: int) -> dict:
    status, _, raw = with_retries(lambda: send("POST", url, {"Content-Type": "application/json"} | headers, json.dumps(body).encode(), timeout))
    if len(raw) > most:
        raise ValueError(f"{url} answered with more than {most} bytes")
    if status != 200:
        raise ConnectionError(f"{url} answered {status}: {raw[:200].decode(errors='replace').strip()}")
    got = json.loads(raw)
    if got.get("error"):
        raise ConnectionError(f"{url}: {got['error'].get('message', '')}")
    return got


@dataclass(frozen=True)
class MessagesClient:
    """A model behind the messages API: text of all text blocks."""

    key: str
    model: str
    base: str = "https://api.anthropic.com"
    max_tokens: int = 1024
    timeout: float = 120.0
    send: Send = field(default_factory=sender)

    def __call__(self, system: str, user: str) -> str:
        body = {"model": self.model, "max_tokens": self.max_tokens, "system": system, "messages": [{"role": "user", "content": user}]}
        got = _asked(self.send, f"{self.base}/v1/messages", {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, body, self.timeout, CHAT_BYTES)
        return "".join(c.get("text", "") for c in got.get("content") or [] if c.get("type") == "text")


@dataclass(frozen=True)
class ChatClient:
    """A model behind the chat completions API; without a key no credentials are sent."""

    key: str
    model: str
    base: str = "http://localhost:11434/v1"
    timeout: float = 120.0
    send: Send = field(default_factory=sender)

    def __call__(self, system: str, user: str) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": user}]
        got = _asked(self.send, f"{self.base}/chat/completions", _bearer(self.key), {"model": self.model, "messages": messages}, self.timeout, CHAT_BYTES)
        if not got.get("choices"):
            raise ConnectionError("the model gave no choices")
        return got["choices"][0]["message"]["content"]


@dataclass(frozen=True)
class EmbeddingsClient:
    """Vectors of a batch of texts, with the index of each, in any order."""

    key: str
    model: str
    base: str = "http://localhost:11434/v1"
    timeout: float = 60.0
    send: Send = field(default_factory=sender)

    def __call__(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        if not texts:
            return []
        got = _asked(self.send, f"{self.base}/embeddings", _bearer(self.key), {"model": self.model, "input": texts}, self.timeout, VECTOR_BYTES)
        return [(d["index"], d["embedding"]) for d in got.get("data") or []]


def _bearer(key: str) -> dict:
    return {"Authorization": f"Bearer {key}"} if key else {}


@dataclass(frozen=True)
class ToolServer:
    """A tool server spoken to by JSON-RPC over streamable HTTP: pages of tools, and calls."""

    headers: dict = field(default_factory=dict)
    timeout: float = 20.0
    send: Send = field(default_factory=lambda: sender(public=True))

    def _rpc(self, kind: str, url: str, method: str, params: dict) -> dict:
        if kind != "streamable":
            raise ConnectionError(f"no client for {kind}")
        headers = {"Content-Type": "application/json", "Accept": "application/json, text/event-stream"} | self.headers
        status, got, raw = self.send("POST", url, headers, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}).encode(), self.timeout)
        if status != 200:
            raise ConnectionError(f"{url} answered {status}")
        text = raw.decode()
        if "event-stream" in {k.lower(): v for k, v in got.items()}.get("content-type", ""):
            text = next((line[5:] for line in text.splitlines() if line.startswith("data:")), "{}")
        answer = json.loads(text)
        if "error" in answer:
            raise ConnectionError(answer["error"].get("message", ""))
        return answer.get("result") or {}

    def list_tools(self, kind: str, url: str, cursor: str) -> tuple[list[dict], str]:
        got = self._rpc(kind, url, "tools/list", {"cursor": cursor} if cursor else {})
        return got.get("tools") or [], got.get("nextCursor") or ""

    def call(self, kind: str, url: str, tool: str, arguments: dict) -> dict:
        got = self._rpc(kind, url, "tools/call", {"name": tool, "arguments": arguments})
        return {"content": got.get("content") or [], "is_error": bool(got.get("isError"))}
