"""The calls over HTTP: JSON-RPC at ``/``, ``/healthz`` and ``/stats``."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .plans.service import Discovery

PROTOCOL = "2025-03-26"


def handle(discovery: Discovery, method: str, path: str, body: bytes = b"") -> tuple[int, str, bytes]:
    """Status, content type and body of the answer to one request."""
    if path == "/healthz":
        return 200, "text/plain", b"ok"
    if path == "/stats":
        return 200, "application/json", json.dumps(discovery.snapshot()).encode()
    if method != "POST":
        return 405, "text/plain", b"only POST"
    try:
        asked = json.loads(body)
    except ValueError:
        return 400, "application/json", _error(None, -32700, "no JSON")
    if "id" not in asked:  # a notification
        return 202, "text/plain", b""
    try:
        result = _result(discovery, asked.get("method"), asked.get("params") or {})
    except LookupError as unknown:
        return 200, "application/json", _error(asked["id"], -32601, str(unknown))
    return 200, "application/json", json.dumps({"jsonrpc": "2.0", "id": asked["id"], "result": result}, default=str).encode()


def _error(id_, code: int, message: str) -> bytes:
    return json.dumps({"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}).encode()


def _result(discovery: Discovery, method: str | None, params: dict) -> dict:
    offered = discovery.tools()
    if method == "initialize":
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": p}} for n, p in offered.items()]}
    if method != "tools/call":
        raise LookupError(f"unknown method: {method}")
    name = params.get("name")
    if name not in offered:
        raise LookupError(f"unknown tool: {name}")
    try:
        found = getattr(discovery, name)(**(params.get("arguments") or {}))
    except Exception as error:  # noqa: BLE001  a failed call is an answer of its own
        return {"content": [{"type": "text", "text": str(error)}], "isError": True}
    return {"content": [{"type": "text", "text": json.dumps(found, default=str, ensure_ascii=False)}], "structuredContent": {"result": found}, "isError": False}


def serve(discovery: Discovery, address: str = ":8080") -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``; stopping it is followed by ``discovery.close()``."""
    host, _, port = address.rpartition(":")

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, out = handle(discovery, self.command, self.path.partition("?")[0], body)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _answer  # noqa: N815

        def log_message(self, *args) -> None:
            return

    return ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
