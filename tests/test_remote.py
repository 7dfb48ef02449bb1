import pytest

from tessera import remote
from tessera.schema import normalized


def test_addresses_that_probes_must_not_reach():
    assert all(map(remote.blocked, ["127.0.0.1", "10.0.0.1", "169.254.169.254", "0.0.0.0", "224.0.0.1", "::1", "fe80::1"]))
    assert not remote.blocked("8.8.8.8")
    with pytest.raises(PermissionError):
        remote.guarded(lambda h: ["8.8.8.8", "10.0.0.1"])("x")
    assert remote.guarded(lambda h: ["10.0.0.1"], allow_private=True)("x") == "10.0.0.1"
    assert remote.may_redirect("a", "A", 3) and not remote.may_redirect("a", "b", 1) and not remote.may_redirect("a", "a", 11)


def test_credentials():
    c = {"ids": {"one": {"K": "id"}}, "hosts": {"h": {"K": "host"}, "*.w.org": {"K": "wild"}}, "token": "t"}
    got = [remote.headers_for(c, i, h) for i, h in (("one", "h"), ("x", "h"), ("x", "a.w.org"), ("x", "y"))]
    assert got == [{"K": "id"}, {"K": "host"}, {"K": "wild"}, {"Authorization": "Bearer t"}] and remote.headers_for(None, "one", "h") == {}


def test_retries():
    answers, waits = [(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {}, b"ok")], []
    assert remote.with_retries(lambda: answers.pop(0), sleep=waits.append)[2] == b"ok" and waits == [0.5, 7.0]
    assert remote.with_retries(lambda: (500, {}, b"last"), retries=1, sleep=waits.append)[2] == b"last"


def test_model_answers():
    assert remote.parse_object('x ```json {"a": 1} ```') == {"a": 1} and remote.parse_object("no") is None
    assert remote.parse_order("[2, 2, 9, 1]", 2) == [1, 0]
    hits = [{"name": "a"}, {"name": "b"}, {"name": "c"}]
    assert [(h["name"], h["score"]) for h in remote.model_rerank(hits, "q", lambda *_: "[3]", lambda h: h)] == [("c", 1.0), ("a", pytest.approx(2 / 3)), ("b", pytest.approx(1 / 3))]
    assert remote.model_rerank(hits, "q", lambda *_: "none", lambda h: h[::-1]) == hits[::-1]


def test_calls():
    row = {"transports": [{"type": "stdio", "url": ""}, {"type": "sse", "url": "u"}]}
    assert remote.forward_call(row, "t", {}, lambda *_: {"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}], "is_error": True}) == ("a\nb", True)
    with pytest.raises(ConnectionError):
        remote.forward_call({"transports": []}, "t", {}, lambda *_: {})


def test_row_operators(spark):
    rows = normalized(spark.createDataFrame([("a", "A", [("sse", "u")]), ("b", "B", [])], "id string, title string, transports array<struct<type:string,url:string>>"))

    def list_tools(kind, url, cursor):
        return ([{"name": "one"}], "next") if not cursor else ([{"name": "two"}], "")

    got = {r["id"]: [t["name"] for t in r["tools"]] for r in remote.extract_tools(rows, list_tools).collect()}
    assert got == {"a": ["one", "two"], "b": []}
    cards = {r["id"]: r["enrichment"]["enricher"] for r in remote.model_cards(rows, lambda task, user: '{"summary": "s"}' if '"A"' in user else "?").collect()}
    assert cards == {"a": "llm", "b": "heuristic"}
    trust = {r["id"]: r["trust"] for r in remote.model_trust(rows, lambda task, user: '{"quality": 0.8}' if '"A"' in user else "?").collect()}
    assert trust == {"a": pytest.approx(0.4), "b": 0.0}
    vectors = remote.embed_texts(rows, "id", "title", lambda texts: [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))]).collect()
    assert {r["id"]: list(r["vector"]) for r in vectors} == {"a": [1.0], "b": [1.0]}
