"""Parts that several plans share: exact neighbours, passages, unions by key, bounded calls, clients, the server."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import clients, remote, server
from tessera.operators import encode, points, resolve, retrieve
from tessera.plans.config import Config
from tessera.plans.strategies import clients_for, steps_for
from tessera.schema import normalized
from tessera.scratch import new_path, read_file, write_file


def test_exact_neighbours(spark):
    """Filters, ties and zero vectors, over several partitions and blocks of queries."""
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((120, 8)), 1).astype(np.float32)
    x[50:60], x[70:73] = x[3], 0
    rows = [(f"p{i:03d}", i % 7, f"s{i % 3}", [f"c{i % 4}", "all"] if i % 5 else [], [float(v) for v in x[i]]) for i in range(120)]
    every = spark.createDataFrame(rows, "point_id string, ordinal int, source string, categories array<string>, vector array<float>").repartition(5)
    asked = [(q, [float(v) for v in x[q]], "s1" if q % 3 == 1 else "", ["c1", "c2"] if q % 4 == 2 else []) for q in range(0, 40)]
    queries = spark.createDataFrame(asked, "qid long, qvec array<float>, source string, categories array<string>")
    old, retrieve.BLOCK = retrieve.BLOCK, 9
    try:
        got = retrieve.dense_candidates(queries, every, 6, "point_id", ["ordinal", "point_id"]).collect()
    finally:
        retrieve.BLOCK = old
    y = x.astype(float)
    for q, _, source, categories in asked:
        scored = []
        for name, ordinal, s, c, v in rows:
            if (source and s != source) or (categories and not set(c) & set(categories)):
                continue
            b = np.array(v)
            size = np.linalg.norm(y[q]) * np.linalg.norm(b)
            score = float(y[q] @ b / size) if size > 0 else 0.0
            scored.append((-round(score, 9), ordinal, name))
        assert [(r["pos"], r["point_id"]) for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["pos"])] == [(i, n) for i, (*_, n) in enumerate(sorted(scored)[:6])]
    assert retrieve.dense_candidates(queries.limit(0), every, 6).count() == 0
    with pytest.raises(ValueError, match="length 8"):
        points.ensure_dimension(every, "vector", 9)


def test_passages(spark):
    texts = spark.createDataFrame([(1, "abc abd"), (2, None), (3, ""), (4, "xabdx")], "k long, t string")
    patterns = spark.createDataFrame([(1, "ab"), (2, "abd"), (3, ""), (4, "zz"), (5, "ab"), (6, None)], "qid long, query string")
    want = {(1, 1), (1, 4), (5, 1), (5, 4), (2, 1), (2, 4), (3, 1), (3, 3), (3, 4)}
    for most in (1, 1 << 20):
        assert {tuple(r) for r in retrieve.containing(texts, "k", "t", patterns, most).collect()} == want


def test_union_by(spark):
    rows = spark.createDataFrame([(["b", "A", "a", "B", "c", "b"],), ([],), (["x"],)], "v array<string>")
    assert [r[0] for r in rows.select(resolve.union_by(F.col("v"), F.lower)).collect()] == [["b", "A", "c"], [], ["x"]]


def test_dense_vectors(spark):
    long = spark.createDataFrame([(1, 0, 0.5), (1, 5, -1.0), (2, 3, 1.0)], "k int, idx int, value double")
    assert {r["k"]: list(r["vector"]) for r in encode.dense_vectors(long, "k", 6).collect()} == {1: [0.5, 0, 0, 0, 0, -1.0], 2: [0, 0, 0, 1.0, 0, 0]}


def test_bounded_calls():
    def slow(x):
        time.sleep(x)
        return x

    got = remote.bounded_map(slow, [0.0, 5.0, 0.01], 3, 0.3)
    assert got[0] == (0.0, None) and got[2] == (0.01, None) and got[1][0] is None and "Timeout" in got[1][1]
    assert remote.bounded_map(lambda x: 1 / x, [0, 1], 2)[0][1].startswith("ZeroDivisionError") and remote.bounded_map(slow, []) == []


def test_deadlines_count_from_each_start():
    """12 calls that hang, 4 at a time, with a second each, take 3 seconds; a slow one before others does not fail them."""
    began = time.monotonic()
    got = remote.bounded_map(lambda x: time.sleep(30), list(range(12)), 4, 1.0)
    assert 2.9 < time.monotonic() - began < 4.5 and all(g[0] is None and "Timeout" in g[1] for g in got)
    slow = lambda x: time.sleep(x) or x
    assert remote.bounded_map(slow, [0.3] * 10 + [5.0], 2, 0.6) == [(0.3, None)] * 10 + [(None, "TimeoutError: not done after 0.6 s")]


def test_failures_are_counted_and_the_first_are_told(spark, caplog):
    rows = normalized(spark.createDataFrame([(f"{i:02d}", f"n{i}", [("sse", f"u{i}")]) for i in range(20)], "id string, name string, transports array<struct<type:string,url:string>>"))

    def client(task, user):
        k = int(json.loads(user)["name"][1:])
        if k % 2:
            raise OSError(f"no answer {k}")
        return "{}" if k % 4 else '{"quality": 1, "summary": "s"}'

    with caplog.at_level("WARNING", "tessera"):
        assert {r["enrichment"]["enricher"] for r in remote.model_cards(rows, client).collect()} == {"llm", "heuristic"}
        remote.model_trust(rows, client)
        remote.extract_tools(rows, lambda kind, url, cursor: client("", json.dumps({"name": "n" + url[1:]})) and ([], ""))
    said = [r.getMessage() for r in caplog.records]
    assert said[:6] == [*[f"enrichment: {k:02d}: OSError: no answer {k}" for k in (1, 3, 5, 7, 9)], "enrichment completed with 10 failures of 20 (the fallback counts)"]
    assert "trust scoring: 02: ValueError: the answer has no quality" in said and "trust scoring completed with 15 failures of 20 (the fallback counts)" in said
    assert "tool extraction completed with 10 failures of 20 (the fallback counts)" in said


def answering(status, body, headers=None):
    return lambda *_: (status, headers or {}, json.dumps(body).encode())


def test_clients():
    with pytest.raises(ConnectionError, match="400"):
        clients.ChatClient("k", "m", send=answering(400, {}))("s", "u")
    with pytest.raises(ConnectionError, match="busy"):
        clients.MessagesClient("k", "m", send=answering(200, {"error": {"message": "busy"}}))("s", "u")
    with pytest.raises(ConnectionError, match="no choices"):
        clients.ChatClient("k", "m", send=answering(200, {"choices": []}))("s", "u")
    sent = []
    clients.ChatClient("", "m", send=lambda *a: sent.append(a) or (200, {}, b'{"choices": [{"message": {"content": "x"}}]}'))("", "u")
    assert "Authorization" not in sent[0][2] and [m["role"] for m in json.loads(sent[0][3])["messages"]] == ["user"]
    stream = lambda *_: (200, {"content-type": "text/event-stream"}, b'event: message\ndata: {"result": {"tools": [{"name": "t"}]}}\n\n')
    assert clients.ToolServer(send=stream).list_tools("streamable", "https://h", "") == ([{"name": "t"}], "")
    with pytest.raises(PermissionError):
        clients.sender(public=True)("GET", "http://127.0.0.1:1/", {}, b"", 1.0)


def test_strategies():
    with pytest.raises(ValueError, match="llm_api_key"):
        Config(enricher="llm")
    with pytest.raises(ValueError, match="embed_model"):
        Config(embedder="openai", embed_model="")
    with pytest.raises(ValueError, match="unknown reranker"):
        Config(reranker="magic")
    config = Config(enricher="llm", llm_provider="openai", extract_tools=True, embedder="openai")
    made = clients_for(config, answering(200, {}))
    steps = steps_for(config, made)
    assert isinstance(made.chat, clients.ChatClient) and steps.extract and steps.enrich and steps.embed and not steps.trust
    plain = clients_for(Config(proxy_enabled=False))
    assert plain.chat is plain.embed is plain.tools is None


class Calls:
    """Stands for the service."""

    def tools(self):
        return {"details": {"id_": {"type": "string"}}}

    def details(self, id_):
        if not id_:
            raise ValueError("id is empty")
        return {"found": id_ == "a"}

    def snapshot(self):
        return {"a": {"calls": 1}}


def test_server():
    ask = lambda body, method="POST", path="/": server.handle(Calls(), method, path, body if isinstance(body, bytes) else json.dumps(body).encode())
    assert ask(b"", "GET", "/healthz") == (200, "text/plain", b"ok") and json.loads(ask(b"", "GET", "/stats")[2]) == {"a": {"calls": 1}}
    assert ask(b"", "GET")[0] == 405 and ask(b"{")[0] == 400 and ask({"method": "notifications/initialized"})[0] == 202
    call = lambda name, **a: json.loads(ask({"id": 7, "method": "tools/call", "params": {"name": name, "arguments": a}})[2])
    assert call("details", id_="a")["result"]["structuredContent"] == {"result": {"found": True}}
    assert call("details", id_="")["result"]["isError"] and call("other")["error"]["code"] == -32601
    assert json.loads(ask({"id": 1, "method": "initialize"})[2])["result"]["capabilities"] == {"tools": {}}
    assert json.loads(ask({"id": 1, "method": "x"})[2])["error"]["code"] == -32601


def test_files(spark):
    path = f"{new_path(spark, 'files')}/x"
    assert read_file(spark, path) is None
    write_file(spark, path, b"\x00\xff")
    assert read_file(spark, path) == b"\x00\xff"
