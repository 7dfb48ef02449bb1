"""Registered queries of clients, service calls and commands, and their DuckDB text.

Other machines are stood in for by functions whose answers follow from the
driver's tables, so SQL can tell what must come out.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import remote, server
from .cli import run_eval, run_index
from .clients import ChatClient, EmbeddingsClient, MessagesClient, ToolServer
from .functions import text as X
from .operators import enrich, rank
from .plans import index as index_plan
from .plans import search as search_plan
from .plans.config import Config
from .plans.service import Discovery, resolve_all
from .plans.strategies import Clients, clients_for, steps_for
from .queries import _RERANKED, AS_OF, POOL, bm25_scores, query, r6, read
from .queries_sources import _each, _json_array
from .schema import normalized
from .scratch import new_path


def _number(text: str) -> int:
    """The last number of a text: the supplier that it speaks of."""
    return int(re.findall(r"\d+", text)[-1])


def suppliers(spark, sf_dir: str) -> DataFrame:
    """Suppliers as a catalogue of tool servers; some have tools, some no transport."""
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    way = lambda kind, url: F.struct(F.lit(kind).alias("type"), url.alias("url"))
    ways = F.array(way("stdio", F.lit("")), way("sse", F.lit("https://bad/0")), way("Streamable-HTTP", F.concat(F.lit("https://h/"), k.cast("string"))))
    tools = F.array(F.struct(F.lit("own").alias("name"), F.lit("").alias("description")))
    rows = s.select(
        F.lpad(k.cast("string"), 9, "0").alias("pos"), F.col("s_name").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("serves nation "), F.col("s_nationkey").cast("string")).alias("description"),
        F.array(F.concat(F.lit("c"), (k % 4).cast("string"))).alias("categories"), F.lit("file").alias("source"), k.alias("popularity"),
        F.when(k % 5 > 0, ways).alias("transports"), F.when(k % 4 == 0, tools).alias("tools"),
    )
    return normalized(rows, "pos")


# ---- probing


def _rpc(method: str, url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, dict, bytes]:
    """A tool server for each supplier: two pages of tools; some are down, and calls of odd ones are errors."""
    asked, k = json.loads(body), _number(url)
    if k % 3 == 0:
        return 503, {}, b""
    if asked["method"] == "tools/list":
        first = "cursor" not in asked["params"]
        result = {"tools": [{"name": f"a{k}" if first else f"b{k}", "description": "d"}]} | ({"nextCursor": "2"} if first else {})
    else:
        result = {"content": [{"type": "text", "text": asked["params"]["name"]}, {"type": "image"}, {"type": "text", "text": str(k)}], "isError": k % 2 == 1}
    return 200, {"Content-Type": "application/json"}, json.dumps({"result": result}).encode()


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'own' WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 THEN '' ELSE 'a' || s_suppkey || ',b' || s_suppkey END AS tools FROM supplier")
def extracted_tools(spark, sf_dir):
    """Rows without tools ask their transports in order, page by page; those that fail keep none."""
    rows = remote.extract_tools(suppliers(spark, sf_dir), ToolServer(send=_rpc).list_tools)
    return rows.select(F.col("popularity").alias("k"), F.array_join(F.transform("tools", lambda t: t["name"]), ",").alias("tools"))


# ---- models


def _chat(method: str, url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, dict, bytes]:
    """A model that knows the even suppliers, behind both wire formats."""
    asked = json.loads(body)
    system = asked.get("system") or next((m["content"] for m in asked["messages"] if m["role"] == "system"), "")
    k = _number(json.loads(asked["messages"][-1]["content"]).get("name") or "0") if asked["messages"][-1]["content"].startswith("{") else 0
    known = {remote.CARD_TASK: {"summary": f"sum {k}", "tasks": [f"t{k}"], "exampleQueries": [], "synonyms": None, "categories": ["x"]}, remote.QUALITY_TASK: {"quality": (k % 11) / 5, "rationale": f"why {k}", "flags": ["f"]}}
    text = f"{asked['model']}|{system}|{asked['messages'][-1]['content']}" if system not in known else f"Here:\n```json\n{json.dumps(known[system])}\n```" if k % 2 == 0 else "I cannot tell."
    if url.endswith("/v1/messages"):
        return 200, {}, json.dumps({"content": [{"type": "thinking"}, {"type": "text", "text": text}]}).encode()
    return 200, {}, json.dumps({"choices": [{"message": {"content": text}}]}).encode()


MODEL = Config(enricher="llm", trust="llm", llm_api_key="k", extract_tools=True)


@query("""SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'sum ' || s_suppkey ELSE 'serves nation ' || s_nationkey END AS summary, CASE WHEN s_suppkey % 2 = 0 THEN 't' || s_suppkey WHEN s_suppkey % 4 = 0 THEN 'own' ELSE '' END AS tasks,
  CASE WHEN s_suppkey % 2 = 0 THEN 'llm' ELSE 'heuristic' END AS enricher FROM supplier""")
def model_cards(spark, sf_dir):
    """Cards by a model; the heuristic's where its answer is none."""
    c = remote.model_cards(suppliers(spark, sf_dir), clients_for(MODEL, _chat).chat)
    return c.select(F.col("popularity").alias("k"), "enrichment.summary", F.array_join("enrichment.tasks", ",").alias("tasks"), "enrichment.enricher")


_HEURISTIC = "(0.4::DOUBLE * least(1.0::DOUBLE, log10(k + 1) / 4) + 0.15::DOUBLE + 0.3::DOUBLE * (2 + (k % 4 = 0)::INT + (k % 5 > 0)::INT) / 4)"


@query(f"""SELECT k, round(CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE * {_HEURISTIC} + 0.5::DOUBLE * least(1.0::DOUBLE, (k % 11) / 5) ELSE {_HEURISTIC} END, 6) AS trust,
  CASE WHEN k % 2 = 0 THEN 'why ' || k ELSE '' END AS rationale, CASE WHEN k % 2 = 0 THEN 'f' ELSE '' END AS flags FROM (SELECT s_suppkey AS k FROM supplier)""")
def model_trust(spark, sf_dir):
    """Half the heuristic's trust and half the model's; the heuristic's where the model fails."""
    rows = enrich.score_trust(suppliers(spark, sf_dir), AS_OF)
    c = remote.model_trust(rows, ChatClient("", "m", send=_chat))
    return c.select(F.col("popularity").alias("k"), r6(F.col("trust")).alias("trust"), F.col("trustRationale").alias("rationale"), F.array_join("trustFlags", ",").alias("flags"))


@query(f"""SELECT k, round(CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE * t + 0.5::DOUBLE * least(1.0::DOUBLE, (k % 11) / 5) ELSE t END, 6) AS trust, CASE WHEN k % 2 = 0 THEN 'llm' ELSE 'heuristic' END AS enricher,
  (k % 4 = 0)::BIGINT + CASE WHEN k % 4 > 0 AND k % 5 > 0 AND k % 3 > 0 THEN 2 ELSE 0 END AS tools FROM (SELECT s_suppkey AS k,
    0.4::DOUBLE * least(1.0::DOUBLE, log10(s_suppkey + 1) / 4) + 0.15::DOUBLE + 0.3::DOUBLE * (2 + (s_suppkey % 4 = 0 OR (s_suppkey % 5 > 0 AND s_suppkey % 3 > 0))::INT + (s_suppkey % 5 > 0)::INT) / 4 AS t FROM supplier)""")
def indexed_by_models(spark, sf_dir):
    """The indexing pass with the stages that the settings name: probing, cards and trust by a model."""
    clients = Clients(clients_for(MODEL, _chat).chat, None, ToolServer(send=_rpc))
    made = index_plan.build(suppliers(spark, sf_dir), MODEL, AS_OF, steps_for(MODEL, clients))
    return made.catalog.select(F.col("popularity").alias("k"), r6(F.col("trust")).alias("trust"), F.col("enrichment.enricher").alias("enricher"), F.size("tools").cast("bigint").alias("tools"))


@query("""WITH rows AS (SELECT s_suppkey AS k, 'rows' AS x FROM supplier), failed AS (
    SELECT 'cards' AS stage, k, 'ValueError: the answer has no object' AS why FROM rows WHERE k % 2 = 1 UNION ALL SELECT 'trust', k, 'ValueError: the answer has no object' FROM rows WHERE k % 2 = 1
    UNION ALL SELECT 'tools', k, NULL FROM rows WHERE k % 4 > 0 AND k % 5 > 0 AND k % 3 = 0)
  SELECT stage, count(*)::BIGINT AS failures, (count(*) FILTER (why IS NOT NULL))::BIGINT AS unreadable FROM failed GROUP BY stage""")
def stage_failures(spark, sf_dir):
    """How many rows each stage that asks other machines has failed for, as the log tells it."""
    rows = suppliers(spark, sf_dir)
    stages = {"cards": remote.asked_cards(rows, clients_for(MODEL, _chat).chat), "trust": remote.asked_trust(rows, ChatClient("", "m", send=_chat)), "tools": remote.probe_tools(rows, ToolServer(send=_rpc).list_tools)}
    found = [d.select(F.lit(n).alias("stage"), "failed").where("failed IS NOT NULL") for n, d in stages.items()]
    unreadable = F.count(F.when(F.col("failed").contains("no object"), 1))
    return found[0].unionByName(found[1]).unionByName(found[2]).groupBy("stage").agg(F.count("*").alias("failures"), unreadable.alias("unreadable"))


@query("""SELECT s_suppkey AS k, 'm|be short|hi ' || s_name AS messages, 'm|be short|hi ' || s_name AS chat, 'm||hi ' || s_name AS without_task FROM supplier""")
def model_clients(spark, sf_dir):
    """Both wire formats, with and without a task, asked once for each supplier by the tasks that hold them."""
    messages, chat, bare = MessagesClient("k", "m", send=_chat), ChatClient("k", "m", send=_chat), ChatClient("", "m", send=_chat)
    asked = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("hi "), "s_name").alias("said"))
    return _each(asked, lambda said: (messages("be short", said), chat("be short", said), bare("", said)), "k long, messages string, chat string, without_task string")


def _order(system: str, user: str) -> str:
    asked = json.loads(user)
    return "[3, 1, 3, 99]" if len(asked["query"]) % 2 == 0 else "no order"


@query(f"""WITH {_RERANKED}, sized AS (SELECT h.*, length(text) % 2 = 0 AS told, count(*) OVER (PARTITION BY qid) AS n FROM hits h JOIN benchmark ON item_id = qid),
  ordered AS (SELECT qid, id, n, CASE WHEN pos = 2 THEN 0 WHEN pos < 2 THEN pos + 1 ELSE pos END AS pos FROM sized WHERE told)
SELECT qid, id AS doc_id, pos::BIGINT AS pos, round((n - pos)::DOUBLE / n, 6) AS score FROM ordered
UNION ALL SELECT qid, id, pos::BIGINT, round(score, 6) FROM ranked WHERE qid NOT IN (SELECT qid FROM ordered)""")
def model_reranked(spark, sf_dir):
    """Pools in a model's order, what it leaves out last; by terms where it gives no order."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"))
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    hits = bm25_scores(spark, sf_dir, POOL).join(docs, "doc_id").withColumn("mcp_id", F.col("doc_id").cast("string")).withColumn("name", F.lit(""))

    def by_terms(left: DataFrame) -> DataFrame:
        terms = queries.select("qid", X.term_set(F.col("query")).alias("_qt"))
        return rank.lexical_rerank(left.join(terms, "qid").withColumn("_ct", X.term_set(F.col("description"))), "_qt", "_ct").drop("_qt", "_ct")

    out = remote.model_rerank_all(hits, queries, _order, by_terms)
    return out.select("qid", "doc_id", F.col("pos").cast("bigint").alias("pos"), r6(F.col("score")).alias("score"))


def _embedder(method: str, url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, dict, bytes]:
    """Vectors that tell a text's length, in reverse order."""
    texts = json.loads(body)["input"]
    return 200, {}, json.dumps({"data": [{"index": i, "embedding": [len(t), 1.0]} for i, t in reversed(list(enumerate(texts)))]}).encode()


@query("SELECT doc_id, len(text)::DOUBLE AS first, 2::BIGINT AS dim FROM documents")
def embedded_texts(spark, sf_dir):
    """Vectors by a service that answers batches in any order."""
    v = remote.embed_texts(read(spark, sf_dir, "documents"), "doc_id", "text", EmbeddingsClient("k", "m", send=_embedder))
    return v.select("doc_id", F.col("vector")[0].cast("double").alias("first"), F.size("vector").cast("bigint").alias("dim"))


def _counting(method: str, url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, dict, bytes]:
    """Vectors of the number of vowels and of other characters."""
    texts = json.loads(body)["input"]
    vowels = [sum(c in "aeiou" for c in t) for t in texts]
    return 200, {}, json.dumps({"data": [{"index": i, "embedding": [v, len(t) - v]} for i, (t, v) in enumerate(zip(texts, vowels))]}).encode()


_VOWELS = "(length(t) - length(regexp_replace(t, '[aeiou]', '', 'g')))::DOUBLE"


@query(f"""WITH e AS (SELECT s_name AS id, 0 AS ordinal, s_name || chr(10) || 'serves nation ' || s_nationkey || chr(10) || 'Categories: c' || s_suppkey % 4 || CASE WHEN s_suppkey % 4 = 0 THEN chr(10) || 'Tools: own' ELSE '' END AS t FROM supplier
    UNION ALL SELECT s_name, 1, 'own' || chr(10) || 'From MCP: ' || s_name FROM supplier WHERE s_suppkey % 4 = 0),
  v AS (SELECT id, ordinal, {_VOWELS} AS x, length(t) - {_VOWELS} AS y FROM e), q AS (SELECT n_nationkey AS qid, {_VOWELS} AS x, length(t) - {_VOWELS} AS y FROM (SELECT n_nationkey, n_name || ' nation' AS t FROM nation)),
  s AS (SELECT qid, id, ordinal, (q.x * v.x + q.y * v.y) / (sqrt(q.x * q.x + q.y * q.y) * sqrt(v.x * v.x + v.y * v.y)) AS score FROM q, v),
  p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id, ordinal) AS r FROM s), c AS (SELECT qid, id, max(score) AS score, count(*) AS n FROM p WHERE r <= 130 GROUP BY ALL)
SELECT qid, id, round(score, 6) AS score, n::BIGINT AS match_count FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 30""")
def searched_by_service_vectors(spark, sf_dir):
    """The index and its queries with vectors of an embedding service, by cosine alone."""
    config = Config(embedder="openai", embed_dim=2, hybrid=False, enricher="none")
    clients = Clients(embed=EmbeddingsClient("k", "m", send=_counting))
    made = index_plan.build(suppliers(spark, sf_dir), config, AS_OF, steps_for(config, clients))
    asked = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("qid"), F.concat("n_name", F.lit(" nation")).alias("query"), F.lit(5).alias("top_k"), F.lit("").alias("source"), F.array().cast("array<string>").alias("categories"))
    found = search_plan.candidates(asked, made, config, clients.embed)
    return found.select("qid", F.col("mcp_id").alias("id"), r6(F.col("score")).alias("score"), F.col("match_count").cast("bigint").alias("match_count"))


# ---- service calls


def _discovery(spark, sf_dir, **given) -> Discovery:
    config = Config(**given)
    return Discovery(spark, index_plan.build(suppliers(spark, sf_dir), config, AS_OF).persist(), config, clients=Clients(tools=ToolServer(send=_rpc)))


@query("""SELECT upper(s_name) AS asked, s_name AS id, 0::BIGINT AS suggestions FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_name, s_name, 0 FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'Supplier of nothing', NULL, least(5, count(*)) FROM supplier""")
def resolved_ids(spark, sf_dir):
    """Ids as they are, in another letter case, or unknown with suggestions: a batch of them at once."""
    s, odd = read(spark, sf_dir, "supplier"), F.col("s_suppkey") % 2 == 1
    asked = s.select(F.when(odd, F.upper("s_name")).otherwise(F.col("s_name")).alias("id")).unionByName(spark.createDataFrame([("Supplier of nothing",)], "id string"))
    out = resolve_all(spark, asked, index_plan.build(suppliers(spark, sf_dir), Config(), AS_OF))
    return out.select("asked", "id", F.size("suggestions").cast("bigint").alias("suggestions"))


def _post(discovery: Discovery, name: str, **arguments):
    body = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}}
    status, _, out = server.handle(discovery, "POST", "/", json.dumps(body).encode())
    answer = json.loads(out)["result"]
    return "error" if answer["isError"] else answer["structuredContent"]["result"]


@query("""WITH n AS (SELECT lpad(k::VARCHAR, 9, '0') AS name, k FROM (SELECT unnest([1, 2, 3, 4]) AS k))
SELECT '/healthz' AS call, 'ok' AS answer UNION ALL SELECT 'tools', 'call_tool,categories,details,search' UNION ALL SELECT 'tools without calls', 'categories,details,search'
UNION ALL SELECT 'categories', 'c0,c1,c2,c3' UNION ALL SELECT 'search empty', 'error' UNION ALL SELECT 'search', 'Supplier#000000002' UNION ALL SELECT 'details', 'Supplier#000000004'
UNION ALL SELECT 'details other case', 'Supplier#000000004' UNION ALL SELECT 'details unknown', '5' UNION ALL SELECT 'call ' || k, CASE WHEN k % 3 = 0 THEN 'error' ELSE 'do' || chr(10) || k || CASE WHEN k % 2 = 1 THEN ' failed' ELSE '' END END FROM n
UNION ALL SELECT 'call unknown', 'not found' UNION ALL SELECT '/stats ' || k, CASE WHEN k % 3 = 0 THEN '1 0 0' WHEN k % 2 = 1 THEN '1 0 1' ELSE '1 1 0' END FROM n""")
def service_calls(spark, sf_dir):
    """Every call, through the server's handler."""
    d = _discovery(spark, sf_dir)
    name = lambda k: f"Supplier#{k:09d}"
    listed = json.loads(server.handle(d, "POST", "/", json.dumps({"id": 1, "method": "tools/list"}).encode())[2])["result"]["tools"]
    without = Discovery(spark, d.index, Config(proxy_enabled=False), clients=d.clients).tools()
    rows = [("/healthz", server.handle(d, "GET", "/healthz")[2].decode()), ("tools", ",".join(sorted(t["name"] for t in listed))), ("tools without calls", ",".join(sorted(without)))]
    rows += [("categories", ",".join(_post(d, "categories"))), ("search empty", _post(d, "search", query="")), ("search", _post(d, "search", query="supplier 000000002", top_k=1)[0]["id"])]
    rows += [("details", _post(d, "details", id_=name(4))["record"]["id"]), ("details other case", _post(d, "details", id_=name(4).upper())["record"]["id"]), ("details unknown", str(len(_post(d, "details", id_="supplier of nothing")["suggestions"])))]
    for k in (1, 2, 3, 4):
        got = _post(d, "call_tool", id_=name(k), tool="do", arguments={})
        rows.append((f"call {k}", got if got == "error" else got["content"] + (" failed" if got["is_error"] else "")))
    rows.append(("call unknown", "found" if _post(d, "call_tool", id_="supplier of nothing", tool="do", arguments={})["found"] else "not found"))
    stats = json.loads(server.handle(d, "GET", "/stats")[2])
    rows += [(f"/stats {k}", "{calls} {successes} {tool_errors}".format(**stats[name(k)])) for k in (1, 2, 3, 4)]
    return spark.createDataFrame(rows, "call string, answer string")


@query("SELECT s_name AS id, (1 + s_suppkey % 3)::BIGINT AS calls, (1 + s_suppkey % 3)::BIGINT AS successes FROM supplier")
def usage_persisted(spark, sf_dir):
    """Tallies are flushed from time to time and at the end; the next service starts from them."""
    config, index = Config(usage_path=f"{new_path(spark, 'usage')}/usage.json"), None
    first = Discovery(spark, index, config, flush_seconds=3600.0)
    ids = [(r["s_name"], 1 + r["s_suppkey"] % 3) for r in read(spark, sf_dir, "supplier").select("s_name", "s_suppkey").collect()]
    for id_, _ in ids:
        first._record(id_, "success")
    if Discovery(spark, index, config).tallies:
        raise ValueError("flushed too early")
    for id_, n in ids:
        for _ in range(n - 1):
            first._record(id_, "success")
    first.close()
    return spark.createDataFrame([(k, v[0], v[1]) for k, v in Discovery(spark, index, config).tallies.items()], "id string, calls bigint, successes bigint")


@query("SELECT s_name AS id, 0.0::DOUBLE AS trust, '' AS summary, '' AS enricher FROM supplier")
def stages_left_out(spark, sf_dir):
    """No enrichment and no trust: rows stay as they are."""
    rows = index_plan.build(suppliers(spark, sf_dir), Config(enricher="none", trust="none"), AS_OF).catalog
    return rows.select("id", "trust", "enrichment.summary", "enrichment.enricher")


@query("SELECT 'n=' || count(*) || ' Hit@1=1.000 Recall@5=1.000 MRR=1.000 nDCG@5=1.000' AS line FROM supplier")
def commands_index_and_eval(spark, sf_dir):
    """The commands: index a file, then score labelled queries of it."""
    folder = new_path(spark, "commands")
    s = read(spark, sf_dir, "supplier").orderBy("s_suppkey")
    file = _json_array(s.select(F.col("s_name").alias("name"), F.col("s_address").alias("description") if "s_address" in s.columns else F.lit("x").alias("description")), f"{folder}/rows.json")
    golden = _json_array(s.select(F.col("s_name").alias("query"), F.array("s_name").alias("expected")), f"{folder}/golden.json")
    run_index(spark, Config(), {"file": file}, f"{folder}/index", as_of=AS_OF)
    return spark.createDataFrame([(run_eval(spark, Config(), f"{folder}/index", golden, 5),)], "line string")
