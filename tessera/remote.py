"""Parts that talk to other machines, through clients that are handed in.

Nothing here opens a connection by itself: each operator takes a callable, so
tests use fakes, and runs once for each row of a partition.
"""

from __future__ import annotations

import ipaddress
import json
import logging
import re
import time
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from itertools import islice
from queue import Empty, SimpleQueue
from threading import Thread

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scoring import client_transport
from .operators.enrich import card
from .schema import CARD, TOOL
from .scratch import ship, store

LOG = logging.getLogger("tessera")
RETRYABLE = (429, 500, 502, 503, 504)
Client = Callable[[str, str], str]


def retry_after(header: str | None, now: float) -> float | None:
    """Seconds to wait: a number, or the time until an HTTP date."""
    if not header:
        return None
    if header.strip().isdigit():
        return float(header)
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - now)
    except (TypeError, ValueError):
        return None


def with_retries(send: Callable[[], tuple[int, dict, bytes]], retries: int = 3, first: float = 0.5, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> tuple[int, dict, bytes]:
    """Up to ``retries`` more attempts with doubling waits; the last answer counts whatever it is."""
    wait = first
    for attempt in range(retries + 1):
        try:
            answer = send()
        except OSError:
            if attempt == retries:
                raise
            answer = None
        if answer and (answer[0] not in RETRYABLE or attempt == retries):
            return answer
        told = retry_after(answer[1].get("Retry-After"), clock()) if answer else None
        sleep(wait if told is None else told)
        wait *= 2
    raise AssertionError("unreachable")


#: Networks that a probe must not reach - loopback, private, link-local, multicast, unspecified.
REFUSED = [ipaddress.ip_network(n) for n in ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "224.0.0.0/4", "0.0.0.0/32", "::1/128", "::/128", "fc00::/7", "fe80::/10", "ff00::/8")]


def blocked(address: str) -> bool:
    """Addresses that a probe must not reach."""
    ip = ipaddress.ip_address(address)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return any(ip in network for network in REFUSED if network.version == ip.version)


def guarded(resolve: Callable[[str], list[str]], allow_private: bool = False) -> Callable[[str], str]:
    """A resolver that names the first address, and refuses hosts with a blocked one."""

    def dial(host: str) -> str:
        found = resolve(host)
        bad = [a for a in found if blocked(a)]
        if not found or (bad and not allow_private):
            raise PermissionError(f"{host} does not resolve to a public address")
        return found[0]

    return dial


def may_redirect(first_host: str, next_host: str, hops: int) -> bool:
    return first_host.lower() == next_host.lower() and hops <= 10


def headers_for(credentials: dict | None, id_: str, host: str) -> dict[str, str]:
    """By exact id, exact host, ``*.`` suffix of the host, then the common token; none for no credentials."""
    if not credentials:
        return {}
    for part, name in (("ids", id_), ("hosts", host)):
        if name in credentials.get(part, {}):
            return credentials[part][name]
    for pattern, value in credentials.get("hosts", {}).items():
        if pattern.startswith("*.") and host.endswith(pattern[1:]):
            return value
    return {"Authorization": f"Bearer {credentials['token']}"} if credentials.get("token") else {}


def bounded_map(function: Callable, items: list, together: int = 8, timeout: float | None = None) -> list[tuple[object, str | None]]:
    """(result, None) or (None, error) of each item, in order.

    ``together`` run at a time.  An item that is not done ``timeout`` seconds after
    its own start has failed, and its place goes to the next one; what it still
    does in its thread is not waited for.
    """
    out: list = [None] * len(items)
    done: SimpleQueue = SimpleQueue()
    started: dict[int, float] = {}
    following = iter(range(len(items)))

    def run(i: int) -> None:
        try:
            done.put((i, (function(items[i]), None)))
        except Exception as error:  # noqa: BLE001  counted by the caller
            done.put((i, (None, f"{type(error).__name__}: {error}")))

    while True:
        for i in islice(following, max(1, together) - len(started)):
            started[i] = time.monotonic()
            Thread(target=run, args=(i,), daemon=True).start()
        if not started:
            return out
        try:
            i, result = done.get(timeout=None if timeout is None else max(0.0, min(started.values()) + timeout - time.monotonic()))
            if started.pop(i, None) is not None:  # otherwise it has failed before
                out[i] = result
        except Empty:
            now = time.monotonic()
            for i in [i for i, began in started.items() if began + timeout <= now]:
                del started[i]
                out[i] = (None, f"TimeoutError: not done after {timeout} s")


def outcomes(found: DataFrame, label: str, most: int = 5) -> tuple[int, int, list[str]]:
    """How many rows of (id, failed) there are, how many of them failed, and the first ``most`` failures by id; the latter two go to the log."""
    n, bad = found.agg(F.count("*"), F.count("failed")).first()
    first = [f"{r['id']}: {r['failed']}" for r in found.where("failed IS NOT NULL").orderBy("id").select("id", "failed").limit(most).collect()] if bad else []
    for line in first:
        LOG.warning("%s: %s", label, line)
    if bad:
        LOG.warning("%s completed with %d failures of %d (the fallback counts)", label, bad, n)
    return n, bad, first


def extract_tools(catalog: DataFrame, list_tools: Callable[[str, str, str], tuple[list[dict], str]], together: int = 8, timeout: float | None = 20.0) -> DataFrame:
    """``catalog`` with the tools of rows that have none but have transports, asked for page by page; see ``probe_tools``."""
    found = store(probe_tools(catalog, list_tools, together, timeout), "probed")
    outcomes(found, "tool extraction")
    joined = catalog.join(found.where("failed is null").select("id", "found"), "id", "left")
    return joined.withColumn("tools", F.when(F.size("tools") > 0, F.col("tools")).otherwise(F.coalesce("found", "tools"))).select(*catalog.columns)


def probe_tools(catalog: DataFrame, list_tools: Callable[[str, str, str], tuple[list[dict], str]], together: int = 8, timeout: float | None = 20.0) -> DataFrame:
    """id, found, failed of rows that have no tools but transports.

    ``list_tools(kind, url, cursor)`` gives tools and the next cursor.  The first
    transport with tools counts; a transport that fails is passed over, a row all
    of whose transports fail has failed with the first error, and one of which none
    can be asked has no tools and no failure.  Each task asks
    ``together`` rows at a time; a row that is not done after ``timeout`` has failed.
    """
    ship(catalog.sparkSession)
    need = (F.size("tools") == 0) & (F.size("transports") > 0)
    usable = F.filter(F.transform("transports", lambda t: F.struct(client_transport(t["type"], t["url"]).alias("kind"), t["url"].alias("url"))), lambda t: t["kind"] != "none")

    def one(ways) -> list[dict]:
        failures = []
        for way in ways:
            try:
                cursor, tools = "", []
                while True:
                    page, cursor = list_tools(way["kind"], way["url"], cursor)
                    tools += page
                    if not cursor:
                        break
            except Exception as error:  # noqa: BLE001  best effort: the next transport may answer
                failures.append(error)
                continue
            if tools:
                return [{"name": t.get("name", ""), "description": t.get("description", "")} for t in tools]
        if failures and len(failures) == len(ways):
            raise failures[0]
        return []

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = bounded_map(one, frame["ways"].tolist(), together, timeout)
            yield pd.DataFrame({"id": frame["id"], "found": [f for f, _ in got], "failed": [e for _, e in got]})

    return catalog.where(need).select("id", usable.alias("ways")).mapInPandas(probe, f"id string, found array<{TOOL}>, failed string").dropDuplicates(["id"])


CARD_TASK = "Describe what an agent can do with this service. Answer with one JSON object with the keys summary, tasks, exampleQueries, synonyms and categories."
QUALITY_TASK = "Rate how trustworthy and complete this service's description is. Answer with one JSON object with the keys quality (0 to 1), rationale and flags."
ORDER_TASK = "Order the numbered candidates from best to worst for the query. Answer with a JSON array of their numbers."


def parse_object(raw: str) -> dict | None:
    """The object from the first ``{`` to the last ``}``, fences or not."""
    found = re.search(r"\{.*\}", raw, re.S)
    try:
        out = json.loads(found[0]) if found else None
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def parse_order(raw: str, n: int) -> list[int]:
    """Distinct places from 0, within n; ValueError if none is valid."""
    found = re.search(r"\[.*\]", raw, re.S)
    places: list[int] = []
    for p in json.loads(found[0]) if found else []:
        if isinstance(p, int) and 1 <= p <= n and p - 1 not in places:
            places.append(p - 1)
    if not places:
        raise ValueError("no valid order")
    return places


def _ask(client: Client, task: str, row: dict) -> dict:
    found = parse_object(client(task, json.dumps({k: row[k] for k in ("name", "title", "description")}, ensure_ascii=False)))
    if found is None:
        raise ValueError("the answer has no object")
    return found


def asked_cards(catalog: DataFrame, client: Client, together: int = 8) -> DataFrame:
    """id, card, failed: cards by a language model, ``together`` asked for at a time."""
    ship(catalog.sparkSession)
    names = ("tasks", "exampleQueries", "synonyms", "categories")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = bounded_map(lambda row: _ask(client, CARD_TASK, row), frame.to_dict("records"), together)
            cards = [None if c is None else {"summary": str(c.get("summary", "")), "enricher": "llm"} | {n: [str(x) for x in c.get(n) or []] for n in names} for c, _ in got]
            yield pd.DataFrame({"id": frame["id"], "card": cards, "failed": [e for _, e in got]})

    return catalog.select("id", "name", "title", "description").mapInPandas(run, f"id string, card {CARD}, failed string").dropDuplicates(["id"])


def model_cards(catalog: DataFrame, client: Client, together: int = 8) -> DataFrame:
    """Cards by a language model; the heuristic's where it fails, which is counted in the log."""
    got = store(asked_cards(catalog, client, together), "cards")
    outcomes(got, "enrichment")
    own = card(F.col("description"), F.col("title"), F.col("tools")).cast(CARD)
    return catalog.join(got.drop("failed"), "id", "left").withColumn("enrichment", F.coalesce("card", own)).select(*catalog.columns)


def asked_trust(catalog: DataFrame, client: Client, together: int = 8) -> DataFrame:
    """id, q, why, flags, failed: how a language model rates the rows; an answer without a number is a failure."""
    ship(catalog.sparkSession)

    def rated(row: dict) -> dict:
        found = _ask(client, QUALITY_TASK, row)
        if not isinstance(found.get("quality"), int | float):
            raise ValueError("the answer has no quality")
        return {"q": min(1.0, max(0.0, float(found["quality"]))), "why": str(found.get("rationale", "")), "flags": [str(x) for x in found.get("flags") or []]}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = bounded_map(rated, frame.to_dict("records"), together)
            yield pd.DataFrame({"id": frame["id"], **{n: [g and g[n] for g, _ in got] for n in ("q", "why", "flags")}, "failed": [e for _, e in got]})

    return catalog.select("id", "name", "title", "description").mapInPandas(run, "id string, q double, why string, flags array<string>, failed string").dropDuplicates(["id"])


def model_trust(catalog: DataFrame, client: Client, together: int = 8) -> DataFrame:
    """Half the trust there is, half the model's; unchanged where it fails, which is counted in the log."""
    got = store(asked_trust(catalog, client, together), "trust")
    outcomes(got, "trust scoring")
    joined = catalog.join(got.drop("failed"), "id", "left")
    return joined.withColumns({"trust": F.coalesce(0.5 * F.col("trust") + 0.5 * F.col("q"), "trust"), "trustRationale": F.coalesce("why", "trustRationale"), "trustFlags": F.coalesce("flags", "trustFlags")}).select(*catalog.columns)


def model_rerank(hits: list[dict], query: str, client: Client, fallback: Callable[[list[dict]], list[dict]]) -> list[dict]:
    """Collected hits in the model's order, those it leaves out last; scores fall evenly from 1."""
    if len(hits) <= 1:
        return hits
    try:
        order = parse_order(client(ORDER_TASK, json.dumps({"query": query, "candidates": [{"n": i + 1, "name": h.get("name", ""), "description": h.get("description", "")} for i, h in enumerate(hits)]}, ensure_ascii=False)), len(hits))
    except Exception:  # noqa: BLE001  any failure falls back
        return fallback(hits)
    order += [i for i in range(len(hits)) if i not in order]
    return [hits[i] | {"score": (len(hits) - place) / len(hits)} for place, i in enumerate(order)]


def model_rerank_all(hits: DataFrame, queries: DataFrame, client: Client, fallback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pools of many queries in the model's order: ``score`` and ``pos`` are replaced, those of a query where it fails by ``fallback``'s.

    ``hits`` has qid, mcp_id, pos, score, name and description; a query's pool is a group of bounded size.
    """

    def run(pool: pa.Table) -> pa.Table:
        rows = pool.sort_by("pos").to_pylist()
        got = model_rerank(rows, rows[0]["query"], client, lambda _: []) if len(rows) > 1 else rows
        columns = [[r["qid"] for r in got], [r["mcp_id"] for r in got], [float(r["score"]) for r in got], list(range(len(got)))]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pool.schema.field("qid").type, pa.string(), pa.float64(), pa.int32()))], names=["qid", "mcp_id", "_score", "_pos"])

    ship(hits.sparkSession)
    kind = hits.schema["qid"].dataType.simpleString()
    asked = hits.select("qid", "mcp_id", "pos", "score", "name", "description").join(queries.select("qid", "query"), "qid")
    order = store(asked.groupBy("qid").applyInArrow(run, f"qid {kind}, mcp_id string, _score double, _pos int"), "order")
    told = hits.join(order, ["qid", "mcp_id"]).withColumn("score", F.col("_score")).withColumn("pos", F.col("_pos")).drop("_score", "_pos")
    return told.unionByName(fallback(hits.join(order.select("qid").distinct(), "qid", "left_anti")).select(*told.columns))


def embed_texts(df: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[tuple[int, list[float]]]], batch: int = 64) -> DataFrame:
    """key, vector from an embedding service that answers batches with (index, vector) in any order."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = []
            texts = frame["_t"].tolist()
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                got = dict(embed(some))
                if sorted(got) != list(range(len(some))):
                    raise ValueError("the service left out or repeated an index")
                out += [got[j] for j in range(len(some))]
            yield pd.DataFrame({"_k": frame["_k"], "vector": out})

    return df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInPandas(run, f"_k {kind}, vector array<float>").withColumnRenamed("_k", key)


def forward_call(row: dict, tool: str, arguments: dict, call: Callable[[str, str, str, dict], dict]) -> tuple[str, bool]:
    """Content and error flag of a tool call, by the first remote transport that answers."""
    last: Exception | None = None
    for t in row.get("transports") or []:
        kind = (t.get("type") or "").lower()
        kind = "streamable" if kind in ("streamable-http", "streamable", "http") else kind
        if not (t.get("url") or "").strip() or kind not in ("streamable", "sse"):
            continue
        try:
            got = call(kind, t["url"], tool, arguments)
        except Exception as error:  # noqa: BLE001  the next transport may answer
            last = error
            continue
        texts = [p.get("text", "") for p in got.get("content", []) if p.get("type") == "text"]
        out = ""
        for text in texts:
            out = f"{out}\n{text}" if out else text
        return out, bool(got.get("is_error"))
    if last:
        raise last
    raise ConnectionError("no remote transport")
