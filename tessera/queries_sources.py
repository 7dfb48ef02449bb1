"""Registered queries of sources, texts and small functions, and their DuckDB text.

Pages and files are made from the driver's tables and served or landed as the
outside world would have them; the sources then read them.
"""

from __future__ import annotations

import json
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread
from urllib.parse import parse_qs, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import remote
from .functions import scoring as S
from .functions import text as X
from .operators import encode, enrich, evaluate, points, resolve, usage
from .plans.cache import ResultCache, cache_key
from .plans.config import Config
from .queries import _EVAL, _FIRST, _KEYS, _TALLY, BM25, TF, TOP, _calls, _counts, _judged, _topk, _words, bm25_scores, query, r6, read, tf_scores, tooled
from .schema import normalized
from .scratch import new_path, ship, store, write_file
from .sources import fetch, pages
from .sources.catalogs import FileSource, MultiSource, RegistrySource, RepositorySource, load_golden, parsed_pages, registry_rows
from .sources.formats import OFFICIAL
from .streaming.usage import start_snapshots

# ---- sources


def _json_array(rows: DataFrame, path: str) -> str:
    """A file that holds one JSON array, which is what the file source reads."""
    every = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct(*rows.columns))).collect()]
    write_file(rows.sparkSession, path, json.dumps(every).encode())
    return path


def _supplier_file(spark, sf_dir) -> str:
    s = read(spark, sf_dir, "supplier").orderBy("s_suppkey")
    k = F.col("s_suppkey")
    rows = s.select(F.when(k % 2 == 0, F.concat(F.lit("s"), k)).alias("id"), F.col("s_name").alias("name"), F.when(k % 3 > 0, F.lit("file-x")).otherwise("").alias("source"), F.array(F.lit("a"), F.col("s_nationkey").cast("string")).alias("categories"), k.alias("popularity"))
    return _json_array(rows, f"{new_path(spark, 'file')}/catalogue.json")


@query("SELECT row_number() OVER (ORDER BY s_suppkey)::BIGINT AS place, CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey ELSE s_name END AS id, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN 'file-x' ELSE 'file' END AS source, 'a,' || s_nationkey AS categories, s_suppkey::BIGINT AS popularity, '' AS title, 0::BIGINT AS n_tools FROM supplier")
def file_source_rows(spark, sf_dir):
    """A JSON array as a catalogue: absent ids and sources get their defaults, absent values are empty."""
    rows = FileSource(_supplier_file(spark, sf_dir)).fetch(spark)
    return rows.select((F.col("pos").cast("bigint") + 1).alias("place"), "id", "name", "source", F.array_join("categories", ",").alias("categories"), "popularity", "title", F.size("tools").cast("bigint").alias("n_tools"))


def _registry(spark, sf_dir):
    """A registry that serves suppliers, two versions of each, in pages by cursor."""
    rows = read(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name", "s_nationkey").collect()
    entries = []
    for r in rows:
        for version in ("1", "2"):
            server = {"name": r["s_name"], "version": version, "description": f"from {r['s_nationkey']}", "repository": {"url": f"https://github.com/x/{r['s_suppkey']}"}, "websiteUrl": "https://x.org", "remotes": [{"type": "sse", "url": f"https://h/{r['s_suppkey']}"}], "packages": [{"registryType": "npm", "identifier": r["s_name"], "version": version, "transport": {"type": "stdio"}}], "unknown": 1}
            entries.append({"server": server, "_meta": {OFFICIAL: {"status": "active", "isLatest": version == "2", "updatedAt": f"2025-01-0{version}T00:00:00Z"}}})

    def get(url: str) -> tuple[int, bytes]:
        asked = parse_qs(urlparse(url).query)
        at, size = int(asked.get("cursor", ["0"])[0]), int(asked["limit"][0])
        more = at + size < len(entries)
        return 200, json.dumps({"servers": entries[at : at + size], "metadata": {"nextCursor": str(at + size) if more else "", "count": size}}).encode()

    return get


_REGISTERED = "SELECT s_name AS id, s_name AS name, '2' AS version, 'from ' || s_nationkey AS description, 'https://github.com/x/' || s_suppkey AS repository, 'https://x.org' AS homepage, 'sse https://h/' || s_suppkey AS remotes, 'npm ' || s_name || ' 2 stdio' AS packages, 'registry' AS source, '2025-01-02T00:00:00Z' AS \"updatedAt\" FROM supplier"


def _registered(rows: DataFrame) -> DataFrame:
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["type"], x["url"])), ",")
    pack = F.array_join(F.transform("packages", lambda p: F.concat_ws(" ", p["registryType"], p["identifier"], p["version"], p["transport"])), ",")
    return rows.select("id", "name", "version", "description", "repository", "homepage", flat("transports").alias("remotes"), pack.alias("packages"), "source", "updatedAt")


@query(_REGISTERED)
def registry_source_rows(spark, sf_dir):
    """Pages fetched by cursor and landed; of each server the latest version, as a catalogue row."""
    folder = new_path(spark, "registry")
    fetch.land(fetch.registry_pages(_registry(spark, sf_dir), "https://r"), folder, spark)
    return _registered(RegistrySource(folder).fetch(spark))


@contextmanager
def _served(spark, get):
    """The address at which the driver answers requests as ``get`` does."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, body = get(self.path)
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            return

    host = spark.conf.get("spark.driver.host", None) or "127.0.0.1"
    server = ThreadingHTTPServer((host, 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://{host}:{server.server_port}"
    finally:
        server.shutdown()
        server.server_close()


@query(_REGISTERED)
def registry_source_fetched(spark, sf_dir):
    """The same rows by the data source: executors fetch the pages by cursor from an address."""
    with _served(spark, _registry(spark, sf_dir)) as url:
        return _registered(store(RegistrySource(url).fetch(spark), "registry"))


@query(_REGISTERED)
def registry_source_streamed(spark, sf_dir):
    """And by its stream: each run takes the servers that are new; two runs give them all, once."""
    folder = new_path(spark, "registry-stream")
    pages.register(spark)
    with _served(spark, _registry(spark, sf_dir)) as url:
        for _ in range(2):
            rows = registry_rows(parsed_pages(spark.readStream.format("registry_pages").option("url", url).load()))
            rows.drop("pos").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(once=True).start().awaitTermination()
    return _registered(normalized(spark.read.parquet(f"{folder}/rows")))


@query(f"SELECT * FROM ({_REGISTERED}) ORDER BY id LIMIT 7")
def registry_source_limit(spark, sf_dir):
    """The limit is a feature of the source: the first latest versions in page order."""
    folder = new_path(spark, "registry")
    fetch.land(fetch.registry_pages(_registry(spark, sf_dir), "https://r", 7), folder, spark)
    return _registered(RegistrySource(folder).fetch(spark, 7))


def _repositories(spark, sf_dir):
    """A repository search over suppliers: two topic queries that overlap, one that fails, and descriptions of some."""
    rows = read(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name", "s_nationkey").collect()

    def item(r):
        k = r["s_suppkey"]
        return {"full_name": f"Own{r['s_nationkey']}/R{k}", "name": f"R{k}", "owner": {"login": f"Own{r['s_nationkey']}"}, "description": None if k % 4 == 0 else f"about {k}", "html_url": f"https://github.com/Own{r['s_nationkey']}/R{k}", "homepage": "", "topics": ["MCP", "Data", f"t{k % 3}", "data ", "ai"], "pushed_at": "2025-02-03T04:05:06Z", "stargazers_count": k, "default_branch": "" if k % 2 else "dev", "archived": k % 5 == 0}

    found = {"topic:mcp-server": [r for r in rows if r["s_suppkey"] % 3 < 2], "topic:mcp": [r for r in rows if r["s_suppkey"] % 3 > 0]}

    def get(url: str) -> tuple[int, bytes]:
        parts = urlparse(url)
        if not parts.path.startswith("/search"):
            k = int(parts.path.split("/")[2][1:])
            branch = "main" if k % 2 else "dev"
            if k % 7 or parts.path.split("/")[3] != branch:
                return 404, b""
            return 200, json.dumps({"name": f"io.x/{k}", "description": f"described {k}", "version": "3"}).encode()
        asked = parse_qs(parts.query)
        topic, _, below = asked["q"][0].partition(" stars:<")
        if topic not in found:
            return 500, b""
        page, size = int(asked["page"][0]), int(asked["per_page"][0])
        shown = [r for r in reversed(found[topic]) if not below or r["s_suppkey"] < int(below)]  # by stars
        some = shown[(page - 1) * size : page * size] if page * size <= 1000 else []  # a search shows 1,000 at most
        return 200, json.dumps({"total_count": len(shown), "items": [item(r) for r in some]}).encode()

    return get


@query("""SELECT CASE WHEN k % 7 = 0 THEN 'io.x/' || k ELSE 'io.github.own' || n || '/r' || k END AS id, CASE WHEN k % 7 = 0 THEN 'io.x/' || k ELSE 'io.github.own' || n || '/r' || k END AS name, 'R' || k AS title,
  CASE WHEN k % 7 = 0 THEN 'described ' || k WHEN k % 4 = 0 THEN '' ELSE 'about ' || k END AS description, CASE WHEN k % 7 = 0 THEN '3' ELSE '' END AS version, 'https://github.com/Own' || n || '/R' || k AS repository, '' AS homepage,
  'Data,t' || (k % 3) || ',data' AS categories, k::BIGINT AS popularity, '2025-02-03T04:05:06Z' AS "updatedAt", 'github' AS source FROM (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) WHERE k % 5 > 0""")
def repository_source_rows(spark, sf_dir):
    """Searches by topic, one of which fails; archived repositories go, doubles count once, descriptions overlay defaults."""
    get, folder = _repositories(spark, sf_dir), new_path(spark, "repositories")
    found = list(fetch.search_pages(get, "https://s"))
    fetch.land(iter(found), f"{folder}/pages", spark)
    fetch.land_descriptions(get, "https://raw", found, f"{folder}/described", spark)
    rows = RepositorySource(f"{folder}/pages", f"{folder}/described").fetch(spark)
    return rows.select("id", "name", "title", "description", "version", "repository", "homepage", F.array_join("categories", ",").alias("categories"), "popularity", "updatedAt", "source")


@query("""SELECT source, id FROM (SELECT 'file' AS source, id, place FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey ELSE s_name END AS id, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier) WHERE place <= 5)
  UNION ALL SELECT 'registry', s_name FROM (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier) WHERE place <= 5""")
def multi_source_union_limit(spark, sf_dir):
    """Several sources at once: the limit holds for each, and one that cannot be read is left out."""
    folder = new_path(spark, "registry")
    fetch.land(fetch.registry_pages(_registry(spark, sf_dir), "https://r"), folder, spark)
    broken = new_path(spark, "broken")
    write_file(spark, f"{broken}/x.parquet", b"no parquet")

    class Broken:
        name = "broken"

        def fetch(self, spark, limit=0):
            return spark.read.schema("pos string, id string").parquet(f"{broken}/x.parquet")

    many = MultiSource([FileSource(_supplier_file(spark, sf_dir)), Broken(), RegistrySource(folder)])
    rows = many.fetch(spark, 5)
    if set(many.failed) != {"broken"}:
        raise ValueError(f"failed: {many.failed}")
    return rows.select(F.when(F.col("source") == "registry", "registry").otherwise("file").alias("source"), "id")


@query("SELECT row_number() OVER (ORDER BY item_id)::BIGINT - 1 AS qid, text AS query, 'd' || item_id AS expected FROM benchmark")
def golden_rows(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").orderBy("item_id").select(F.col("text").alias("query"), F.array(F.concat(F.lit("d"), "item_id")).alias("expected"))
    return load_golden(spark, _json_array(b, f"{new_path(spark, 'golden')}/golden.json")).select("qid", "query", F.array_join("expected", ",").alias("expected"))


@query(f"WITH {_counts()}, {BM25} SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df)::BIGINT AS terms, (SELECT sum(df) FROM df)::BIGINT AS total FROM stats")
def stats_round_trip(spark, sf_dir):
    """Corpus statistics written and read back."""
    folder = new_path(spark, "stats")
    encode.save_stats(encode.term_counts(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", folder)
    stats, df = encode.load_stats(spark, folder)
    return stats.join(df.agg(F.count("*").alias("terms"), F.sum("df").alias("total"))).select("n", r6(F.col("avgdl")).alias("avgdl"), "terms", "total")  # two single rows


# ---- usage files


@query(_TALLY)
def usage_snapshot_resumed(spark, sf_dir):
    """A stream flushes snapshots; a restart reads the last one and goes on with later events."""
    folder = new_path(spark, "usage")
    schema = read(spark, sf_dir, "events").schema
    early = lambda e: _calls(e.where("event_id % 2 = 0"))
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    start_snapshots(early(events), f"{folder}/checkpoint", f"{folder}/state", once=True).awaitTermination()
    last = usage.load_snapshot(spark, f"{folder}/state")
    missing = usage.load_snapshot(spark, f"{folder}/nothing")
    later = usage.tally(_calls(read(spark, sf_dir, "events").where("event_id % 2 = 1")))
    return usage.merge_tallies(last, missing, later).select("mcp_id", "calls", "successes", "tool_errors")


# ---- texts


@query("SELECT doc_id, p_name || chr(10) || p_type || chr(10) || 'From MCP: doc-' || doc_id AS body FROM documents JOIN part ON p_partkey = doc_id")
def tool_texts(spark, sf_dir):
    t = tooled(spark, sf_dir).where(F.size("tools") > 0)
    return t.select("doc_id", X.tool_text(F.col("tools")[0], X.display_name(F.col("title"), F.col("name"))).alias("body"))


_CANDIDATE = rf"""SELECT doc_id, array_to_string(list_sort(list_distinct({_words("concat_ws(' ', 'doc-' || doc_id, text, phrase, asked, synonyms, lang, p_name, p_type)", X.RERANK_STOP)})), ' ') AS terms
  FROM (SELECT doc_id, text, lang, p_name, p_type, phrase, concat_ws(' ', CASE WHEN phrase <> '' THEN 'how do I ' || phrase || ' I need to ' || phrase END, {_FIRST}) AS asked,
    (SELECT array_to_string({_KEYS}, ' ') FROM (SELECT 'doc-' || d.doc_id || ' ' || d.text AS text)) AS synonyms
    FROM (SELECT *, lower(trim(regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) AS phrase FROM documents LEFT JOIN part ON p_partkey = doc_id) d)"""


@query(_CANDIDATE)
def candidate_terms(spark, sf_dir):
    """What reranking matches: terms of title, description, card and tools."""
    c = enrich.enrich(tooled(spark, sf_dir))
    return c.select("doc_id", F.array_join(F.sort_array(X.term_set(X.candidate_text(F.col))), " ").alias("terms"))


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END), ''), CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END) AS found FROM customer")
def first_non_blank(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", X.first_of(F.when(k % 3 == 0, "  ").otherwise(F.col("c_mktsegment")), F.when(k % 2 == 0, "").otherwise(F.col("c_name"))).alias("found"))


@query("SELECT n_nationkey, list_aggregate(list_transform([n_regionkey, n_nationkey], lambda x: x::VARCHAR), 'string_agg', ',') AS kept FROM nation")
def useful_topics(spark, sf_dir):
    """Generic topics go whatever their letter case, others keep theirs."""
    n = read(spark, sf_dir, "nation")
    topics = F.array(F.lit("MCP"), F.col("n_regionkey").cast("string"), F.lit("Ai"), F.lit("mcp-Server"), F.col("n_nationkey").cast("string"))
    return n.select("n_nationkey", F.array_join(X.useful_topics(topics), ",").alias("kept"))


@query("SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'b' ELSE '' END AS content FROM events")
def text_parts_joined(spark, sf_dir):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.lit("")), part("text", F.col("event_type")), part("image", F.lit("x")), F.struct(F.when(F.col("event_id") % 2 == 0, "text").otherwise("audio").alias("type"), F.lit("b").alias("text")))
    return read(spark, sf_dir, "events").select("event_id", S.text_content(parts).alias("content"))


@query("SELECT page_id, CASE WHEN page_id % 7 = 6 THEN 'none' WHEN page_id % 5 < 3 THEN 'streamable' WHEN page_id % 5 = 3 THEN 'sse' ELSE 'none' END AS kind FROM pages")
def client_transports(spark, sf_dir):
    p, k = read(spark, sf_dir, "pages"), F.col("page_id")
    names = F.array(*map(F.lit, ("Streamable-HTTP", "streamable", "http", "SSE", "stdio")))
    return p.select("page_id", S.client_transport(F.get(names, (k % 5).cast("int")), F.when(k % 7 == 6, "  ").otherwise(F.col("url"))).alias("kind"))


@query("SELECT doc_id, doc_id % 2 = 0 AS empty FROM documents")
def empty_cards(spark, sf_dir):
    """A card is empty when all it holds is who made it."""
    c = enrich.enrich(tooled(spark, sf_dir))
    bare = F.struct(*[(F.lit("") if n in ("summary", "enricher") else F.array().cast("array<string>")).alias(n) for n in ("summary", "tasks", "exampleQueries", "synonyms", "categories", "enricher")])
    return c.withColumn("enrichment", F.when(F.col("doc_id") % 2 == 0, bare).otherwise(F.col("enrichment"))).select("doc_id", enrich.is_empty(F.col("enrichment")).alias("empty"))


# ---- small rules over grids

_GIVEN = "l_discount::DOUBLE * 20 - 0.5::DOUBLE AS t, l_tax::DOUBLE * 20 - 0.5::DOUBLE AS u, l_quantity::DOUBLE / 25 AS c"


@query(f"""WITH g AS (SELECT l_orderkey, l_linenumber, {_GIVEN} FROM lineitem),
  k AS (SELECT *, least(1, greatest(0, t))::DOUBLE AS x, least(1, greatest(0, u))::DOUBLE AS y, least(1, greatest(0, c))::DOUBLE AS z FROM g)
SELECT l_orderkey, l_linenumber, round(x / greatest(1, x + y + z), 6) AS wt, round(y / greatest(1, x + y + z), 6) AS wu, round(z / greatest(1, x + y + z), 6) AS wc FROM k""")
def clamped_weights(spark, sf_dir):
    """Weights of any size, here from line items, within [0, 1] and together at most 1."""
    number = lambda c: F.col(c).cast("double")
    w = S.clamped(number("l_discount") * 20 - 0.5, number("l_tax") * 20 - 0.5, number("l_quantity") / 25)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[r6(c).alias(n) for n, c in zip(("wt", "wu", "wc"), w)])


def _each(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` of each row's values, in the tasks of ``df``; ``schema``: the first column, which stays, and what the function gives."""
    ship(df.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        for frame in frames:
            rows = [(v[0], *function(*v[1:])) for v in frame.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


@query("""WITH e AS (SELECT event_id, event_id % 256 AS a, coalesce(user_id, 0) % 256 AS b, event_id % 4 AS kind FROM events),
  v AS (SELECT *, a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR a BETWEEN 224 AND 239 AS inside FROM e)
SELECT event_id, CASE kind WHEN 0 THEN inside WHEN 1 THEN inside WHEN 2 THEN true ELSE false END AS blocked FROM v""")
def blocked_addresses(spark, sf_dir):
    """Addresses, one for each event, that a probe refuses when a name resolves to them."""
    i = F.col("event_id")
    four = F.concat_ws(".", i % 256, F.coalesce("user_id", F.lit(0)) % 256, F.lit("1.2"))
    kind = i % 4
    address = F.when(kind == 0, four).when(kind == 1, F.concat(F.lit("::ffff:"), four)).when(kind == 2, F.concat(F.lit("fe80::"), i % 1000)).otherwise(F.concat(F.lit("2001:4860::"), i % 1000))

    def refused(address: str) -> tuple[bool]:
        try:
            return (remote.guarded(lambda host: [address])("host") != address,)
        except PermissionError:
            return (True,)

    return _each(read(spark, sf_dir, "events").select("event_id", address.alias("address")), refused, "event_id long, blocked boolean")


_STATUS = (200, 204, 301, 400, 404, 429, 500, 501, 502, 503, 504)


@query(f"""SELECT event_id, CASE WHEN s IN (429, 500, 502, 503, 504) THEN 4 ELSE 1 END::BIGINT AS attempts, CASE WHEN s = 429 THEN 3.0 * (event_id % 7) WHEN s IN (500, 502, 503, 504) THEN 3.5 ELSE 0 END::DOUBLE AS waited
  FROM (SELECT event_id, {list(_STATUS)}[event_id % 11 + 1] AS s FROM events)""")
def retried_answers(spark, sf_dir):
    """How often an answer, one for each event, is asked for again, and how long that waits; a server may say how long."""

    def asked(status: int, told: int) -> tuple[int, float]:
        sent, waits = [], []
        remote.with_retries(lambda: (sent.append(1), (status, {"Retry-After": str(told)} if status == 429 else {}, b""))[1], sleep=waits.append)
        return len(sent), float(sum(waits))

    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (i % 11 + 1).cast("int"))
    return _each(read(spark, sf_dir, "events").select("event_id", status.alias("status"), (i % 7).cast("int").alias("told")), asked, "event_id long, attempts long, waited double")


@query("SELECT item_id, text || chr(0) || (item_id % 9) || chr(0) || CASE item_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '0.25' ELSE '0.5' END || chr(0) || 'file' || chr(0) || 'a,b' AS key FROM benchmark")
def cache_keys(spark, sf_dir):
    i = F.col("item_id")
    asked = read(spark, sf_dir, "benchmark").select("item_id", "text", (i % 9).cast("int").alias("top_k"), ((i % 3) / 4).alias("least"))
    return _each(asked, lambda text, top_k, least: (cache_key(text, top_k, least, "file", ["b", "a"]),), "item_id long, key string")


@query("SELECT item_id, item_id >= (SELECT max(item_id) FROM benchmark) - 4 AS kept FROM benchmark")
def cache_evictions(spark, sf_dir):
    """Entries in order of use: the oldest go first, and none outlives its time."""
    now = [0.0]
    cache = ResultCache(5, 60.0, lambda: now[0])
    ids = [r[0] for r in read(spark, sf_dir, "benchmark").select("item_id").orderBy("item_id").collect()]
    for i in ids:
        cache.put(str(i), [i])
    kept = {i: cache.get(str(i)) == [i] for i in ids}
    now[0] = 61.0
    if any(cache.get(str(i)) for i in ids):
        raise ValueError("an entry outlived its time")
    return spark.createDataFrame(list(kept.items()), "item_id bigint, kept boolean")


@query("""SELECT s_suppkey AS k, [1, 1, 2, 1, 0][s_suppkey % 5 + 1]::BIGINT AS sources, CASE WHEN s_suppkey % 3 = 0 THEN 30 ELSE s_suppkey % 100 END::BIGINT AS pool, s_suppkey % 2 = 0 AS hybrid FROM supplier""")
def settings_read(spark, sf_dir):
    """Settings from environments, one for each supplier; values that cannot be read leave the default, unknown sources are errors."""

    def found(source: str, pool: str, hybrid: str) -> tuple[int, int, bool]:
        from .cli import sources

        config = Config.read({"SOURCE": source, "RERANK_POOL": pool, "HYBRID": hybrid})
        try:
            n = len(sources(config, dict.fromkeys(("file", "registry", "github"), "path")).sources)
        except ValueError:
            n = 0
        return n, config.rerank_pool, config.hybrid

    k = F.col("s_suppkey")
    source = F.element_at(F.array(*map(F.lit, ("", "file", "file, registry,", "github", "x,file"))), (k % 5 + 1).cast("int"))
    asked = read(spark, sf_dir, "supplier").select(k.alias("k"), source.alias("s"), F.when(k % 3 == 0, "many").otherwise((k % 100).cast("string")).alias("p"), F.when(k % 2 == 0, " Yes").otherwise("off").alias("h"))
    return _each(asked, found, "k long, sources long, pool long, hybrid boolean")


# ---- encodings and their fallbacks


@query(f"WITH {_counts()}, {TF}, {_topk('hits', 'qw', 'dw', TOP)} SELECT qid, id AS doc_id, (pos + 1)::BIGINT AS rank, round(score, 6) AS score FROM hits")
def bm25_without_stats(spark, sf_dir):
    """BM25 without statistics of any text falls back to term frequencies."""
    folder = new_path(spark, "stats")
    encode.save_stats(encode.term_counts(read(spark, sf_dir, "documents").limit(0), "doc_id", "text"), "doc_id", folder)
    stats = encode.load_stats(spark, folder)[0]
    hits = bm25_scores(spark, sf_dir, TOP) if encode.chosen("bm25", stats) == "bm25" else tf_scores(spark, sf_dir, TOP)
    return hits.select("qid", "doc_id", (F.col("pos") + 1).cast("bigint").alias("rank"), r6(F.col("score")).alias("score"))


@query(f"WITH {_counts()}, {BM25}, {_topk('hits', 'bq', 'bd', TOP)} SELECT qid, id AS doc_id, (pos + 1)::BIGINT AS rank, round(score, 6) AS score FROM hits")
def bm25_odd_parameters(spark, sf_dir):
    """Parameters out of their range are replaced by the defaults."""
    hits = bm25_scores(spark, sf_dir, TOP, k1=-1.0, b=2.0)
    return hits.select("qid", "doc_id", (F.col("pos") + 1).cast("bigint").alias("rank"), r6(F.col("score")).alias("score"))


# ---- identity and evaluation


@query("""WITH g AS (SELECT n_regionkey AS r, n_nationkey AS k, n_name FROM nation),
 t AS (SELECT r, k, 'sse|https://h/' || (k % 3) AS key FROM g), f AS (SELECT r, key, min(k) AS k FROM t GROUP BY ALL)
SELECT r AS region, string_agg('SSE https://H/' || (k % 3), ',' ORDER BY k) AS transports, count(*)::BIGINT AS packages, count(*)::BIGINT AS tools FROM f GROUP BY r""")
def dedup_union_keyed(spark, sf_dir):
    """Lists of a group by key: the first of each transport, package and tool stays, whatever its letter case."""
    n = read(spark, sf_dir, "nation")
    k = (F.col("n_nationkey") % 3).cast("string")
    ways = F.array(F.struct(F.lit("SSE").alias("type"), F.concat(F.lit("https://H/"), k).alias("url")), F.struct(F.lit("sse").alias("type"), F.concat(F.lit("https://h/"), k).alias("url")))
    packages = F.array(F.struct(F.lit("NPM").alias("registryType"), k.alias("identifier"), F.lit("1").alias("version"), F.lit("").alias("transport")))
    rows = n.select(F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("pos"), F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("name"), ways.alias("transports"), packages.alias("packages"), F.array(F.struct(k.alias("name"), F.lit("d").alias("description"))).alias("tools"), F.lit("file").alias("source"))
    out = resolve.dedup(normalized(rows, "pos"))
    return out.select(F.regexp_extract("name", r"\d+", 0).cast("int").alias("region"), F.array_join(F.transform("transports", lambda t: F.concat_ws(" ", t["type"], t["url"])), ",").alias("transports"), F.size("packages").cast("bigint").alias("packages"), F.size("tools").cast("bigint").alias("tools"))


@query(f"WITH {_EVAL}, r AS (SELECT count(*) AS n, avg((rank = 1)::INT) AS h, avg(recall) AS c, avg(rr) AS m, avg(ndcg) AS g FROM per) SELECT printf('n=%d Hit@1=%.3f Recall@{TOP}=%.3f MRR=%.3f nDCG@{TOP}=%.3f', n, h, c, m, g) AS line FROM r")
def eval_scorecard(spark, sf_dir):
    row = evaluate.report(_judged(spark, sf_dir)[2]).first()
    return spark.createDataFrame([(evaluate.scorecard(row, TOP),)], "line string")


# ---- the point table


@query("SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 10 = 0")
def point_lookup(spark, sf_dir):
    """Full rows by id; ids that nothing has are left out."""
    c = read(spark, sf_dir, "customer")
    wanted = c.where("c_custkey % 10 = 0").select(F.col("c_custkey").cast("string").alias("id")).unionByName(spark.createDataFrame([("none",), ("-1",)], "id string"))
    rows = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return points.lookup(rows, wanted).select("key", "name")


@query("SELECT unnest([len(embedding)::INT, len(embedding)::INT - 1, 1]) AS dim, unnest([true, false, false]) AS accepted FROM (SELECT embedding FROM embeddings LIMIT 1)")
def dimension_check(spark, sf_dir):
    """A table of vectors of another length than asked for is an error."""
    e = read(spark, sf_dir, "embeddings")
    have = e.select(F.size("embedding").alias("n")).first()["n"]
    rows = []
    for dim in (have, have - 1, 1):
        try:
            points.ensure_dimension(e, "embedding", dim)
            rows.append((dim, True))
        except ValueError:
            rows.append((dim, False))
    return spark.createDataFrame(rows, "dim int, accepted boolean")
