import json
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.operators import enrich, evaluate, points, rank, resolve, usage
from tessera.plans import index as I
from tessera.plans.cache import ResultCache, cache_key
from tessera.plans.config import Config
from tessera.plans.search import search
from tessera.plans.service import Discovery
from tessera.schema import CATALOG, QUERIES, normalized
from tessera.sources.catalogs import FileSource, MultiSource, RegistrySource, RepositorySource, load_golden
from tessera.streaming.usage import start_snapshots, start_tally

ROWS = [
    {"name": "mail", "title": "Mail", "description": "Send and read electronic mail.", "categories": ["communication"], "tools": [{"name": "send_email", "description": "Send an email to a customer. Fast."}]},
    {"name": "sql-db", "title": "Tables", "description": "Query relational databases.", "categories": ["database"], "tools": [{"name": "run_query", "description": "Execute a statement and return rows."}, {"name": "--", "description": "nameless"}]},
    {"name": "weather", "title": "", "description": "Forecasts for any place", "categories": ["weather"], "tools": []},
]


@pytest.fixture(scope="module")
def catalog_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "rows.json"
    path.write_text(json.dumps(ROWS))
    return str(path)


@pytest.fixture(scope="module")
def index(spark, catalog_file, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    I.build(FileSource(catalog_file).fetch(spark), as_of="2026-01-01T00:00:00Z").save(path)
    return I.Index.load(spark, path, 256)


def frame(spark, rows):
    return normalized(spark.createDataFrame([tuple(r.get(n) for n in ("id", "name", "title", "repository", "source", "popularity", "pos")) for r in rows], "id string, name string, title string, repository string, source string, popularity bigint, pos string"), "pos")


def test_file_source(spark, catalog_file):
    got = FileSource(catalog_file).fetch(spark, 2).orderBy("pos").collect()
    assert [(r["id"], r["source"]) for r in got] == [("mail", "file"), ("sql-db", "file")]
    assert got[0]["transports"] == [] and got[0]["version"] == ""


def test_lines_of_json(spark, tmp_path):
    """One row on each line, in splits; lines that are none are left out."""
    rows = [{"id": f"i{k}", "name": f"n{k}", "categories": ["a"], "tools": [{"name": "t", "description": "d" * 50}]} for k in range(300)]
    lines = [json.dumps(r) for r in rows]
    lines[7:7] = ["", "no json", "{}", '{"name": "named"}']
    for name, part in (("a", lines[:200]), ("b", lines[200:])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(part) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = FileSource(f"{tmp_path}/*.jsonl").fetch(spark)
        assert found.rdd.getNumPartitions() > 4
        got = [(r["id"], r["source"], len(r["tools"])) for r in found.orderBy("pos").collect()]
        first = [r["id"] for r in FileSource(f"{tmp_path}/*.jsonl").fetch(spark, 9).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    want = [r["id"] for r in rows]
    want[7:7] = ["named"]
    assert [g[0] for g in got] == want and first == want[:9] and got[7] == ("named", "file", 0) and got[8] == ("i7", "file", 1)


def test_registry_and_repositories(spark, tmp_path):
    meta = "io.modelcontextprotocol.registry/official"
    page = {"servers": [{"server": {"name": "a", "repository": {"url": "u"}, "remotes": [{"type": "sse", "url": "x"}]}, "_meta": {meta: {"isLatest": True, "updatedAt": "t"}}}, {"server": {"name": "old"}, "_meta": {meta: {"isLatest": False}}}], "metadata": {"nextCursor": ""}}
    (tmp_path / "p1.json").write_text(json.dumps(page))
    got = RegistrySource(str(tmp_path / "p1.json")).fetch(spark).collect()
    assert [(r["id"], r["repository"], r["updatedAt"], r["transports"][0]["type"]) for r in got] == [("a", "u", "t", "sse")]
    item = {"full_name": "Acme/Find", "name": "Find", "owner": {"login": "Acme"}, "html_url": "h", "topics": ["mcp", "Search"], "pushed_at": "t", "stargazers_count": 7, "archived": False}
    (tmp_path / "s1.json").write_text(json.dumps({"query_idx": 0, "items": [item, item | {"full_name": "x/y", "archived": True}]}))
    (tmp_path / "s2.json").write_text(json.dumps({"query_idx": 1, "items": [item]}))
    (r,) = RepositorySource(str(tmp_path / "s*.json")).fetch(spark).collect()
    assert (r["id"], r["title"], r["categories"], r["popularity"]) == ("io.github.acme/find", "Find", ["Search"], 7)
    many = MultiSource([RegistrySource(str(tmp_path / "p1.json")), FileSource(str(tmp_path / "absent"))])
    assert many.fetch(spark).count() == 1 and "file" in many.failed


def test_golden(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"query": "q", "expected": ["a"]}]')
    assert [tuple(r) for r in load_golden(spark, str(tmp_path / "g.json")).collect()] == [(0, "q", ["a"])]


def test_one_identity_becomes_one_row(spark):
    rows = [{"id": "1", "name": "Acme/Search", "title": "from github", "source": "github", "popularity": 9, "pos": "0"}, {"id": "2", "name": "acme/search", "title": " ", "source": "registry", "popularity": 1, "pos": "1"}, {"id": "3", "name": "other", "source": "file", "popularity": 0, "pos": "2"}]
    got = {r["id"]: r for r in resolve.dedup(frame(spark, rows)).collect()}
    assert set(got) == {"2", "3"}
    assert (got["2"]["title"], got["2"]["popularity"], got["2"]["sources"]) == ("from github", 9, ["registry", "github"])
    assert got["3"]["sources"] == []


def test_one_identity_may_have_any_share_of_the_rows(spark):
    """200,000 rows of one identity: no task gets them all, and the first of every value wins as in a small group."""
    n = 200_000
    i = F.col("id")
    rows = spark.range(n).select(
        F.lpad(i.cast("string"), 9, "0").alias("pos"), i.cast("string").alias("id"), F.lit("Same").alias("name"), F.when(i % 3 == 0, "registry").otherwise("file").alias("source"), F.when(i > 5, F.concat(F.lit("d"), i)).otherwise(" ").alias("description"),
        F.array(F.concat(F.lit("c"), (i % 4).cast("string")), F.lit(" ")).alias("categories"), F.array(F.struct(F.concat(F.lit("t"), (i % 3).cast("string")).alias("name"), i.cast("string").alias("description"))).alias("tools"), (i % 1000).alias("popularity"),
    ).repartition(8)
    other = spark.createDataFrame([("x", "alone", "file")], "id string, name string, source string").withColumn("pos", F.lit("9"))
    got = {r["name"]: r for r in resolve.dedup(normalized(rows, "pos").unionByName(normalized(other, "pos"))).collect()}
    same = got["Same"]
    assert (same["id"], same["description"], same["popularity"], same["sources"]) == ("0", "d6", 999, ["registry", "file"])
    assert same["categories"] == ["c0", "c3", "c2", "c1"] and [(t["name"], t["description"]) for t in same["tools"]] == [("t0", "0"), ("t1", "1"), ("t2", "2")]
    assert got["alone"]["sources"] == [] and got["alone"]["pos"] == "9"
    plan = resolve.merge_groups(normalized(rows, "pos").withColumn("key", F.lit("k")))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(_o" not in plan


def test_cards(spark, catalog_file):
    got = {r["id"]: r["enrichment"] for r in enrich.enrich(FileSource(catalog_file).fetch(spark)).collect()}
    assert got["mail"]["tasks"] == ["send email"]
    assert got["mail"]["exampleQueries"] == ["how do I send email", "I need to send email", "Send an email to a customer", "Send and read electronic mail", "Mail"]
    assert got["sql-db"]["tasks"] == ["run query"]


def test_points_and_their_upkeep(spark, index):
    kinds = {r["kind"]: r["count"] for r in index.points.groupBy("kind").count().collect()}
    assert kinds["server"] == 3 and kinds["tool"] == 3
    again = I.refresh(index, index)
    assert again.points.count() == index.points.count() and again.terms.count() == index.terms.count() and again.catalog.count() == 3
    gone = spark.createDataFrame([("mail",)], "mcp_id string")
    assert points.delete_by_parent(index.points, gone).where("mcp_id = 'mail'").count() == 0
    assert [r["category"] for r in points.category_facet(index.catalog).collect()] == ["communication", "database", "weather"]


def queries(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], QUERIES)


@pytest.mark.parametrize("sparse", ["tf", "bm25"])
def test_search(spark, catalog_file, sparse):
    config = Config(sparse=sparse)
    built = I.build(FileSource(catalog_file).fetch(spark), config).persist()
    batch = queries(spark, ("send an email", 5, 0.0, [], ""), ("execute sql statement", 2, 0.0, [], ""), ("the of", 5, 0.0, [], ""), ("email", 5, 0.0, ["database"], ""), ("email", 5, 0.0, [], "registry"))
    got = [r for r in search(batch, built, config).orderBy("qid", "rank").collect()]
    by = {q: [r["id"] for r in got if r["qid"] == q] for q in range(5)}
    assert by[0][0] == "mail" and by[1][0] == "sql-db" and len(by[1]) == 2
    assert set(by[3]) == {"sql-db"} and by[4] == []
    alone = [r["id"] for r in search(queries(spark, ("send an email", 5, 0.0, [], "")), built, config).orderBy("rank").collect()]
    assert alone == by[0]


def test_cut_is_single_precision(spark):
    hits = spark.createDataFrame([(1, 0, 0.7), (1, 1, 0.6)], "qid int, pos int, confidence double").withColumn("confidence", F.col("confidence").cast("float"))
    assert rank.cut(hits, F.lit(0.7), F.lit(5)).count() == 0
    assert rank.cut(hits, F.lit(0.6), F.lit(5)).count() == 2


def test_blend(spark):
    rows = [("strong", 0, 1.0, 1, 0.0), ("trusted", 1, 0.3, 1, 1.0), ("filler", 2, 0.1, 1, 0.0)]
    hits = spark.createDataFrame([(1, *r, 0.0) for r in rows], "qid int, id string, pos int, score double, match_count int, trust double, usage double")
    order = lambda **w: [r["id"] for r in rank.blend(hits, **w).orderBy("pos").collect()]
    assert order()[0] == "strong"
    assert order(trust_weight=0.9)[0] == "trusted"
    assert order(trust_weight=0, usage_weight=0, coverage_weight=0) == ["strong", "trusted", "filler"]


def test_metrics(spark):
    golden = spark.createDataFrame([(0, "a", ["x"]), (1, "b", ["y"]), (2, "c", ["z"])], "qid bigint, query string, expected array<string>")
    ranked = spark.createDataFrame([(0, 1, "x"), (1, 1, "x"), (1, 2, "y"), (2, 1, "x")], "qid bigint, rank int, id string")
    rows = evaluate.per_query(golden, ranked, 3)
    report = evaluate.report(rows).first()
    assert report["hit_at_1"] == pytest.approx(1 / 3) and report["recall_at_k"] == pytest.approx(2 / 3) and report["mrr"] == pytest.approx(0.5)
    assert report["ndcg_at_k"] == pytest.approx((1 + 1 / 1.584962500721156) / 3)
    assert [(r["query"], r["returned"]) for r in evaluate.misses(golden, rows, ranked).collect()] == [("c", ["x"])]
    assert evaluate.report(rows.limit(0)).first()["mrr"] == 0.0


def test_usage_batch_and_stream(spark, tmp_path):
    events = spark.createDataFrame([("good", "success")] * 5 + [("bad", "unreachable")] * 5 + [("", "success"), (None, "success")], "mcp_id string, outcome string")
    batch = {r["mcp_id"]: tuple(r)[1:] for r in usage.tally(events).collect()}
    assert batch == {"good": (5, 5, 0), "bad": (5, 0, 0)}
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    start_tally(stream, str(tmp_path / "ck"), "tallied", once=True).awaitTermination()
    assert {r["mcp_id"]: tuple(r)[1:] for r in spark.table("tallied").collect()} == batch
    both = usage.merge_tallies(usage.tally(events), usage.tally(events))
    assert {r["mcp_id"]: r["calls"] for r in both.collect()} == {"good": 10, "bad": 10}


def test_usage_stream_goes_on_after_a_restart(spark, tmp_path):
    """Two runs over growing input: the tallies equal the batch's, and a batch writes the items that it changed alone."""
    land = lambda n, rows: spark.createDataFrame(rows, "mcp_id string, outcome string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    go = lambda: start_snapshots(spark.readStream.schema("mcp_id string, outcome string").parquet(f"{tmp_path}/in/*"), f"{tmp_path}/ck", f"{tmp_path}/out", once=True).awaitTermination()
    land(1, [(f"i{k % 50}", "success") for k in range(200)])
    go()
    land(2, [("i7", "tool_error"), ("new", "unreachable")])
    go()
    every = usage.tally(spark.read.schema("mcp_id string, outcome string").parquet(f"{tmp_path}/in/*"))
    assert sorted(map(tuple, usage.load_snapshot(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, every.collect()))
    written = spark.read.parquet(f"{tmp_path}/out").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in written] == [50, 2]


def test_tallies_are_flushed_by_time(spark, index, tmp_path):
    """Without a further call."""
    service = Discovery(spark, index, Config(usage_path=f"{tmp_path}/usage.json"), lambda *_: ("", False), flush_seconds=0.2)
    service._record("mail", "success")
    for _ in range(100):
        if (tmp_path / "usage.json").exists():
            break
        time.sleep(0.1)
    service.close()
    assert json.loads((tmp_path / "usage.json").read_text()) == {"mail": {"calls": 1, "successes": 1, "tool_errors": 0}}
    assert not service.flush()


def test_service(spark, index):
    calls = []

    def call(row, tool, arguments):
        calls.append(row["id"])
        if tool == "down":
            raise ConnectionError("refused")
        return "done", tool == "broken"

    s = Discovery(spark, index, call=call)
    assert s.search("send an email")[0]["id"] == "mail" and s.search("send an email") == s.search("send an email")
    with pytest.raises(ValueError, match="empty"):
        s.search("")
    assert s.details("mail")["found"] and s.details("MAIL")["record"]["id"] == "mail"
    unknown = s.call_tool("send email", "x", {})
    assert not unknown["found"] and unknown["suggestions"] and not calls
    assert s.call_tool("Mail", "send_email", {})["content"] == "done" and s.call_tool("mail", "broken", {})["is_error"]
    with pytest.raises(ConnectionError):
        s.call_tool("mail", "down", {})
    assert s.snapshot() == {"mail": {"calls": 3, "successes": 1, "tool_errors": 1}}
    assert s.categories() == ["communication", "database", "weather"]


def test_calls_at_the_same_time_are_one_plan(spark, index, monkeypatch):
    from tessera.plans import service as own

    alone, plans = Discovery(spark, index), []
    asked = ["send an email", "find a route", "read mail", "draw a map"]
    want = {q: alone.search(q) for q in asked}
    plain = own.search
    monkeypatch.setattr(own, "search", lambda queries, *rest: plans.append(1) or plain(queries, *rest))
    service = Discovery(spark, index)
    with ThreadPoolExecutor(100) as pool:
        got = list(pool.map(lambda i: (asked[i % 4], service.search(asked[i % 4], categories=[] if i % 8 < 4 else None)), range(100)))
    assert all(hits == want[q] for q, hits in got) and len(plans) <= 4

    failing = own.Together(lambda items: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failing(1)
    with pytest.raises(ValueError):
        own.Together(lambda items: [])(1)
    lists = []
    small = own.Together(lambda items: lists.append(len(items)) or [x + 1 for x in items], most=7)
    with ThreadPoolExecutor(50) as pool:
        assert list(pool.map(small, range(50))) == list(range(1, 51))
    assert max(lists) <= 7 and sum(lists) == 50


def rows_scanned(df):
    """Rows that the scans of a finished plan gave, after row groups were left out."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if name.startswith("Scan"):
            found += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if hasattr(node, "plan") and "QueryStage" in name:
            todo.append(node.plan())
    return found


def test_lookups_read_few_row_groups(spark, tmp_path):
    """By sorted order for sources, by Bloom filters for ids, by a table of their own for categories."""
    i, n = F.col("id"), 200_000
    rows = spark.range(n).select(F.sha1(i.cast("string")).alias("point_id"), F.concat(F.lit("m"), i % 5000).alias("mcp_id"), F.concat(F.lit("s"), i % 8).alias("source"), F.array(F.concat(F.lit("c"), i % 50)).alias("categories"), F.lit(0).alias("ordinal"))
    points.write_for_lookups(rows, f"{tmp_path}/points", ["source", "mcp_id"], ["point_id", "mcp_id"], row_group=256 << 10)
    points.write_for_lookups(points.categories_of(rows), f"{tmp_path}/categories", ["category"], [], row_group=64 << 10)
    saved, by = spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/categories")
    assert rows_scanned(saved) == n
    source = saved.where("source = 's3'")
    assert source.count() == n // 8 and rows_scanned(source) < n / 3
    one = saved.where(F.col("point_id") == F.sha1(F.lit("77")))
    assert [r["mcp_id"] for r in one.collect()] == ["m77"] and rows_scanned(one) < n / 4
    assert rows_scanned(by.where("category = 'c7'")) < n / 4
    found = points.having(saved, by, ["c7", "c8"])
    assert found.count() == 2 * n // 50


def test_cache():
    now = [0.0]
    c = ResultCache(2, 10, lambda: now[0])
    c.put("a", [1]), c.put("b", []), c.get("a"), c.put("c", [3])
    assert c.get("b") is None and c.get("a") == [1] and c.get("c") == [3]
    c.get("a").append(2)
    assert c.get("a") == [1]
    now[0] = 11
    assert c.get("a") is None
    off = ResultCache(0, 10)
    off.put("a", [1])
    assert off.get("a") is None
    assert cache_key("q", 5, 0.5, "s", ["b", "a"]) == cache_key("q", 5, 0.5, "s", ["a", "b"]) != cache_key("q", 5, 0.5, "s", [])


def test_config():
    c = Config.read({"EMBED_DIM": "64", "HYBRID": "false", "TRUST_WEIGHT": "x", "SOURCE": "file, registry"})
    assert (c.embed_dim, c.hybrid, c.trust_weight, c.sources) == (64, False, 0.15, ["file", "registry"])
    with pytest.raises(ValueError, match="reranker"):
        Config(reranker="other")
    assert len(CATALOG) > 0
