import json
from urllib.parse import parse_qs, urlparse

import pytest

from tessera import cli
from tessera.operators import usage
from tessera.plans.config import Config
from tessera.plans.service import tools
from tessera.sources import fetch
from tessera.sources.catalogs import OFFICIAL, RegistrySource

ROWS = [{"name": "mail", "title": "Mail", "description": "Send mail.", "tools": [{"name": "send_email", "description": "Send an email."}]}, {"name": "maps", "title": "Maps", "description": "Find a route.", "tools": []}]


def entry(name, latest=True):
    return {"server": {"name": name}, "_meta": {OFFICIAL: {"isLatest": latest, "updatedAt": "t"}}}


def test_registry_pages(spark, tmp_path):
    pages = {"": ([entry("a"), entry("b", False)], "n1"), "n1": ([entry("c")], "n2"), "n2": ([entry("d")], "")}

    def get(url):
        cursor = url.partition("cursor=")[2]
        servers, following = pages[cursor]
        return 200, json.dumps({"servers": servers, "metadata": {"nextCursor": following}}).encode()

    assert len(list(fetch.registry_pages(get, "http://r"))) == 3
    assert len(list(fetch.registry_pages(get, "http://r", limit=2))) == 2
    with pytest.raises(ConnectionError):
        list(fetch.registry_pages(lambda u: (500, b""), "http://r"))
    assert fetch.land(fetch.registry_pages(get, "http://r"), str(tmp_path)) == 3
    assert [r["id"] for r in RegistrySource(str(tmp_path)).fetch(spark).orderBy("pos").collect()] == ["a", "c", "d"]
    assert [r["id"] for r in RegistrySource(str(tmp_path)).fetch(spark, 2).orderBy("pos").collect()] == ["a", "c"]


def test_search_pages():
    full = [{"full_name": f"o/{i}"} for i in range(100)]

    def get(url):
        if "q=bad" in url:
            return 503, b""
        return 200, json.dumps({"items": full if "page=1" == url[-6:] else full[:3]}).encode()

    got = list(fetch.search_pages(get, "http://s", ("good", "bad", "more")))
    assert [(p["query_idx"], len(p["items"])) for p in got] == [(0, 100), (0, 3), (2, 100), (2, 3)]
    assert fetch.server_description(lambda u: (404, b""), "http://raw", "o/r") is None
    assert fetch.server_description(lambda u: (200, b'{"name": "x"}'), "http://raw", "o/r") == {"name": "x"}


def test_searches_go_on_where_they_end():
    """A search shows 1,000 repositories at most; the others come by fewer stars, also where many have the same."""
    stars = sorted([i // 7 for i in range(2_345)], reverse=True)

    def get(url):
        asked = parse_qs(urlparse(url).query)
        below, page = int(asked["q"][0].partition(" stars:<")[2] or 1_000), int(asked["page"][0])
        shown = [{"full_name": f"o/{i}", "stargazers_count": n} for i, n in enumerate(stars) if n < below]
        return 200, json.dumps({"items": shown[(page - 1) * 100 : min(page * 100, 1_000)]}).encode()

    names = {i["full_name"] for p in fetch.search_pages(get, "http://s", ("q",)) for i in p["items"]}
    assert len(names) == 2_345
    assert sum(len(p["items"]) for p in fetch.search_pages(get, "http://s", ("q",), 150)) == 200
    ignoring = lambda url: get(url.replace("stars%3A%3C", "x"))  # noqa: E731  a service that does not know the qualifier ends
    assert sum(1 for _ in fetch.search_pages(ignoring, "http://s", ("q",))) == 20


def test_commands(spark, tmp_path):
    (tmp_path / "rows.json").write_text(json.dumps(ROWS))
    (tmp_path / "golden.json").write_text(json.dumps([{"query": "send an email", "expected": ["mail"]}, {"query": "route", "expected": ["other"]}]))
    out = str(tmp_path / "v1")
    cli.run_index(spark, Config(), {"file": str(tmp_path / "rows.json")}, out, as_of="2026-01-01T00:00:00Z")
    card = cli.run_eval(spark, Config(), out, str(tmp_path / "golden.json"), fails=True)
    assert card.startswith("n=2 Hit@1=0.500 Recall@5=0.500") and "route: " in card
    cli.run_index(spark, Config(), {"file": str(tmp_path / "rows.json")}, str(tmp_path / "v2"), limit=1, previous=out)
    assert spark.read.parquet(f"{tmp_path}/v2/catalog").count() == 2
    with pytest.raises(ValueError, match="unknown source"):
        cli.sources(Config(source="elsewhere"), {})
    with pytest.raises(ValueError, match="no path"):
        cli.sources(Config(), {})
    with pytest.raises(ValueError, match="length 256"):
        cli.run_eval(spark, Config(embed_dim=64), out, str(tmp_path / "golden.json"))


def test_tools_and_snapshots(spark, tmp_path):
    assert "call_tool" in tools(True) and "call_tool" not in tools(False)
    events = spark.createDataFrame([("a", "success"), ("a", "tool_error")], "mcp_id string, outcome string")
    usage.save_snapshot(usage.tally(events), str(tmp_path / "s"))
    assert [tuple(r) for r in usage.load_snapshot(spark, str(tmp_path / "s")).collect()] == [("a", 2, 1, 1)]
    assert usage.load_snapshot(spark, str(tmp_path / "absent")).count() == 0
