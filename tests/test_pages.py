"""The data sources against a server on this machine: batches, streams that go on, failures."""

import json
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tessera import cli
from tessera.plans.config import Config
from tessera.sources import pages
from tessera.sources.catalogs import RegistrySource, RepositorySource, parsed_pages, registry_rows
from tessera.sources.formats import OFFICIAL


@contextmanager
def serving(answer):
    """``answer(path, query)`` gives a status and an object; yields the address and the requests so far."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            parts = urlparse(self.path)
            asked.append(self.path)
            status, found = answer(parts.path, {k: v[0] for k, v in parse_qs(parts.query).items()})
            body = json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            return

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}", asked
    finally:
        server.shutdown()
        server.server_close()


def registry(names, page=3):
    """A registry of servers, of each an old and the latest version, by cursor."""
    entries = lambda: [{"server": {"name": n, "version": v, "description": f"about {n}"}, "_meta": {OFFICIAL: {"isLatest": v == "2", "updatedAt": "t"}}} for n in names for v in ("1", "2")]

    def answer(path, query):
        every, at = entries(), int(query.get("cursor", 0))
        return 200, {"servers": every[at : at + page], "metadata": {"nextCursor": str(at + page) if at + page < len(every) else ""}}

    return answer


def ids(df):
    return [r["id"] for r in df.orderBy("pos").collect()]


def test_registry_in_a_batch(spark):
    names = [f"s{i:02d}" for i in range(11)]
    with serving(registry(names)) as (url, asked):
        assert ids(RegistrySource(url).fetch(spark)) == names
        asked.clear()
        assert ids(RegistrySource(url).fetch(spark, 4)) == names[:4] and len(set(asked)) < 5
        assert pages.load(spark, "registry_pages", url=url).count() == 8
    with serving(registry([])) as (url, _):
        assert RegistrySource(url).fetch(spark).count() == 0
    with serving(lambda path, query: (404, {})) as (url, _), pytest.raises(PythonException, match="404"):
        RegistrySource(url).fetch(spark).collect()


def test_registry_as_a_stream(spark, tmp_path):
    """Each run takes the servers that are new, also on a page that had been read before; a rerun takes none."""
    names = [f"s{i:02d}" for i in range(7)]
    pages.register(spark)
    with serving(registry(names)) as (url, asked):

        def go():
            rows = spark.readStream.format("registry_pages").option("url", url).load()
            found = registry_rows(parsed_pages(rows)).select("id")
            asked.clear()
            found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(once=True).start().awaitTermination()
            return sorted(r["id"] for r in spark.read.schema("id string").parquet(f"{tmp_path}/out").collect())

        assert go() == names and go() == names
        assert len(asked) <= 6  # the walk, and where it had come to: nothing is new
        names += ["s07", "s08"]
        assert go() == names and len(asked) <= 6 + 1 + 2
        names.append("s09")
        assert go() == go() == names


def test_repositories(spark):
    item = lambda i: {"full_name": f"o/r{i}", "name": f"r{i}", "owner": {"login": "o"}, "description": f"about {i}", "html_url": f"https://x/{i}", "stargazers_count": i, "default_branch": "dev" if i % 2 else None, "archived": i == 3}

    def answer(path, query):
        if path == "/search/repositories":
            topic, n = query["q"], int(query["page"])
            if topic == "topic:mcp":
                return 500 if n > 1 else 200, {"items": [item(i) for i in range(100)]}
            return 200, {"items": [item(i) for i in range(98 + 100 * (n - 1), 98 + 100 * n)] if n < 3 else []}
        _, owner, name, branch, _ = path.split("/")
        k = int(name[1:])
        return (200, {"name": f"described/{k}"}) if k % 10 == 1 and branch == "dev" else (404, {})

    with serving(answer) as (url, asked):
        import tessera.sources.pages as own

        assert own.load(spark, "repository_pages", url=url, queries=json.dumps(["a"])).count() == 3
        rows = RepositorySource(url, url).fetch(spark).withColumn("k", F.col("popularity")).collect()
    by = {r["k"]: r["id"] for r in rows}
    assert set(by) == {*range(298)} - {3} and len(rows) == 297
    assert by[11] == "described/11" and by[12] == "io.github.o/r12"


def test_the_index_command_fetches(spark, tmp_path):
    with serving(registry(["mail", "maps"])) as (url, _):
        cli.run_index(spark, Config(source="registry"), {"registry": url}, str(tmp_path / "v1"), as_of="2026-01-01T00:00:00Z")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/v1/catalog").collect()) == ["mail", "maps"]
