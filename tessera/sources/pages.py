"""Pages of a registry and of repository searches as Spark data sources.

    register(spark)
    spark.read.format("registry_pages").option("url", "https://registry.example").load()      # place, body
    spark.readStream.format("registry_pages").option("url", ...).load()
    spark.read.format("repository_pages").option("url", "https://api.example").load()         # query_idx, page, body

Executors fetch the pages.  A registry's pages follow one another by cursor, so a
batch read is one task; a stream walks the cursors first, keeping nothing else,
and then its tasks fetch the new pages side by side.  The stream's offset is a
cursor and how many servers of its page have been taken, so servers that are
added later, to the last page or after it, come with the next batch.  A run that
starts anew walks from the first cursor, since Spark tells a reader only then how
far it had come.  Each topic of a repository search is a task.

Options: ``url``; ``token``, sent as a bearer; ``timeout`` in seconds; ``limit``, as
in ``registry_pages`` and ``search_pages``; ``queries``, a JSON array of topics.
A page that cannot be had after retries fails the read of a registry, and ends
its own topic of a search.  A registry without servers gives one page without.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..clients import sender
from ..remote import with_retries
from ..scratch import ship
from . import fetch
from .formats import TOPIC_QUERIES


def getter(options: dict[str, str]) -> fetch.Get:
    """``get(url)`` with retries, a bearer token and a timeout."""
    send, headers = sender(most=fetch.MAX_PAGE + 1), {"Authorization": f"Bearer {options['token']}"} if options.get("token") else {}

    def get(url: str) -> tuple[int, bytes]:
        status, _, body = with_retries(lambda: send("GET", url, headers, b"", float(options.get("timeout", 30))))
        return status, body

    return get


def _base(options: dict[str, str]) -> str:
    if not options.get("url"):
        raise ValueError("the option url is needed")
    return options["url"].rstrip("/")


class RegistryPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "registry_pages"

    def schema(self) -> str:
        return "place int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _RegistryReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _RegistryStream(dict(self.options))


class _RegistryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.base = options, _base(options)

    def read(self, partition) -> Iterator[tuple]:
        pages = fetch.registry_pages(getter(self.options), self.base, int(self.options.get("limit", 0)))
        for place, page in enumerate(pages):
            yield place, json.dumps(page)


class _Cursor(InputPartition):
    """One page: its place, its cursor and which of its servers are wanted."""

    def __init__(self, place: int, cursor: str, first: int, last: int):
        self.place, self.cursor, self.first, self.last = place, cursor, first, last


class _RegistryStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.base = options, _base(options)
        self.at = self.initialOffset()
        self.walked: dict[int, tuple[str, int]] = {}

    def initialOffset(self) -> dict:
        return {"place": 0, "cursor": "", "taken": 0}

    def _walk(self, at: dict, last: int | None = None) -> dict:
        """Notes the cursor and the number of servers of each page from ``at`` to the page ``last``, or to the end; the offset after them."""
        get, place, cursor = getter(self.options), at["place"], at["cursor"]
        while True:
            page = fetch.registry_page(get, self.base, cursor)
            n, following = len(page.get("servers") or []), (page.get("metadata") or {}).get("nextCursor") or ""
            self.walked[place] = (cursor, n)
            if not following or place == last:
                return {"place": place, "cursor": cursor, "taken": n}
            place, cursor = place + 1, following

    def latestOffset(self) -> dict:
        self.at = self._walk(self.at)
        return self.at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if any(place not in self.walked for place in range(start["place"], end["place"] + 1)):
            self._walk(start, end["place"])  # after a restart
        found = []
        for place in range(start["place"], end["place"] + 1):
            cursor, n = self.walked[place]
            first, last = start["taken"] if place == start["place"] else 0, end["taken"] if place == end["place"] else n
            if first < last:
                found.append(_Cursor(place, cursor, first, last))
        return found

    def read(self, partition: _Cursor) -> Iterator[tuple]:
        page = fetch.registry_page(getter(self.options), self.base, partition.cursor)
        yield partition.place, json.dumps(page | {"servers": page["servers"][partition.first : partition.last]})


class RepositoryPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository_pages"

    def schema(self) -> str:
        return "query_idx int, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _RepositoryReader(dict(self.options))


class _Topic(InputPartition):
    def __init__(self, index: int, query: str):
        self.index, self.query = index, query


class _RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.base = options, _base(options)
        self.queries = json.loads(options["queries"]) if options.get("queries") else list(TOPIC_QUERIES)

    def partitions(self) -> Sequence[InputPartition]:
        return [_Topic(i, q) for i, q in enumerate(self.queries)]

    def read(self, partition: _Topic) -> Iterator[tuple]:
        pages = fetch.search_pages(getter(self.options), self.base, (partition.query,), int(self.options.get("limit", 0)))
        for n, page in enumerate(pages):
            yield partition.index, n, json.dumps(page | {"query_idx": partition.index})


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    ship(spark)
    known = [RegistryPages, RepositoryPages]
    for source in known:
        spark.dataSource.register(source)


def load(spark: SparkSession, name: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(name).options(**{k: str(v) for k, v in options.items()}).load()
