"""Fetching of registry and search pages, and landing them as files that the sources read.

``get(url)`` gives (status, body); it is handed in, with its retries and headers.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from urllib.parse import quote, urlencode

from pyspark.sql import SparkSession

from ..scratch import write_file
from .formats import OFFICIAL, TOPIC_QUERIES

Get = Callable[[str], tuple[int, bytes]]
REGISTRY_PAGE_SIZE, SEARCH_PAGE_SIZE, SEARCH_PAGES = 100, 100, 10
MAX_PAGE = 64 << 20


def _page(get: Get, url: str) -> dict:
    status, body = get(url)
    if status != 200:
        raise ConnectionError(f"{url} answered {status}")
    if len(body) > MAX_PAGE:
        raise ValueError(f"{url} is longer than {MAX_PAGE} bytes")
    return json.loads(body)


def registry_page(get: Get, base: str, cursor: str = "") -> dict:
    return _page(get, f"{base}/v0/servers?" + urlencode({"limit": REGISTRY_PAGE_SIZE} | ({"cursor": cursor} if cursor else {})))


def registry_pages(get: Get, base: str, limit: int = 0) -> Iterator[dict]:
    """Pages in cursor order, until the last or until ``limit`` latest versions were seen; any failure ends it with an error."""
    cursor, seen = "", 0
    while True:
        page = registry_page(get, base, cursor)
        yield page
        seen += sum(bool((e.get("_meta") or {}).get(OFFICIAL, {}).get("isLatest")) for e in page.get("servers") or [])
        cursor = (page.get("metadata") or {}).get("nextCursor") or ""
        if not cursor or 0 < limit <= seen:
            return


def search_pages(get: Get, base: str, queries: tuple[str, ...] = TOPIC_QUERIES, limit: int = 0) -> Iterator[dict]:
    """Pages of each query by stars, with ``query_idx``; a query that fails keeps what it found.

    A search shows its first ``SEARCH_PAGES`` pages alone, so the rest is asked for
    by fewer stars, down to the last; repositories at the seam come twice.
    """
    for i, query in enumerate(queries):
        seen, below = 0, None  # below: the stars that the rest has fewer than
        while True:
            most, items = None, []
            for n in range(1, SEARCH_PAGES + 1):
                asked = query if below is None else f"{query} stars:<{below}"
                try:
                    page = _page(get, f"{base}/search/repositories?" + urlencode({"q": asked, "sort": "stars", "order": "desc", "per_page": SEARCH_PAGE_SIZE, "page": n}))
                except (OSError, ValueError):
                    items = []
                    break
                items = page.get("items") or []
                yield page | {"query_idx": i}
                seen += len(items)
                most = items[0].get("stargazers_count") if items and most is None else most
                if len(items) < SEARCH_PAGE_SIZE or 0 < limit <= seen:
                    items = []
                    break
            least = items[-1].get("stargazers_count") if items else None
            if least is None:
                break
            if most == least:
                warnings.warn(f"{query}: more repositories of {least} stars than a search shows", stacklevel=2)
            rest = least if most == least else least + 1
            if below is not None and rest >= below:  # a service that does not know the qualifier
                break
            below = rest


def server_description(get: Get, base: str, full_name: str, branch: str = "") -> dict | None:
    """The description at a repository's root; None on any failure."""
    try:
        return _page(get, f"{base}/{full_name}/{quote(branch or 'main')}/server.json")
    except (OSError, ValueError):
        return None


def land(pages: Iterator[dict], folder: str, spark: SparkSession | None = None) -> int:
    """One file for each page, named by its place; returns their number.  With a session the folder may be on any storage that it reads."""
    n = 0
    for n, page in enumerate(pages, 1):  # noqa: B007
        body, name = json.dumps(page), f"page-{n:06d}.json"
        if spark is None:
            Path(folder, name).write_text(body)
        else:
            write_file(spark, f"{folder}/{name}", body.encode())
    return n


def land_descriptions(get: Get, base: str, pages: list[dict], folder: str, spark: SparkSession, together: int = 10) -> int:
    """The descriptions of the repositories on search pages, as one file of ``full_name`` and ``server``; returns their number.

    ``together`` are asked for at a time; a failure leaves a repository without one.
    """
    wanted = {i["full_name"]: i.get("default_branch") or "" for p in pages for i in p.get("items") or [] if i.get("full_name") and not i.get("archived")}
    with ThreadPoolExecutor(max(1, together)) as pool:
        found = pool.map(lambda item: (item[0], server_description(get, base, *item)), wanted.items())
        lines = [json.dumps({"full_name": n, "server": d}) for n, d in found if d is not None]
    write_file(spark, f"{folder}/descriptions.json", "\n".join(lines).encode())
    return len(lines)
