"""The four calls that clients make, over one index."""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import merged_categories
from ..operators.points import category_facet
from ..operators.usage import with_scores
from ..remote import forward_call
from ..schema import QUERIES
from ..scratch import read_file, store, write_file
from .cache import ResultCache, cache_key
from .config import Config
from .index import Index
from .search import search
from .strategies import Clients

LOG = logging.getLogger("tessera")
COUNTS = ("calls", "successes", "tool_errors")
SHOWN = ("id", "name", "title", "description", "score", "confidence", "matched_tool", "categories", "repository", "source")


def tools(calls: bool) -> dict[str, dict]:
    """The calls a client is offered, with their arguments; forwarding only where it is enabled."""
    text, number, words = {"type": "string"}, {"type": "number"}, {"type": "array", "items": {"type": "string"}}
    offered = {
        "search": {"query": text, "top_k": {"type": "integer"}, "categories": words, "source": text, "min_score": number},
        "details": {"id_": text},
        "categories": {},
    }
    return offered | ({"call_tool": {"id_": text, "tool": text, "arguments": {"type": "object"}}} if calls else {})


class Together:
    """Runs items that come at the same time as one list: while a list runs, and for ``wait`` seconds before it, more are gathered."""

    def __init__(self, run: Callable[[list], list], wait: float = 0.01, most: int = 1000):
        self.run, self.wait, self.most = run, wait, most
        self.turn, self.lock, self.pending = threading.Lock(), threading.Lock(), []

    def __call__(self, item):
        own: Future = Future()
        with self.lock:
            self.pending.append((item, own))
        with self.turn:
            if not own.done():
                time.sleep(self.wait)
            while not own.done():
                self._run_oldest()
        return own.result()

    def _run_oldest(self) -> None:
        with self.lock:
            taken, self.pending = self.pending[: self.most], self.pending[self.most :]
        try:
            for (_, future), result in zip(taken, self.run([item for item, _ in taken]), strict=True):
                future.set_result(result)
        except Exception as error:  # noqa: BLE001  each caller gets it
            for _, future in taken:
                if not future.done():
                    future.set_exception(error)


class Discovery:
    """The calls over one index; usage is tallied by id, read from ``usage_path`` at the start and flushed there every ``flush_seconds`` and at the end."""

    FLUSH_SECONDS = 30.0

    def __init__(
        self, spark: SparkSession, index: Index, config: Config = Config(), call: Callable[[dict, str, dict], tuple[str, bool]] | None = None,
        clock: Callable[[], float] | None = None, clients: Clients = Clients(), flush_seconds: float = FLUSH_SECONDS,
    ):
        self.spark, self.index, self.config, self.call, self.clients = spark, index, config, call, clients
        if call is None and config.proxy_enabled and clients.tools:
            self.call = lambda row, tool, arguments: forward_call(row, tool, arguments, clients.tools.call)
        self.cache = ResultCache(config.cache_size, config.cache_ttl_seconds, **({"clock": clock} if clock else {}))
        self.lock, self.dirty = threading.Lock(), False
        self.tallies: dict[str, list[int]] = self._read_usage()
        self.together = Together(self.search_all)
        self.closed = threading.Event()
        if config.usage_path:
            threading.Thread(target=self._flush_now_and_then, args=(flush_seconds,), daemon=True).start()

    def _flush_now_and_then(self, seconds: float) -> None:
        while not self.closed.wait(seconds):
            try:
                self.flush()
            except Exception as error:  # noqa: BLE001  the tallies stay, for the next time
                LOG.warning("usage was not written: %s", error)

    def _read_usage(self) -> dict[str, list[int]]:
        """Tallies of an earlier run; none where they cannot be read."""
        try:
            raw = read_file(self.spark, self.config.usage_path) if self.config.usage_path else None
            return {k: [int(v[n]) for n in COUNTS] for k, v in json.loads(raw).items()} if raw else {}
        except (ValueError, KeyError, TypeError):
            return {}

    def flush(self) -> bool:
        """Write the tallies if there are new ones and a path for them."""
        with self.lock:
            if not self.dirty or not self.config.usage_path:
                return False
            write_file(self.spark, self.config.usage_path, json.dumps({k: dict(zip(COUNTS, v)) for k, v in sorted(self.tallies.items())}).encode())
            self.dirty = False
            return True

    def close(self) -> None:
        self.closed.set()
        self.flush()

    def tools(self) -> dict[str, dict]:
        return tools(self.call is not None)

    def search(self, query: str, top_k: int = 5, categories: list[str] | None = None, source: str = "", min_score: float = 0.0) -> list[dict]:
        """One search; calls that come at the same time are one batch over the index."""
        if not query:
            raise ValueError("query is empty")
        key = cache_key(query, top_k, min_score, source, categories)
        found = self.cache.get(key)
        if found is None:
            found = self.together((query, top_k, float(min_score), categories or [], source))
            self.cache.put(key, found)
        return found

    def search_all(self, asked: list[tuple]) -> list[list[dict]]:
        """The answers to many (query, top_k, min_score, categories, source), by one plan."""
        queries = self.spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], QUERIES)
        rows = search(queries, self.index, self.config, self.usage() if self.tallies else None, self.clients).withColumn("categories", merged_categories(F.col("categories"), F.col("enrichment.categories")))
        out: list[list[dict]] = [[] for _ in asked]
        for r in rows.select("qid", *SHOWN, "rank").orderBy("qid", "rank").drop("rank").collect():  # at most top_k for each query
            one = r.asDict(True)
            out[one.pop("qid")].append(one)
        return out

    def resolve(self, id_: str) -> tuple[dict | None, list[str]]:
        """The row with this id, or with it in another letter case among five search results; else those results' ids."""
        if not id_:
            raise ValueError("id is empty")
        exact = self.index.catalog.where(F.col("id") == id_).limit(1).collect()
        if exact:
            return exact[0].asDict(True), []
        near = [r["id"] for r in self.search(id_, 5)]
        for other in near:
            if other.lower() == id_.lower():
                return self.resolve(other)
        return None, near

    def details(self, id_: str) -> dict:
        row, suggestions = self.resolve(id_)
        return {"found": row is not None, "record": row, "suggestions": suggestions}

    def categories(self) -> list[str]:
        every = self.index.catalog.withColumn("categories", merged_categories(F.col("categories"), F.col("enrichment.categories")))
        return [r["category"] for r in category_facet(every).collect()]

    def call_tool(self, id_: str, tool: str, arguments: dict) -> dict:
        """Forwards a call; its outcome is recorded under the row's own id before an error goes on."""
        if self.call is None:
            raise RuntimeError("calls are not enabled")
        row, suggestions = self.resolve(id_)
        if row is None:
            return {"found": False, "suggestions": suggestions}
        try:
            content, is_error = self.call(row, tool, arguments)
        except Exception:
            self._record(row["id"], "unreachable")
            raise
        self._record(row["id"], "tool_error" if is_error else "success")
        return {"found": True, "content": content, "is_error": is_error}

    def _record(self, id_: str, outcome: str) -> None:
        if not id_:
            return
        with self.lock:
            own = self.tallies.setdefault(id_, [0, 0, 0])
            own[0] += 1
            own[1] += outcome == "success"
            own[2] += outcome == "tool_error"
            self.dirty = True

    def usage(self) -> DataFrame:
        with self.lock:
            rows = [(k, *v) for k, v in self.tallies.items()]
        return with_scores(self.spark.createDataFrame(rows, "mcp_id string, calls bigint, successes bigint, tool_errors bigint"))

    def snapshot(self) -> dict[str, dict[str, int]]:
        with self.lock:
            return {k: dict(zip(COUNTS, v)) for k, v in sorted(self.tallies.items())}


def resolve_all(spark: SparkSession, asked: DataFrame, index: Index, config: Config = Config()) -> DataFrame:
    """asked, id, suggestions for many ids at once: the row itself, else the first of five search results that differs in letter case alone, else those five."""
    own = asked.select(F.col("id").alias("asked")).distinct()
    exact = own.join(index.catalog.select(F.col("id").alias("asked")), "asked", "left_semi").withColumn("id", F.col("asked"))
    rest = store(own.join(exact.select("asked"), "asked", "left_anti").where("asked <> ''").withColumn("qid", F.monotonically_increasing_id()), "unresolved")
    none = F.array().cast("array<string>")
    queries = rest.select("qid", F.col("asked").alias("query"), F.lit(5).alias("top_k"), F.lit(0.0).alias("min_score"), none.alias("categories"), F.lit("").alias("source"))
    near = search(queries, index, config).select("qid", "rank", F.col("id").alias("near")).join(rest, "qid")
    folded = F.min(F.when(F.lower("near") == F.lower("asked"), F.struct("rank", "near")))["near"]
    found = near.groupBy("asked").agg(folded.alias("id"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "near"))), lambda x: x["near"]).alias("suggestions"))
    told = rest.select("asked").join(found, "asked", "left")
    told = told.select("asked", "id", F.when(F.col("id").isNull(), F.coalesce("suggestions", none)).otherwise(none).alias("suggestions"))
    return exact.select("asked", "id", none.alias("suggestions")).unionByName(told)
