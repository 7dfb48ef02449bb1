"""Catalogue sources: files, registry pages, repository searches, several at once."""

from __future__ import annotations

import json
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..remote import bounded_map
from ..schema import CATALOG, GOLDEN, fields, normalized
from ..scratch import ship, store
from . import fetch
from . import pages as pages_source
from .formats import OFFICIAL, REGISTRY_PAGE, SEARCH_PAGE, SERVER


class Source(Protocol):
    """Gives a catalogue with ``pos``, the order of its rows; limit <= 0: all."""

    name: str

    def fetch(self, spark: SparkSession, limit: int = 0) -> DataFrame: ...


def _limited(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy("pos").limit(limit) if limit > 0 else rows


def from_server_json(server: Column, source: str) -> list[Column]:
    """Catalogue columns of a server description."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    packages = F.transform(server["packages"], lambda p: F.struct(p["registryType"].alias("registryType"), p["identifier"].alias("identifier"), p["version"].alias("version"), p["transport"]["type"].alias("transport")))
    return [
        empty(server["name"]).alias("id"), empty(server["name"]).alias("name"), server["title"].alias("title"), server["description"].alias("description"), server["version"].alias("version"),
        server["repository"]["url"].alias("repository"), server["websiteUrl"].alias("homepage"), server["remotes"].alias("transports"), packages.alias("packages"), F.lit(source).alias("source"),
    ]


class FileSource:
    """Catalogue rows from files; without a source a row is ``file``, without an id its name.

    A file is a JSON array, which one task reads whole, or - by the ending .jsonl
    or .ndjson of the path - has a row on each line; such files, or a pattern of
    them, are read in splits, and a line that is no row is left out.
    """

    name = "file"

    def __init__(self, path: str):
        self.path = path

    def fetch(self, spark: SparkSession, limit: int = 0) -> DataFrame:
        if self.path.endswith((".jsonl", ".ndjson")):
            lines = spark.read.text(self.path).select(F.from_json("value", CATALOG, {"mode": "PERMISSIVE"}).alias("m"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i"))  # the place within a task
            rows = lines.where(F.col("m.id").isNotNull() | F.col("m.name").isNotNull()).select(F.struct("file", "block", "i").alias("pos"), "m.*")
        else:
            text = spark.read.text(self.path, wholetext=True)
            rows = text.select(F.posexplode(F.from_json("value", f"array<struct<{_colons(CATALOG)}>>")).alias("pos", "m")).select("pos", "m.*")
        rows = _limited(rows, limit)
        blank = lambda c, d: F.when(F.coalesce(F.col(c), F.lit("")) == "", d).otherwise(F.col(c))
        out = rows.withColumn("source", blank("source", F.lit("file"))).withColumn("id", blank("id", F.col("name")))
        return _with_pos(out)


def _remote(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def registry_rows(pages: DataFrame) -> DataFrame:
    """Catalogue rows of pages (file, servers): the latest versions, with ``pos``."""
    entries = pages.select("file", F.posexplode("servers").alias("i", "e"))
    meta = F.col("e._meta").getField(OFFICIAL)
    rows = entries.where(F.coalesce(meta["isLatest"], F.lit(False)))
    return rows.select(*from_server_json(F.col("e.server"), RegistrySource.name), meta["updatedAt"].alias("updatedAt"), F.struct("file", "i").alias("pos"))


def parsed_pages(bodies: DataFrame) -> DataFrame:
    """(file, servers) of pages (place, body) as the data source gives them, in batches and streams."""
    return bodies.select(F.lpad(F.col("place").cast("string"), 12, "0").alias("file"), F.from_json("body", REGISTRY_PAGE).alias("p")).select("file", "p.servers")


class RegistrySource:
    """Registry pages; only latest versions.  ``path`` has pages that were landed as JSON files, in the order of their names, or is the registry's own address."""

    name = "registry"

    def __init__(self, path: str):
        self.path = path

    def fetch(self, spark: SparkSession, limit: int = 0) -> DataFrame:
        if _remote(self.path):
            pages = parsed_pages(pages_source.load(spark, "registry_pages", url=self.path, limit=limit))
        else:
            pages = spark.read.schema(REGISTRY_PAGE).json(self.path, multiLine=True).select(F.input_file_name().alias("file"), "servers")
        return _with_pos(_limited(registry_rows(pages), limit))


class RepositorySource:
    """Pages of repository searches, landed or at the address of the search, and server descriptions by ``full_name``, landed or at the address that serves them."""

    name = "github"

    def __init__(self, pages: str, descriptions: str | None = None):
        self.pages, self.descriptions = pages, descriptions

    def fetch(self, spark: SparkSession, limit: int = 0) -> DataFrame:
        if _remote(self.pages):
            bodies = pages_source.load(spark, "repository_pages", url=self.pages, limit=limit)
            pages = bodies.select("query_idx", F.lpad(F.col("page").cast("string"), 12, "0").alias("file"), F.from_json("body", SEARCH_PAGE)["items"].alias("items"))
        else:
            pages = spark.read.schema(SEARCH_PAGE).json(self.pages, multiLine=True).select("query_idx", F.input_file_name().alias("file"), "items")
        found = pages.select("query_idx", "file", F.posexplode("items").alias("i", "r"))
        first = W.partitionBy("r.full_name").orderBy("query_idx", "file", "i")
        repos = found.where(~F.coalesce(F.col("r.archived"), F.lit(False)) & (F.coalesce(F.col("r.full_name"), F.lit("")) != "")).withColumn("n", F.row_number().over(first)).where("n = 1")
        repos = _limited(repos.select("r", F.struct("query_idx", "file", "i").alias("pos")), limit)
        if self.descriptions and _remote(self.descriptions):
            repos = store(repos, "repositories")  # asked for once
            repos = repos.join(store(described(repos, self.descriptions), "descriptions"), F.col("r.full_name") == F.col("full_name"), "left")
        elif self.descriptions:
            landed = spark.read.schema(f"full_name string, server {SERVER}").json(self.descriptions)
            repos = repos.join(landed, F.col("r.full_name") == F.col("full_name"), "left")
        else:
            repos = repos.withColumn("server", F.lit(None).cast(SERVER))
        return _with_pos(repositories(repos))


def described(repos: DataFrame, base: str, together: int = 10) -> DataFrame:
    """full_name and server of the repositories that have a description at ``base``; executors ask, ``together`` at a time in each task."""

    def run(frames):
        get = pages_source.getter({})
        for frame in frames:
            wanted = list(zip(frame["full_name"], frame["branch"]))
            got = [d for d, _ in bounded_map(lambda w: fetch.server_description(get, base.rstrip("/"), *w), wanted, together)]
            yield pd.DataFrame({"full_name": [n for (n, _), d in zip(wanted, got) if d is not None], "body": [json.dumps(d) for d in got if d is not None]})

    ship(repos.sparkSession)
    asked = repos.select("r.full_name", F.coalesce("r.default_branch", F.lit("")).alias("branch"))
    return asked.mapInPandas(run, "full_name string, body string").select("full_name", F.from_json("body", SERVER).alias("server"))


def repositories(repos: DataFrame) -> DataFrame:
    """Catalogue rows of (r, server, pos): the description where there is one, defaults from the repository."""
    own = repos.select("pos", "r", *from_server_json(F.col("server"), "github"))
    r = F.col("r")
    fill = lambda c, d: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.coalesce(d, F.lit(""))).otherwise(F.col(c))
    name = F.concat(F.lit("io.github."), F.lower(F.concat_ws("/", r["owner"]["login"], r["name"])))
    own = own.withColumn("name", fill("name", name)).withColumn("id", fill("id", F.col("name")))
    for c, d in (("title", r["name"]), ("description", r["description"]), ("repository", r["html_url"]), ("homepage", r["homepage"])):
        own = own.withColumn(c, fill(c, d))
    return own.select("pos", *[c for c in own.columns if c not in ("pos", "r")], r["pushed_at"].alias("updatedAt"), r["stargazers_count"].alias("popularity"), X.ordered_set(X.useful_topics(F.coalesce(r["topics"], F.array().cast("array<string>")))).alias("categories"))


class MultiSource:
    """Several sources one after another; the limit holds for each.

    Each is read and stored by itself, so one that fails, at whatever point, is
    left out and named in ``failed``.
    """

    name = "multi"

    def __init__(self, sources: list[Source]):
        self.sources, self.failed = sources, {}

    def fetch(self, spark: SparkSession, limit: int = 0) -> DataFrame:
        got = []
        for i, source in enumerate(self.sources):
            try:
                got.append(store(source.fetch(spark, limit), "source").withColumn("pos", F.concat(F.lit(f"{i:04d}/"), F.col("pos"))))
            except Exception as error:  # noqa: BLE001  one source's failure is not the others'
                self.failed[source.name] = error
        return union_all(got) if got else _with_pos(spark.createDataFrame([], CATALOG).withColumn("pos", F.lit(0)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _with_pos(rows: DataFrame) -> DataFrame:
    """A normalized catalogue with ``pos`` as a string that sorts like it."""
    pos = _sortable(rows.schema["pos"].dataType.simpleString())
    return normalized(rows.withColumn("pos", pos), "pos")


def _sortable(kind: str) -> Column:
    number = lambda c: F.lpad(c.cast("string"), 12, "0")
    if not kind.startswith("struct"):
        return number(F.col("pos"))
    parts = [p.split(":") for p in kind[7:-1].split(",")]
    return F.concat_ws("/", *[F.col(f"pos.{n}") if t == "string" else number(F.col(f"pos.{n}")) for n, t in parts])


def _colons(ddl: str) -> str:
    return ",".join(f"{n}:{k}" for n, k in fields(ddl))


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """qid, query, expected of a JSON array of labelled queries."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", f"array<struct<{_colons(GOLDEN)}>>")).alias("qid", "g"))
    return rows.select(F.col("qid").cast("bigint").alias("qid"), F.coalesce("g.query", F.lit("")).alias("query"), F.coalesce("g.expected", F.array().cast("array<string>")).alias("expected"))
