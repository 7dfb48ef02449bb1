"""The point table: each catalogue row as several points, and its upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X

#: RFC 4122 namespace for URLs, without dashes.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
KINDS = ("server", "tool", "query")


def point_id(mcp_id: Column, kind: Column, part: Column) -> Column:
    """Version 5 UUID of ``id|kind|part``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(F.concat_ws("|", mcp_id, kind, part), "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def build_points(catalog: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """A server point for each row, a point for each tool and one for each example query, with what ``keep`` says of its row.

    One pass over the catalogue: the points of a row are an array, exploded.
    """
    m = F.col
    display = X.display_name(m("title"), m("name"))

    def point(kind: str, tool: Column, query: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), tool.alias("tool_name"), query.alias("query"), text.alias("text"))

    server = F.array(point("server", F.lit(""), F.lit(""), X.embedding_text(m)))
    tools = F.transform("tools", lambda t: point("tool", t["name"], F.lit(""), X.tool_text(t, display)))
    asked = F.transform(m("enrichment")["exampleQueries"], lambda q: point("query", F.lit(""), q, q))
    rows = catalog.select(m("id").alias("mcp_id"), "source", X.merged_categories(m("categories"), m("enrichment")["categories"]).alias("categories"), *[c.alias(n) for n, c in (keep or {}).items()], F.posexplode(F.concat(server, tools, asked)).alias("ordinal", "p"))
    part = F.when(m("p.kind") == "tool", m("p.tool_name")).when(m("p.kind") == "query", m("p.query")).otherwise("")
    return rows.select(point_id(m("mcp_id"), m("p.kind"), part).alias("point_id"), "mcp_id", "p.kind", "p.tool_name", "p.query", "ordinal", "source", "categories", *(keep or {}), "p.text")


def doubles(asked: bool = True) -> Column:
    """Does a catalogue row have points that share an id: tools of one name, or (if ``asked``) one query twice?"""
    twice = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    tools = twice(F.transform("tools", lambda t: t["name"]))
    return tools | twice(F.col("enrichment")["exampleQueries"]) if asked else tools


def last_write_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key: the last in ``order``."""
    w = W.partitionBy(key).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(existing: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """``existing`` with the rows of ``new`` (one for each key) in the place of those with the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def delete_by_parent(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Points whose ``mcp_id`` is not among ``ids``."""
    return points.join(ids.select("mcp_id").distinct(), "mcp_id", "left_anti")


def lookup(catalog: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a batch of ids; ids that no row has are left out."""
    return catalog.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")


#: Bytes of a row group of a table that is looked up by its keys.
ROW_GROUP = 8 << 20


def write_for_lookups(df: DataFrame, path: str, order: list[str], keys: list[str], row_group: int = ROW_GROUP) -> None:
    """Writes ``df`` so that filters on it read few row groups.

    Rows are dealt out and sorted by ``order``, so equality and ranges on its
    columns leave out files and row groups by their least and largest values; each of
    ``keys`` has a Bloom filter in every row group, which leaves out those without
    a value that is looked up.  Spark's own pushed filters use both.
    """
    own = [c for c in order if c in df.columns]
    writer = df.repartitionByRange(*own).sortWithinPartitions(*own).write.mode("overwrite").option("parquet.block.size", row_group)
    for key in keys:
        if key in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", 200_000)
    writer.parquet(path)


def categories_of(points: DataFrame, key: str = "point_id") -> DataFrame:
    """category and key of each point: an array has no least and largest value, so a filter on categories looks here."""
    return points.select(F.explode(F.array_distinct("categories")).alias("category"), key).where("category <> ''")


def having(points: DataFrame, by_category: DataFrame, categories: list[str], key: str = "point_id") -> DataFrame:
    """The points that have any of ``categories``."""
    return points.join(by_category.where(F.col("category").isin(categories)).select(key).distinct(), key, "left_semi")


def ensure_dimension(points: DataFrame, vector: str, dim: int) -> DataFrame:
    """``points``, unless a vector has another length than ``dim``."""
    other = points.where(F.size(vector) != dim).select(F.size(vector).alias("n")).first()
    if other is not None:
        raise ValueError(f"the table has vectors of length {other['n']}, not {dim}")
    return points


def category_facet(catalog: DataFrame, most: int = 1000) -> DataFrame:
    """The most frequent categories, in ascending order."""
    found = catalog.select(F.explode("categories").alias("category")).where("category <> ''").groupBy("category").count()
    return found.orderBy(F.desc("count"), "category").limit(most).select("category").orderBy("category")
