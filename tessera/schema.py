"""Spark types of the catalogue.  Absent values are '' or [], never null (``normalized``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRANSPORT = "struct<type:string,url:string>"
PACKAGE = "struct<registryType:string,identifier:string,version:string,transport:string>"
TOOL = "struct<name:string,description:string>"
CARD = "struct<summary:string,tasks:array<string>,exampleQueries:array<string>,synonyms:array<string>,categories:array<string>,enricher:string>"

#: One row of the catalogue.
CATALOG = f"""id string, name string, title string, description string, version string, repository string, homepage string,
categories array<string>, transports array<{TRANSPORT}>, packages array<{PACKAGE}>, tools array<{TOOL}>, source string,
sources array<string>, updatedAt string, popularity bigint, trust double, trustRationale string, trustFlags array<string>, enrichment {CARD}"""

GOLDEN = "query string, expected array<string>"
#: A batch of searches; top_k <= 0: 5; min_score 0: no cut-off; categories []: any; source '': any.
QUERIES = "qid bigint, query string, top_k int, min_score double, categories array<string>, source string"


def fields(ddl: str = CATALOG) -> list[tuple[str, str]]:
    """Names and types at the top level of a DDL string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append((name, kind.strip()))
            start = i + 1
    return out


def _default(kind: str):
    if kind.startswith("array"):
        return F.array().cast(kind)
    if kind.startswith("struct"):
        return F.struct(*[_default(k).alias(n) for n, k in fields(kind[7:-1].replace(":", " "))]).cast(kind)
    return F.lit({"string": "", "bigint": 0, "double": 0.0}[kind]).cast(kind)


def _without_nulls(c, kind: str):
    """``c`` with defaults in the place of nulls, at every depth."""
    if kind.startswith("array"):
        inner = kind[6:-1]
        return F.coalesce(F.transform(c, lambda x: _without_nulls(x, inner)), _default(kind))
    if kind.startswith("struct"):
        return F.struct(*[_without_nulls(c.getField(n), k).alias(n) for n, k in fields(kind[7:-1].replace(":", " "))])
    return F.coalesce(c.cast(kind), _default(kind))


def normalized(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` as a catalogue: all columns of CATALOG, absent ones and nulls as defaults, after ``keep``."""
    have = set(df.columns)
    return df.select(*keep, *[(_without_nulls(F.col(n), k) if n in have else _default(k)).alias(n) for n, k in fields()])
