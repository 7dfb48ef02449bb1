"""Identity resolution: rows that describe one thing become one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import fields
from ..scratch import drop, store


def identity_key(name: Column, repository: Column, id_: Column) -> Column:
    """By name, else by repository, else by id; letter case does not count."""
    repo = X.repository(repository)
    return (
        F.when(~X.blank(name), F.concat(F.lit("name:"), F.lower(X.trim(name))))
        .when(repo != "", F.concat(F.lit("repo:"), repo))
        .otherwise(F.concat(F.lit("id:"), F.lower(X.trim(id_))))
    )


def union_by(items: Column, key) -> Column:
    """Items whose ``key`` appeared in no earlier item, in order: by sorting, so long lists stay cheap."""
    tagged = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = lambda a: F.filter(a, lambda e, j: (j == 0) | (F.get(a, j - 1)["k"] != e["k"]))
    in_order = lambda a: F.transform(F.sort_array(F.transform(first(a), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])
    return F.element_at(F.transform(F.array(tagged), in_order), 1)  # an array of one, so that it is sorted once and not for each item


def _folded(*parts: Column) -> Column:
    return F.lower(F.concat_ws("|", *parts))


#: Shared identities that are broadcast, as hashes.
FEW = 1 << 20
SCALARS = ("title", "description", "version", "repository", "homepage", "updatedAt")
#: Lists of a row that are united, and what makes two of their items the same.
UNITED = {
    "categories": lambda x: x,
    "transports": lambda t: _folded(t["type"], t["url"]),
    "packages": lambda p: _folded(p["registryType"], p["identifier"]),
    "tools": lambda t: t["name"],
}


def merge_groups(rows: DataFrame, key: str = "key", pos: str = "pos") -> DataFrame:
    """One catalogue row for each ``key``, in ``pos`` the first place of its group.

    A group of one is left as it is.  Otherwise rows count in the order of
    source priority, then place: scalars are the first that is not blank, lists
    ordered unions, popularity the largest; identity, trust and card are those
    of the first row.

    Which identities several rows share is counted by hashes of keys, so rows that
    share none are neither shuffled nor stored again.  No group is collected: each
    value of the others is an aggregate by its least order, made in parts before rows
    are shuffled, and of lists only the distinct items meet, each with its first place.
    So one identity may have any share of the rows.  ``_tessera_made`` of the result are the stored tables that it is read from.
    """
    names = [n for n, _ in fields()]
    own = [key, pos, *[c for c in names if c not in (key, pos)]]
    held = store(rows.select(*own), "identities")
    hashed = held.withColumn("_h", F.xxhash64(key))
    shared = store(hashed.groupBy("_h").count().where("count > 1").select("_h"), "shared")
    n = shared.count()
    if not n:
        return _made(held, held)
    shared = F.broadcast(shared) if n <= FEW else shared  # keys with the same hash are told apart below
    grouped = _merged(hashed.join(shared, "_h", "left_semi").select(*own), key, pos, names)
    return _made(hashed.join(shared, "_h", "left_anti").select(*own).unionByName(grouped), held, grouped)


def _made(rows: DataFrame, *tables: DataFrame) -> DataFrame:
    rows._tessera_made = tables
    return rows


def _merged(held: DataFrame, key: str, pos: str, names: list[str]) -> DataFrame:
    """One stored row for each key of ``held``."""
    held = store(held.withColumn("_o", F.struct((-X.source_priority(F.col("source"))).alias("o"), F.col(pos).alias("p"), F.xxhash64(*names).alias("h"))), "several")
    first = lambda n: F.min_by(n, F.when(~X.blank(F.col(n)), F.col("_o"))).alias(f"_{n}")
    one = held.groupBy(key).agg(F.count("*").alias("_n"), F.min(pos).alias("_pos"), F.min_by(F.struct(*names), "_o").alias("_base"), F.max("popularity").alias("_popularity"), *map(first, SCALARS))
    one = store(one, "firsts")
    several = held.join(one.where("_n > 1").select(key), key, "left_semi")
    kinds = UNITED | {"sources": lambda x: x}

    def items(n: str):
        """Each item of list ``n`` as (list, what it is known by, place, item)."""
        values = F.array("source") if n == "sources" else F.col(n)
        values = F.transform(values, X.trim) if n in ("categories", "sources") else values
        return F.transform(values, lambda x, i: F.struct(F.lit(n).alias("list"), kinds[n](x).alias("k"), i.alias("i"), *[(x if m == n else F.lit(None).cast(_item(m))).alias(m) for m in kinds]))

    every = several.select(key, "_o", F.explode(F.concat(*[items(n) for n in kinds])).alias("x")).where("x.list NOT IN ('categories', 'sources') OR x.k <> ''")
    distinct = every.groupBy(key, "x.list", "x.k").agg(F.min(F.struct("_o", "x.i")).alias("at"), F.min_by("x", F.struct("_o", "x.i")).alias("x"))
    in_order = lambda n: F.transform(F.sort_array(F.collect_list(F.when(F.col("list") == n, F.struct("at", F.col(f"x.{n}").alias("v"))))), lambda e: e["v"]).alias(f"_{n}")
    lists = distinct.groupBy(key).agg(*[in_order(n) for n in kinds])
    merged = one.join(lists, key, "left")
    many = F.col("_n") > 1
    value = {n: F.coalesce(f"_{n}", f"_base.{n}") for n in SCALARS} | {n: F.coalesce(f"_{n}", F.array().cast(f"array<{_item(n)}>")) for n in kinds} | {"popularity": F.col("_popularity")}
    out = merged.select(key, F.col("_pos").alias(pos), *[(F.when(many, value[n]).otherwise(F.col(f"_base.{n}")) if n in value else F.col(f"_base.{n}")).alias(n) for n in names])
    out = store(out, "merged")
    drop(held, one)
    return out


def _item(name: str) -> str:
    """The type of the items of a list of the catalogue."""
    return dict(fields())[name].removeprefix("array<").removesuffix(">")


def dedup(catalog: DataFrame, pos: str = "pos") -> DataFrame:
    """``catalog`` (with ``pos``, its order) with one row for each identity."""
    rows = merge_groups(catalog.withColumn("key", identity_key(F.col("name"), F.col("repository"), F.col("id"))), "key", pos)
    return _made(rows.drop("key"), *rows._tessera_made)
