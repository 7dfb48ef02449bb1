"""The indexing pass: catalogue in, tables of points, vectors and terms out."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import encode, enrich, points, resolve
from ..operators.dense_index import DenseIndex
from ..operators.sparse_index import SparseIndex
from ..scratch import store
from .config import Config

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Steps:
    """Stages that talk to other machines; each takes a catalogue (``embed``: point_id and text) and gives its own columns back."""

    extract: Step | None = None
    enrich: Step | None = None
    trust: Step | None = None
    embed: Step | None = None
    #: Statistics of counts (doc, term, tf); a failure leaves an index that is searched by cosine alone.  Without it they are ``encode.stats_of`` the texts, and a failure there is one of the build.
    fit: Step | None = None


@dataclass
class Index:
    """What searches read.  ``points`` has ``vector``; ``terms`` one row for each point that has any (point_id, ts, ws); ``stats`` and ``frequencies`` are for BM25.

    ``lists`` and ``blocks`` are for searches that do not scan all points (``with_retrieval``).
    """

    catalog: DataFrame
    points: DataFrame
    terms: DataFrame
    stats: DataFrame
    frequencies: DataFrame
    dim: int
    lists: DenseIndex | None = None
    blocks: SparseIndex | None = None
    #: ``terms`` beside the other light columns of their points, where a build has made them together.
    scanned: DataFrame | None = None
    #: Tables that the others are read from: whoever has written the index elsewhere may drop them.
    made: tuple[DataFrame, ...] = ()
    #: The same for tables that ``catalog`` alone is read from.
    held: tuple[DataFrame, ...] = ()
    #: Rows, and what makes the catalogue of them: cards and trust, where rows give them themselves.  Searches describe the rows of hits alone.
    bare: tuple[DataFrame, Step] | None = None

    TABLES = ("catalog", "points", "terms", "stats", "frequencies")
    #: What each saved table is sorted by, and the keys that it is looked up by.
    LAYOUT = {"catalog": (["id"], ["id"]), "points": (["source", "mcp_id", "ordinal"], ["point_id", "mcp_id"]), "terms": (["point_id"], ["point_id"]), "stats": (["n"], []), "frequencies": (["term"], ["term"])}

    def save(self, path: str) -> None:
        """Write all tables; readers see the old ones until a new path is given to them."""
        if "text" not in self.points.columns:
            raise ValueError("an index without the texts of its points is not saved")
        for name in self.TABLES:
            points.write_for_lookups(getattr(self, name), f"{path}/{name}", *self.LAYOUT[name])
        points.write_for_lookups(points.categories_of(self.points), f"{path}/categories", ["category", "point_id"], ["point_id"])
        if self.lists and self.blocks:
            self.lists.save(f"{path}/lists"), self.blocks.save(f"{path}/blocks")
        self.points.sparkSession.createDataFrame([(self.dim, bool(self.lists and self.blocks))], "dim int, retrieval boolean").write.mode("overwrite").parquet(f"{path}/dim")

    @classmethod
    def load(cls, spark: SparkSession, path: str, dim: int | None = None) -> Index:
        said = spark.read.parquet(f"{path}/dim").first().asDict()
        have = said["dim"]
        if dim is not None and dim != have:
            raise ValueError(f"the index has vectors of length {have}, not {dim}")
        more = {"lists": DenseIndex.load(spark, f"{path}/lists"), "blocks": SparseIndex.load(spark, f"{path}/blocks")} if said.get("retrieval") else {}
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in cls.TABLES}
        if "term" in tables["terms"].columns:  # as earlier versions saved it
            tables["terms"] = encode.gathered(tables["terms"], "point_id")
        return cls(**tables, dim=have, **more)

    @property
    def plain(self) -> DataFrame:
        return self.bare[0] if self.bare else self.catalog

    def described(self, rows: DataFrame) -> DataFrame:
        """Rows of ``plain`` as the catalogue has them."""
        return self.bare[1](rows) if self.bare else rows

    def scored(self) -> DataFrame:
        """The terms of each point with its light columns."""
        return self.scanned if self.scanned is not None else self.terms.join(self.points.select(*[c for c in self.LIGHT if c != "vector"]), "point_id")

    LIGHT = ("point_id", "mcp_id", "kind", "tool_name", "ordinal", "source", "categories", "vector")

    def with_retrieval(self, share: float | None = None) -> Index:
        """The index with inverted lists of its vectors and blocks of its postings; queries then visit ``share`` of the points."""
        lists = DenseIndex.build(self.points.select(*self.LIGHT))
        return replace(self, lists=replace(lists, share=share) if share else lists, blocks=SparseIndex.build_rows(self.scored()))

    def persist(self) -> Index:
        for name in self.TABLES:
            getattr(self, name).persist()
        return self


def build(catalog: DataFrame, config: Config = Config(), as_of: str = "1970-01-01T00:00:00Z", steps: Steps = Steps(), texts: bool = True, keep: dict[str, Column] | None = None) -> Index:
    """Resolve, extract, enrich, score, explode and encode ``catalog`` (with ``pos``).

    Rows are stored once, and once more where a stage calls other machines, so that
    no call is made twice; cards and trust that a row gives itself are made as it is
    read.  Points are stored once, each with its text, terms and vector, which are
    made within the row: of points only what tells doubles apart is shuffled.  Searches
    read no text of a point, so an index that is searched and not saved does without ``texts``.
    Points and their terms have the columns ``keep`` of their rows as well.
    """
    rows = resolve.dedup(catalog)
    held = rows._tessera_made
    own_cards = config.enricher == "heuristic" and not steps.enrich

    def described(rows: DataFrame) -> DataFrame:
        rows = steps.extract(rows) if steps.extract else rows
        if steps.enrich or own_cards:
            rows = (steps.enrich or enrich.enrich)(rows)
        if config.trust == "heuristic" or steps.trust:
            rows = enrich.score_trust(rows, as_of)
        return steps.trust(rows) if steps.trust else rows

    plain, rows, calls = rows, described(rows), steps.extract or steps.enrich or steps.trust
    if calls:
        rows = store(rows, "catalog")
    less = () if texts or steps.embed else ("text", "query")
    made = store(encode.with_bags(_told_apart(rows, keep, not own_cards), "text", dim=None if steps.embed else config.embed_dim, without=less), "points")
    unique, light = made.where("copy = 1").drop("copy", *encode.BAG), [c for c in (*Index.LIGHT, *(keep or {})) if c != "vector"]
    doc = F.when(F.col("copy") == 1, F.col("point_id")).otherwise(F.concat_ws("|", "point_id", "ordinal", "copy"))
    counts, kept = encode.counts_of(made.withColumn("doc", doc), "doc"), made.where("copy = 1")
    frequencies = store(encode.document_frequencies(counts), "frequencies")
    if steps.fit is None:
        stats = store(encode.stats_of(made), "stats")
    else:
        try:
            stats = store(steps.fit(counts), "stats")
        except Exception as error:  # noqa: BLE001  the dense side can do without what was handed in
            warnings.warn(f"no sparse index: {error}", stacklevel=2)
            stats, kept = made.sparkSession.createDataFrame([(0, 0.0)], "n bigint, avgdl double"), kept.limit(0)
    if encode.chosen(config.sparse, stats) == "bm25":
        scanned = encode.bm25_bags(kept, stats, light, config.bm25_k1, config.bm25_b)
    else:
        scanned = encode.tf_bags(kept, light)
    if steps.embed:
        dense = points.ensure_dimension(store(steps.embed(unique.select("point_id", "text")), "embedded"), "vector", config.embed_dim)
        zero = F.array_repeat(F.lit(0.0).cast("float"), config.embed_dim)
        unique = store(unique.join(dense, "point_id", "left").withColumn("vector", F.coalesce("vector", zero)), "vectors")
    return Index(rows, unique, scanned.select("point_id", "ts", "ws"), stats, frequencies, config.embed_dim, scanned=scanned, made=(made, frequencies), held=held, bare=None if calls else (plain, described))


def _told_apart(rows: DataFrame, keep: dict[str, Column] | None = None, asked: bool = True) -> DataFrame:
    """The points of ``rows`` with ``copy``: 1 for the last point of each id, from 2 on for the others.

    Only rows that share their id, or have points that share theirs, can have others, so only their points meet.
    Cards that rows give themselves have no query twice, and are not made to look for one (``asked``).
    """
    odd = store(rows.groupBy(F.col("id").alias("mcp_id")).agg(F.count("*").alias("n"), F.max(points.doubles(asked)).alias("doubles")).where("n > 1 OR doubles").select("mcp_id"), "doubles")
    exploded, n = points.build_points(rows, keep), odd.count()
    if not n:
        return exploded.withColumn("copy", F.lit(1))
    odd = F.broadcast(odd) if n <= resolve.FEW else odd
    place = F.row_number().over(W.partitionBy("point_id").orderBy(F.desc("ordinal")))
    return exploded.join(odd, "mcp_id", "left_anti").withColumn("copy", F.lit(1)).unionByName(exploded.join(odd, "mcp_id", "left_semi").withColumn("copy", place))


def refresh(old: Index, new: Index, prune: bool = True) -> Index:
    """``new`` over ``old``: rows and points of the same identity are replaced; with ``prune`` so are all points of the ids in ``new``.

    Records that vanished from the sources stay, as nothing says that they are gone.
    """
    ids = new.catalog.select(F.col("id").alias("mcp_id"))
    kept = points.delete_by_parent(old.points, ids) if prune else old.points
    merged = points.upsert(kept, new.points)
    terms = old.terms.join(merged.select("point_id"), "point_id", "left_semi").join(new.points.select("point_id"), "point_id", "left_anti").unionByName(new.terms)
    catalog = points.upsert(old.catalog, points.last_write_wins(new.catalog, "id", [F.col("pos")]) if "pos" in new.catalog.columns else new.catalog, "id")
    return Index(catalog, merged, terms, new.stats, new.frequencies, new.dim)
