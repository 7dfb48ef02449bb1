"""Keeps a search index up to date with records that land as files.

    spark-submit jobs/catalog_feed.py --landing IN --out OUT --checkpoint CP [--config FILE]

``IN`` is a folder, or a pattern of files and folders.  A file stream takes the files that are new since the last run, with what the
checkpoint says, and ends.  For each batch of files:

1. ``records`` keeps what landed, as catalogue rows, in partitions of bucket and
   batch.  A bucket is a hash of the record's identity (name, else repository,
   else id), so rows to be merged lie together.  Rows without an id go to
   ``rejected`` instead.
2. The buckets that the batch touches are made anew from their records: of each
   source and id the last version, without deleted ones; identities resolved and
   merged; cards and trust; points, their vectors and their terms.
3. Those buckets of ``catalog``, ``points`` and ``terms`` are overwritten, the
   others are not read.

A record whose identity changed leaves a note in its former bucket, which is
made anew too.

Reruns: a batch that was cut off is taken again by the stream with the same
number and files, overwrites its own partitions of ``records``, and makes its
buckets from them; nothing is ever made from the tables that it overwrites.  A
run without new files changes nothing.  A landed file is read once; a new
version of a record comes in a new file.  The result does not depend on how files
fell into batches, as long as ``revision`` orders the versions of a record;
equal ones count in the order of their batches.

Sizes: buckets are as many as keep one bucket's records within what a few tasks
rewrite at once; a batch that touches all of them rewrites the index.  Term
weights are those of term frequencies, which depend on a point alone; weights
that depend on the whole corpus would change every bucket with each new row.

Odd input: columns that are missing or null count as empty; rows that repeat
one another count once; records that share an id in several sources are merged
only by identity; an empty folder gives no tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command, replace_partitions, session, settings
from tessera.functions import text as X
from tessera.operators import encode, points, resolve, retrieve
from tessera.plans import index as index_plan
from tessera.plans.config import Config
from tessera.schema import fields, normalized
from tessera.scratch import drop, store

TABLES = ("catalog", "points", "terms")


@dataclass(frozen=True)
class Feed:
    """``columns``: catalogue columns as SQL over a landed row; ``revision`` and ``deleted`` likewise.  ``schema``: of the files, else their own."""

    columns: dict[str, str]
    revision: str = "0L"
    deleted: str = "false"
    format: str = "parquet"
    schema: str = ""
    buckets: int = 64
    files_per_batch: int = 1000
    as_of: str = "1970-01-01T00:00:00Z"
    search: dict = field(default_factory=dict)

    def config(self) -> Config:
        return Config(**self.search | {"sparse": "tf"})


def bucket_of(name: Column, repository: Column, id_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(resolve.identity_key(name, repository, id_)), F.lit(buckets)).cast("int")


def parse(rows: DataFrame, feed: Feed) -> DataFrame:
    """Landed rows as catalogue rows with revision, deleted and bucket."""
    given = {n: F.expr(e) for n, e in feed.columns.items()}
    wide = rows.select(*[c.alias(n) for n, c in given.items()], F.expr(feed.revision).cast("bigint").alias("revision"), F.coalesce(F.expr(feed.deleted).cast("boolean"), F.lit(False)).alias("deleted"))
    known = normalized(wide, F.coalesce("revision", F.lit(0).cast("bigint")).alias("revision"), "deleted")
    return known.withColumn("bucket", bucket_of(F.col("name"), F.col("repository"), F.col("id"), feed.buckets))


def _read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def moved(rows: DataFrame, known: DataFrame | None) -> DataFrame | None:
    """Notes for the buckets that records of ``rows`` lay in before, where those are others: the record is no longer there."""
    if known is None:
        return None
    before = known.where(~F.col("deleted")).select("source", "id", F.col("bucket").alias("was")).distinct()
    away = rows.join(before, ["source", "id"]).where("was <> bucket")
    return away.select("source", "id", "revision", F.lit(True).alias("deleted"), F.col("was").alias("bucket")).transform(normalized, "revision", "deleted", "bucket")


def latest(records: DataFrame) -> DataFrame:
    """The last version of each source's id, if it is not deleted there; equal versions count by batch, then by content."""
    keys = ["bucket", "source", "id"]
    odd = store(records.groupBy(*keys).agg(F.count("*").alias("n"), F.max("deleted").alias("gone")).where("n > 1 OR gone").select(*keys), "versions")
    n = odd.count()
    if n > retrieve.FEW:
        return _last(records)
    odd = F.broadcast(odd)  # the others are neither shuffled nor compared
    return records.join(odd, keys, "left_anti").unionByName(_last(records.join(odd, keys, "left_semi"))) if n else records


def _last(records: DataFrame) -> DataFrame:
    content = F.xxhash64(*[n for n, _ in fields()])
    return points.last_write_wins(records.withColumn("_k", F.struct("bucket", "source", "id")), "_k", [F.col("revision"), F.col("batch"), ~F.col("deleted"), content]).where(~F.col("deleted")).drop("_k")


class Batches:
    """Applies batches of landed rows to the tables of ``out``."""

    def __init__(self, out: str, feed: Feed):
        self.out, self.feed, self.read, self.touched = out, feed, 0, 0

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark, feed, out = rows.sparkSession, self.feed, self.out
        landed = store(parse(rows, feed), "landed")
        good = landed.where(~X.blank(F.col("id")))
        n, bad = landed.count(), landed.where(X.blank(F.col("id")))
        numbered = lambda d: d.withColumn("batch", F.lit(batch).cast("bigint"))
        known = _read(spark, f"{out}/records")
        notes = moved(good, known.where(F.col("batch") < batch) if known is not None else None)
        every = numbered(good if notes is None else good.unionByName(notes.select(*good.columns)).distinct())
        replace_partitions(every.repartition("bucket"), f"{out}/records", "bucket", "batch")
        rejected = bad.count()
        if rejected:
            replace_partitions(numbered(bad), f"{out}/rejected", "batch")
        touched = [r["bucket"] for r in every.select("bucket").distinct().collect()]  # at most as many as there are buckets
        drop(landed)
        if touched:
            self._rebuild(spark, touched, batch)
        self.read, self.touched = self.read + n, self.touched + len(touched)
        LOG.info("batch %d: read %d rows, rejected %d, made %d of %d buckets anew", batch, n, rejected, len(touched), feed.buckets)

    def _rebuild(self, spark: SparkSession, touched: list[int], batch: int) -> None:
        mine = spark.read.parquet(f"{self.out}/records").where(F.col("bucket").isin(touched) & (F.col("batch") <= batch))
        rows = latest(mine).withColumn("pos", F.col("id"))
        bucket = bucket_of(F.col("name"), F.col("repository"), F.col("id"), self.feed.buckets)
        made = index_plan.build(normalized(rows, "pos"), self.feed.config(), self.feed.as_of, keep={"bucket": bucket})
        catalog = made.catalog.withColumn("bucket", bucket)
        least = F.min("bucket").alias("least")
        spread = store(catalog.groupBy(F.col("id").alias("mcp_id")).agg(least, F.max("bucket").alias("most")).where("least < most").drop("most"), "spread")
        n = spread.count()

        def placed(rows: DataFrame) -> DataFrame:
            """Rows of an id that lies in several buckets go to the least of them."""
            return rows.join(F.broadcast(spread) if n <= retrieve.FEW else spread, "mcp_id", "left").withColumn("bucket", F.coalesce("least", "bucket")).drop("least") if n else rows

        own_points, own_terms = placed(made.points), placed(made.scored().select("point_id", "mcp_id", "bucket", "ts", "ws")).drop("mcp_id")
        # a row without a key in each bucket made: one that has lost all its rows is overwritten as well
        marks = spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1)
        for name, table in zip(TABLES, (catalog, own_points, own_terms)):
            table = table.unionByName(marks, allowMissingColumns=True).withColumn("batch", F.lit(batch).cast("bigint"))
            replace_partitions(table, f"{self.out}/{name}", "bucket")  # rows lie by bucket since ``records``
            LOG.info("batch %d: wrote %d rows of %s", batch, _read(spark, f"{self.out}/{name}").where(F.col("bucket").isin(touched)).count() - len(touched), name)
            if name == "catalog":
                drop(*made.held)
        drop(*made.made)


def run(spark: SparkSession, landing: str, out: str, checkpoint: str, feed: Feed) -> Batches:
    """Takes in what has landed since the last run, and returns when it has all been applied."""
    schema = feed.schema or spark.read.format(feed.format).load(landing).schema
    stream = spark.readStream.format(feed.format).schema(schema).option("maxFilesPerTrigger", feed.files_per_batch).load(landing)
    batches = Batches(out.rstrip("/"), feed)
    stream.writeStream.foreachBatch(batches).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    LOG.info("read %d new rows of %s, rewrote %d buckets of %s", batches.read, landing, batches.touched, out)
    return batches


def table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the index as it stands."""
    found = _table(spark, out, name)
    return encode.exploded(found, "point_id", "ts", "ws", "weight") if name == "terms" else found


def _table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The same as it is stored: the terms of a point are one row."""
    found = spark.read.parquet(f"{out}/{name}")
    return found.where(F.col("id" if name == "catalog" else "point_id").isNotNull()).drop("bucket", "batch")


def load(spark: SparkSession, out: str, feed: Feed) -> index_plan.Index:
    """The index for searches."""
    catalog, own, terms = (_table(spark, out, n) for n in TABLES)
    stats = own.agg(F.count("*").alias("n")).withColumn("avgdl", F.lit(0.0))
    return index_plan.Index(catalog, own, terms, stats, encode.document_frequencies(encode.exploded(terms, "point_id", "ts", "ws", "weight")), feed.config().embed_dim)


def main() -> None:
    given = command("Keeps a search index up to date with records that land as files.", "landing", "out", "checkpoint")
    spark = session("catalog_feed", given.shared)
    try:
        run(spark, given.landing, given.out, given.checkpoint, settings(Feed, given.config, "catalog_feed"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
