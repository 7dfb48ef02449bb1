"""Scratch tables, size-checked joins and tokenizer loading shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import hadoop_path, scratch_root, ship

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def release_memory() -> None:
    """Give freed memory back: workers stay for later tasks, beside the executor's own heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with a function of this package."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


class _Made(threading.local):
    """The scratch tables of each thread that drives Spark."""

    def __init__(self):
        self.paths: list[str] = []


_tables = _Made()


def made() -> int:
    """How many tables ``materialize`` has made so far in this thread."""
    return len(_tables.paths)


def sweep(since: int, keep: DataFrame) -> None:
    """Remove all scratch tables that this thread made after ``since`` but ``keep``, from which no plan may read any more."""
    for path in _tables.paths[since:]:
        if path != keep._tessera_path:
            _remove(keep.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    where, system = hadoop_path(spark, path)
    system.delete(where, True)
    system.cancelDeleteOnExit(where)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage; the table outlives any executor.  Tables are removed
    by ``drop`` or when the driver's JVM ends, whether or not the session was stopped before.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    where, system = hadoop_path(spark, path)
    df.write.parquet(path)
    system.deleteOnExit(where)
    _tables.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove scratch tables made by ``materialize`` that no later plan reads."""
    for table in tables:
        _remove(table.sparkSession, table._tessera_path)


def attach(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = 20_000, salts: int = 32, size: int | None = None) -> DataFrame:
    """Equi-join ``rows`` with a table of one row, or a few, for each key.

    ``small`` is broadcast only when it has at most ``limit`` rows (``size``, if
    the caller has counted them); beyond that the join is salted, so one key may
    hold any share of ``rows``.  The salt is a hash of the row: a stage that is
    run again gives each row the one it had, in whatever order rows come.
    """
    if (small.count() if size is None else size) <= limit:
        return rows.join(F.broadcast(small), on, how)
    told = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*told), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of the names that an operator is about to add, in any letter case."""
    return df.drop(*names)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..., which no operator adds."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named_again(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns c0, c1, ... with their former names, and no others."""
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
