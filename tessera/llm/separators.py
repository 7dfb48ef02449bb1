"""Token counts of documents in flat token files, found by their separators.

A flat file is nothing but token ids; an end-of-document id follows each
document, and no index says where.  Blocks of a file are searched with vector
comparisons, each alone: how many separators it has, the tokens before the
first, between neighbours, and after the last.  A prefix scan over the blocks'
summaries - within groups of blocks, over the groups, and back - tells each
block how many documents ended before it and how many tokens of an unfinished
one reach into it.

Defined results for odd input: a null text is an empty document of 0 tokens; an
empty block changes nothing; tokens after the last separator of a file form a
last document that is not ``terminated``; an empty table gives an empty table;
documents that repeat a key are counted one by one; a document may be longer
than any number of blocks; columns other than key and text, whatever their
names, are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_map, drop, materialize
from .tokens import END_OF_TEXT_ID, byte_bpe

#: Tokens in a block, and blocks in a group of the prefix scan.
BLOCK = 1 << 16
GROUP = 1024


def flatten(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, end_id: int = END_OF_TEXT_ID, folder: str | None = None) -> DataFrame:
    """Flat token files of the rows, one for each partition, as blocks of 16-bit ids.

    file, block, payload, and the keys of the documents in their order in the
    file (``first`` is the place of the first of these): the manifest that the
    files themselves lack.  A separator's text inside a document is ordinary text.
    """
    schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("block", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("first", T.LongType()), T.StructField("keys", T.ArrayType(df.schema[key].dataType))])

    def run(batches):
        bpe = byte_bpe(folder, True)
        file, number, first = TaskContext.get().partitionId(), 0, 0
        held, size, keys = [], 0, []

        def row(payload):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([payload.tobytes()], pa.binary()), pa.array([first], pa.int64()), pa.array([keys], pa.list_(kind))], names=schema.names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.types[0]
            for name, value in zip(batch.column(0), batch.column(1)):
                ids = bpe.encode(value.as_py() or "")
                held += [ids.astype("<u2"), np.array([end_id], "<u2")]
                size += len(ids) + 1
                keys.append(name.as_py())
                if size >= block:
                    flat = np.concatenate(held)
                    for at in range(0, size - block + 1, block):
                        yield row(flat[at : at + block])
                        number, first, keys = number + 1, first + len(keys), []
                    held = [flat[size // block * block :]]
                    size %= block
        if size or keys:
            yield row(np.concatenate(held))

    return df.select(F.col(key), F.col(text)).transform(arrow_map, run, schema)


def read_flat_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, block, payload of flat files on any storage Spark reads.

    A file is read whole into one row, so files are those of one writer task,
    below Spark's limit for binary files.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    step = width * block
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.length("content") / step) - 1, F.lit(0).cast("long")))
    return files.select("file", F.explode(parts).alias("block"), "content").select("file", "block", F.substring("content", F.col("block").cast("int") * step + 1, F.lit(step)).alias("payload"))


def scan(blocks: DataFrame, end_id: int = END_OF_TEXT_ID, dtype: str = "<u2") -> DataFrame:
    """``blocks`` with tokens, ends, head, inner and tail in the place of ``payload``."""
    at = blocks.columns.index("payload")
    kept = [f for f in blocks.schema.fields if f.name != "payload"]
    long = T.LongType()
    schema = T.StructType([*kept, T.StructField("tokens", long), T.StructField("ends", long), T.StructField("head", long), T.StructField("inner", T.ArrayType(long)), T.StructField("tail", long)])

    def run(batches):
        for batch in batches:
            found = []
            for value in batch.column(at):
                ids = np.frombuffer(value.as_py() or b"", dtype)
                ends = np.flatnonzero(ids == end_id)
                if len(ends):
                    found.append((len(ids), len(ends), int(ends[0]), np.diff(ends) - 1, len(ids) - 1 - int(ends[-1])))
                else:
                    found.append((len(ids), 0, len(ids), np.zeros(0, np.int64), len(ids)))
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            tokens, n, head, inner, tail = zip(*found) if found else [()] * 5
            columns += [pa.array(tokens, pa.int64()), pa.array(n, pa.int64()), pa.array(head, pa.int64()), pa.array(inner, pa.list_(pa.int64())), pa.array(tail, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return blocks.transform(arrow_map, run, schema)


def stitch(summaries: DataFrame, group: int = GROUP) -> DataFrame:
    """file, ordinal, n_tokens, terminated of each document, from the summaries of ``scan``."""
    rows = summaries.withColumn("_g", F.floor(F.col("block") / group))
    inside = W.partitionBy("file", "_g").orderBy("block")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"_start": F.coalesce(F.sum("tokens").over(before), F.lit(0)), "_ord": F.coalesce(F.sum("ends").over(before), F.lit(0))})
    # where the last document before this block ended, counted from the start of the group
    rows = rows.withColumn("_stop", F.when(F.col("ends") > 0, F.col("_start") + F.col("tokens") - F.col("tail")))
    rows = rows.withColumn("_last", F.max("_stop").over(before))
    groups = rows.groupBy("file", "_g").agg(F.sum("tokens").alias("gt"), F.sum("ends").alias("ge"), F.max("_stop").alias("gs"), F.max("block").alias("gb"))
    over = W.partitionBy("file").orderBy("_g")
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumns({"g_start": F.coalesce(F.sum("gt").over(earlier), F.lit(0)), "g_ord": F.coalesce(F.sum("ge").over(earlier), F.lit(0)), "_final": F.lead("_g").over(over).isNull()})
    groups = groups.withColumn("g_last", F.coalesce(F.max(F.col("g_start") + F.col("gs")).over(earlier), F.lit(0)))
    rows = rows.join(groups.select("file", "_g", "gb", "g_start", "g_ord", "g_last", "_final"), ["file", "_g"])
    start = F.col("g_start") + F.col("_start")
    carried = start - F.coalesce(F.col("g_start") + F.col("_last"), F.col("g_last"))
    counts = F.when(F.col("ends") > 0, F.concat(F.array(carried + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(carried + F.col("tokens"))
    open_end = F.col("_final") & (F.col("block") == F.col("gb")) & (rest > 0)
    done = F.transform(counts, lambda n, i: F.struct((F.col("g_ord") + F.col("_ord") + i).alias("ordinal"), n.alias("n_tokens"), F.lit(True).alias("terminated")))
    last = F.when(open_end, F.array(F.struct((F.col("g_ord") + F.col("_ord") + F.col("ends")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("terminated")))).otherwise(F.array().cast("array<struct<ordinal:bigint,n_tokens:bigint,terminated:boolean>>"))
    return rows.select("file", F.explode(F.concat(done, last)).alias("d")).select("file", "d.*")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, end_id: int = END_OF_TEXT_ID, folder: str | None = None) -> DataFrame:
    """key and n_tokens of each row: its flat file is written, scanned and stitched."""
    flat = materialize(flatten(df, key, text, block, end_id, folder), "flat")
    summaries = materialize(scan(flat, end_id), "separators")
    drop(flat)
    manifest = summaries.select("file", F.posexplode("keys").alias("i", "key"), "first").select("file", (F.col("first") + F.col("i")).alias("ordinal"), "key")
    return stitch(summaries.drop("keys", "first")).join(manifest, ["file", "ordinal"]).select(F.col("key").alias(key), "n_tokens")
