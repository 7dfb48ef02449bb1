"""Packing of tokenised documents into sequences of a fixed capacity.

Documents are cut every ``capacity`` tokens.  The lengths of all pieces form a
histogram of at most ``capacity`` bars; the driver packs the histogram, not the
pieces (``histpack``), into patterns of lengths.  Each piece has a rank among
those of its length, and patterns are joined back by intervals of ranks.

Ranks are counted in salted parts of each length, whose sizes (a bounded table)
give each part its offset, so one frequent length is spread over many tasks.

Defined results for odd input: a null or empty text is one piece that holds the
end id alone; a very long text is encoded whole, in one row's memory; rows that
repeat a key are documents of their own; pieces that tie in everything are
interchangeable; columns other than key and text, whatever their names, are not
used; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_map, materialize
from .histpack import shortest_pack_first
from .tokens import byte_bpe

CAPACITY = 2048
END_ID = 1
#: Parts in which pieces of one length are ranked: full pieces, and each other length.
FULL_PARTS, PARTS = 4096, 64


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens (and ids) for each piece of each row."""
    fields = [T.StructField(key, df.schema[key].dataType)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids
    schema = T.StructType(fields)

    def run(batches):
        bpe = byte_bpe(folder)
        for batch in batches:
            row, start, length, crc, total, every = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                ids = np.append(bpe.encode(value.as_py() or ""), end_id).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    row.append(i), start.append(at), length.append(len(piece)), crc.append(zlib.crc32(piece.tobytes())), total.append(len(ids))
                    if with_ids:
                        every.append(piece.astype(np.int64))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
            columns += [pa.array(every, pa.list_(pa.int64()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(F.col(key), F.col(text)).transform(arrow_map, run, schema)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots ordered by (length, first rank): that key, the first sequence and the offset."""
    rank: dict[int, int] = {}
    keys, sequence, offset, base = [], [], [], 0
    for pattern, count in patterns:
        at = 0
        for length in pattern:
            first = rank.get(length, 0)
            rank[length] = first + count
            keys.append(length << 44 | first), sequence.append(base - first), offset.append(at)
            at += length
        base += count
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequence, offset))


def dealt(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with ``_part``: rows of one length go to many parts, whatever they hold, so equal rows do too."""
    parts = F.when(F.col("length") == capacity, F.lit(FULL_PARTS)).otherwise(F.lit(PARTS)).cast("long")
    return cut.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts))


def place(cut: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``cut``, a stored table that has ``length`` and ``_part`` (see ``dealt``), with ``sequence_id`` and ``offset``; ``order`` settles ranks within a part."""
    salted = cut
    counts = salted.groupBy("length", "_part").count().collect()  # at most (capacity - 1) * PARTS + FULL_PARTS rows
    histogram: dict[int, int] = {}
    table = []
    for length, p, n in sorted(tuple(r) for r in counts):
        table.append((length << 44 | p, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    table = np.array(table, np.int64).reshape(-1, 2)
    shared = cut.sparkSession.sparkContext.broadcast((table[:, 0], table[:, 1], *_slots(shortest_pack_first(histogram, capacity))))
    rank = F.row_number().over(W.partitionBy("length", "_part").orderBy(*order))
    ranked = salted.withColumn("_rank", rank)
    out = T.StructType([*[f for f in cut.schema.fields if f.name != "_part"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = ranked.columns
    at = {n: names.index(n) for n in ("length", "_part", "_rank")}

    def run(batches):
        parts, offsets, keys, sequence, offset = shared.value
        for batch in batches:
            length, p, r = (batch.column(at[n]).to_numpy().astype(np.int64) for n in ("length", "_part", "_rank"))
            r = r - 1 + offsets[np.searchsorted(parts, length << 44 | p)]
            slot = np.searchsorted(keys, length << 44 | r, "right") - 1
            kept = [batch.column(i) for i, n in enumerate(names) if n not in ("_part", "_rank")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[slot] + r), pa.array(offset[slot])], names=out.names)

    return ranked.transform(arrow_map, run, out)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of every row with its place: see ``pieces`` and ``place``."""
    cut = materialize(dealt(pieces(df, key, text, capacity, end_id, folder, with_ids), capacity), "pieces")
    return place(cut, [key, "start", "ids_crc32"], capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, n_tokens: the token sequences themselves, padded unless as long as a power of two.

    ``packed`` has ``ids``; a sequence holds at most ``capacity`` of them.
    """
    whole = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    exact = F.bit_count(n) == 1
    padded = F.when(exact, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), capacity - n)))
    return whole.select("sequence_id", padded.alias("ids"), n.cast("long").alias("n_tokens"))
