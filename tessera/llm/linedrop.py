"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without ASCII blanks at its ends, A-Z in lower case.
Keys of ``min_chars`` code points or more that ``min_docs`` documents or more
hold lose all their lines but those in the largest doc_id that holds them.

Distinct keys are known by 128-bit hashes.  They are dealt to shards by hash;
each shard has a minimal perfect hash of its keys (levels of bit arrays: a key
stands at the first level where no other fell on its place) that gives each key
its index in compact arrays: a 32-bit fingerprint, a 16-bit count of documents,
and for frequent keys alone the largest doc_id.  Documents do not join lines:
they send the distinct hashes of a block of documents to the shards, once for
each block, are answered from the arrays, and get back the frequent ones.

Bounds: a block has about ``ENTRIES`` hashes, a shard about as many distinct
ones, whatever a line's share of the table; a line in a third of all documents is
one entry of each block.  The number of shards grows with the table.  Texts move
once, to meet the lines that they lose, and not at all where those are few
enough for Spark to broadcast.

Defined results for odd input: a null or empty text is one empty line; each row
is a document, so rows that repeat a doc_id count one by one and all rows of the
largest doc_id keep their lines; a row without doc_id counts but never keeps a
frequent line, unless no holder has an id, when all keep it; of a line twice in a
document both go or stay; very long texts and lines are taken whole; an empty table gives
an empty table; columns named like the added ones are replaced, other extra
columns, whatever their names, pass through.  doc_id is a whole number, other
than the least of 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import ship
from .common import arrow_map, materialize, numbered, replacing

MIN_CHARS, MIN_DOCS = 40, 5
#: Hashes in a block of documents, and in a shard.
ENTRIES = 1 << 16
#: Places for each key at a level of the perfect hash.
GAMMA = 2.0
MOST_LEVELS = 200
NOBODY = -(1 << 63)


def long_keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes]:
    """The keys of the lines of a text in UTF-8, None in the place of shorter ones."""
    keys = [line.strip() for line in text.lower().split(b"\n")]  # of bytes, both mean ASCII
    return [k if len(k) >= min_chars and (k.isascii() or sum((b & 0xC0) != 0x80 for b in k) >= min_chars) else None for k in keys]


def _hash(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    return _mix(hi + _mix(lo + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64))) % np.uint64(size)


@dataclass
class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys (hi, lo)."""

    sizes: list[int]
    bits: np.ndarray  # of all levels, one after another

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(hi):
            if len(sizes) == MOST_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = max(64, int(GAMMA * len(hi)))
            at = _places(hi, lo, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size), levels.append(alone)
            left = ~alone[at]
            hi, lo = hi[left], lo[left]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The index of each key, from 0; -1, or a wrong one, for other keys."""
        rank = np.cumsum(self.bits) - 1
        found, open_, start = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            at = _places(hi[open_], lo[open_], level, size).astype(np.int64) + start
            hit = self.bits[at]
            found[open_[hit]] = rank[at[hit]]
            open_, start = open_[~hit], start + size
        return found

    def pack(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, sizes: list[int], packed: bytes) -> PerfectHash:
        return cls(sizes, np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes)).astype(bool))


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _joined(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.flatten() if isinstance(column, pa.Array) else pa.concat_arrays([c.flatten() for c in column.chunks])


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def held_lines(docs: DataFrame, min_chars: int = MIN_CHARS, entries: int = ENTRIES) -> DataFrame:
    """block, doc_id, mark of the text, and the hashes (hi, lo) of the distinct long keys of each document that has any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= min_chars)

    def run(batches):
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            took, found, blocks = [], [], []
            for i, value in enumerate(batch.column(2)):
                keys = {_hash(k) for k in long_keys(value.as_py(), min_chars) if k is not None}
                if keys:
                    took.append(i), found.append(keys), blocks.append(block)
                    held += len(keys)
                    if held >= entries:
                        block, held = block + 1, 0
            ends = np.concatenate([[0], np.cumsum([len(k) for k in found])]).astype(np.int32)
            pair = np.frombuffer(b"".join(h for k in found for h in k), "<i8").reshape(-1, 2)
            at = pa.array(took, pa.int64())
            lists = [_lists(pa.array(np.ascontiguousarray(pair[:, c])), ends) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), *lists], names=["block", "doc_id", "mark", "hi", "lo"])

    return rows.transform(arrow_map, run, "block long, doc_id long, mark long, hi array<long>, lo array<long>")


def _summed(hi, lo, docs, top):
    """Distinct hashes in order, with their documents added up and their largest id."""
    order = np.lexsort((lo, hi))
    hi, lo, docs, top = hi[order], lo[order], docs[order], top[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
    if not len(first):
        return hi, lo, docs, top
    return hi[first], lo[first], np.add.reduceat(docs, first), np.maximum.reduceat(top, first)


def probes(lines: DataFrame, shards: int) -> DataFrame:
    """shard, block, and the distinct hashes of the block in the shard with the documents that hold them and the largest id."""

    def run(batches):
        def packed(block, parts):
            hi, lo, docs, top = _summed(*[np.concatenate(p) for p in zip(*parts)])
            shard = _mix(hi) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            shard, own = shard[order], [a[order] for a in (hi, lo, docs, top)]
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            ends = np.concatenate([first, [len(shard)]]).astype(np.int32)
            columns = [_lists(a, ends) for a in (_longs(own[0]), _longs(own[1]), pa.array(own[2], pa.int64()), pa.array(own[3], pa.int64()))]
            return pa.RecordBatch.from_arrays([_longs(shard[first]), pa.array(np.full(len(first), block), pa.int64()), *columns], names=["shard", "block", "hi", "lo", "docs", "top"])

        current, parts = None, []
        for batch in batches:
            for block, who, hi, lo in zip(*[batch.column(i) for i in range(4)]):
                if block.as_py() != current:
                    if parts:
                        yield packed(current, parts)
                    current, parts = block.as_py(), []
                n, who = len(hi), who.as_py()
                parts.append((_unsigned(hi.values), _unsigned(lo.values), np.ones(n, np.int64), np.full(n, NOBODY if who is None else who, np.int64)))
        if parts:
            yield packed(current, parts)

    return lines.select("block", "doc_id", "hi", "lo").transform(arrow_map, run, "shard long, block long, hi array<long>, lo array<long>, docs array<long>, top array<long>").withColumn("of", F.lit(shards).cast("long"))


INDEX = "shard long, of long, n long, sizes array<long>, bits binary, fingerprints binary, counts binary, frequent array<long>, keeper array<long>"


def build(sent: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The index, a row for each shard (and ``of`` how many): perfect hash, fingerprint and count arrays, and the keeper of each frequent key.

    Counts stop at 65,535, so ``min_docs`` may be no larger.
    """
    if not 0 < min_docs <= 65_535:
        raise ValueError("min_docs must be from 1 to 65,535")
    ship(sent.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        hi, lo, docs, top = _summed(*[_unsigned(_joined(group, c)) for c in ("hi", "lo")], *[_joined(group, c).to_numpy(zero_copy_only=False) for c in ("docs", "top")])
        function = PerfectHash.build(hi, lo)
        at = function.index(hi, lo)
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        counts = np.minimum(docs[place], 65_535).astype("<u2")
        frequent = np.flatnonzero(counts >= min_docs)
        return pa.table({
            **{c: pa.array([group.column(c)[0].as_py()], pa.int64()) for c in ("shard", "of")}, "n": pa.array([len(hi)], pa.int64()), "sizes": pa.array([function.sizes], pa.list_(pa.int64())), "bits": pa.array([function.pack()], pa.binary()),
            "fingerprints": pa.array([lo[place].astype("<u4").tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()),
            "frequent": pa.array([frequent], pa.list_(pa.int64())), "keeper": pa.array([top[place][frequent]], pa.list_(pa.int64())),
        })

    return sent.groupBy("shard").applyInArrow(run, INDEX)


def shards_of(index: DataFrame) -> int:
    """How many shards the keys of ``index`` are dealt to."""
    return (index.select("of").first() or [1])[0]


def probe(sent: DataFrame, index: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """block and its frequent hashes (hi, lo) with their keeper, from the arrays of ``index`` alone."""
    ship(sent.sparkSession)

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        blocks = np.repeat(asked.column("block").to_numpy(), pc.list_value_length(asked.column("hi")).to_numpy())
        hi, lo = [_unsigned(_joined(asked, c)) for c in ("hi", "lo")]
        if own.num_rows and len(hi):
            row = {c: own.column(c)[0] for c in own.column_names}
            at = PerfectHash.unpack(row["sizes"].as_py(), row["bits"].as_py()).index(hi, lo)
            fingerprints, counts = np.frombuffer(row["fingerprints"].as_py(), "<u4"), np.frombuffer(row["counts"].as_py(), "<u2")
            hit = (at >= 0) & (fingerprints[at] == lo.astype("<u4")) & (counts[at] >= min_docs)
            keeper = row["keeper"].values.to_numpy()[np.searchsorted(row["frequent"].values.to_numpy(), at[hit])]
        else:
            hit, keeper = np.zeros(len(hi), bool), np.zeros(0, np.int64)
        return pa.table({"block": pa.array(blocks[hit], pa.int64()), "hi": _longs(hi[hit]), "lo": _longs(lo[hit]), "keeper": pa.array(keeper, pa.int64())}).filter(pa.array(keeper != NOBODY))

    sides = sent.select("shard", "block", "hi", "lo").groupBy("shard"), index.groupBy("shard")
    return sides[0].cogroup(sides[1]).applyInArrow(run, "block long, hi long, lo long, keeper long")


def losses(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """doc_id, mark, and the hashes that the document loses, for those that lose any."""
    ship(lines.sparkSession)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        keeper = dict(zip(zip(found.column("hi").to_pylist(), found.column("lo").to_pylist()), found.column("keeper").to_pylist()))
        rows = []
        for who, mark, hi, lo in zip(*[docs.column(c).to_pylist() for c in ("doc_id", "mark", "hi", "lo")] if keeper else [[]] * 4):
            gone = [h for h in zip(hi, lo) if keeper.get(h, who) != who]
            if gone:
                rows.append((who, mark, np.array(gone, "<i8").tobytes()))
        columns = list(zip(*rows)) or [[]] * 3
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "mark", "gone"), columns, (pa.int64(), pa.int64(), pa.binary()))})

    return lines.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(run, "doc_id long, mark long, gone binary")


def index_of(lines: DataFrame, min_docs: int = MIN_DOCS, entries: int = ENTRIES) -> tuple[DataFrame, DataFrame]:
    """What the blocks of ``lines`` ask, and the index of all their keys."""
    total = lines.agg(F.sum(F.size("hi"))).first()[0] or 0
    sent = materialize(probes(lines, max(1, -(-total // entries))), "probes")
    return sent, materialize(build(sent, min_docs), "line-index")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, entries: int = ENTRIES) -> DataFrame:
    """``docs`` with the lines left in ``text``, n_lines before and n_dropped."""
    lines = materialize(held_lines(docs, min_chars, entries), "lines")
    sent, index = index_of(lines, min_docs, entries)
    lost = materialize(losses(lines, probe(sent, index, min_docs)), "losses")
    # rows of one id and text lose the same
    lost = lost.groupBy("doc_id", "mark").agg(F.min("gone").alias("gone"))
    docs = replacing(docs, "n_lines", "n_dropped")
    names = docs.columns
    own = {n.lower(): f"c{i}" for i, n in enumerate(names)}
    rows = numbered(docs)
    same = F.col(own["doc_id"]).cast("long").eqNullSafe(lost["doc_id"]) & (F.xxhash64(own["text"]) == lost["mark"])
    rows = rows.join(lost, same, "left").select(rows["*"], "gone")
    at, gone_at = rows.columns.index(own["text"]), len(names)
    schema = T.StructType([*rows.drop("gone").schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(pc.cast(batch.column(at), pa.binary()), batch.column(gone_at)):
                if gone.is_valid:
                    text, drop = text.as_py(), {gone.as_py()[i : i + 16] for i in range(0, len(gone.as_py()), 16)}
                    before = text.split(b"\n")
                    left = [line for line, key in zip(before, long_keys(text, min_chars)) if key is None or _hash(key) not in drop]
                    texts.append(b"\n".join(left)), n_lines.append(len(before)), n_dropped.append(len(before) - len(left))
                else:
                    text = text.as_py()
                    texts.append(text), n_lines.append(1 + (text or b"").count(b"\n")), n_dropped.append(0)
            columns = [c for i, c in enumerate(batch.columns) if i != gone_at]
            columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    out = rows.transform(arrow_map, run, schema)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "n_lines", "n_dropped")


ORACLE = r"""
WITH lines AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT k.*, coalesce(f.keeper <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
