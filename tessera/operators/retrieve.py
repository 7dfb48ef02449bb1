"""Set-oriented retrieval: nearest neighbours, inverted index, fusion, collapse."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..scratch import ship, store

RRF_K = 2
#: Queries that one block of exact search holds; each block is broadcast.
BLOCK = 2_000
#: Rows that are kept for the queries of a block at the end of a task.
ROWS = 1 << 17
#: Keys that are broadcast where the rows that have them are wanted.
FEW = 1 << 18
#: Scores, or products of shared terms, that a task holds at once.
AT_ONCE = 1 << 21
#: Terms of points that a task meets with a block of queries at once, or one point's.
TERMS = 1 << 19


def top(rows: DataFrame, key: str, score: Column, limit, ties: list) -> DataFrame:
    """The best ``limit`` rows of each key with ``pos`` from 0; scores equal to nine decimals tie."""
    w = W.partitionBy(key).orderBy(F.round(score, 9).desc(), *ties)
    return rows.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < limit)


def passes(q_source: Column, q_categories: Column, source: Column, categories: Column) -> Column:
    """The filter of a query: its source exactly, any of its categories."""
    return ((q_source == "") | (source == q_source)) & ((F.size(q_categories) == 0) | F.arrays_overlap(categories, q_categories))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class _Filters:
    """Which rows of a batch pass the filters of a query; most queries have none."""

    def __init__(self, batch: pa.RecordBatch):
        self.source, self.categories = batch.column("source"), batch.column("categories")
        self.known: dict[tuple, np.ndarray] = {}

    def _has(self, kind: str, value: str) -> np.ndarray:
        if (kind, value) not in self.known:
            if kind == "source":
                mask = pc.fill_null(pc.equal(self.source, value), False).to_numpy(zero_copy_only=False)
            else:
                owner = pc.list_parent_indices(self.categories).to_numpy()
                mask = np.zeros(len(self.categories), bool)
                mask[owner[pc.fill_null(pc.equal(self.categories.flatten(), value), False).to_numpy(zero_copy_only=False)]] = True
            self.known[kind, value] = mask
        return self.known[kind, value]

    def passing(self, source: str, categories: list[str]) -> np.ndarray | None:
        mask = self._has("source", source) if source else None
        if categories:
            some = np.logical_or.reduce([self._has("category", c) for c in categories])
            mask = some if mask is None else mask & some
        return mask


class _Kept:
    """The best ``limit`` rows of a partition for each query of a block."""

    def __init__(self, ids: list[int], filters: list[tuple] | None, limit: int, ties: list[str], names: list[str]):
        self.ids, self.filters, self.limit, self.ties, self.names, self.held = ids, filters, limit, ties, names, None

    def add(self, rows: pa.RecordBatch, scores: np.ndarray, found: np.ndarray | None = None) -> None:
        """``scores`` and, if not all count, which are ``found``: a row for each query, a column for each row."""
        order = pc.sort_indices(pa.table({t: rows.column(t) for t in self.ties}), [(t, "ascending") for t in self.ties]).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        own = _Filters(rows) if self.filters else None
        who, taken, values = [], [], []
        for i, qid in enumerate(self.ids):
            mask = own.passing(*self.filters[i]) if own else None
            if found is not None:
                mask = found[i] if mask is None else mask & found[i]
            at = np.arange(rows.num_rows) if mask is None else np.flatnonzero(mask)
            rounded = np.round(scores[i, at], 9)
            if len(at) > self.limit:
                best = rounded >= np.partition(rounded, len(at) - self.limit)[len(at) - self.limit]
                at, rounded = at[best], rounded[best]
            at = at[np.lexsort((place[at], -rounded))[: self.limit]]
            who += [qid] * len(at)
            taken.append(at), values.append(scores[i, at])
        take = pa.array(np.concatenate(taken))
        table = pa.table([pa.array(who, pa.int64()), *[rows.column(n).take(take) for n in self.names], pa.array(np.concatenate(values))], names=["qid", *self.names, "score"])
        self.held = table if self.held is None else pa.concat_tables([self.held, table])
        if self.held.num_rows > 4 * self.limit * len(self.ids):
            self.held = _best(self.held, self.limit, self.ties)

    def batches(self):
        return _best(self.held, self.limit, self.ties).to_batches() if self.held is not None else []


def _nearest(shared, limit: int, ties: list[str], names: list[str]):
    """The best ``limit`` rows of a partition for each query of a block, some rows at a time."""

    def run(batches):
        ids, vectors, lengths, filters = shared.value
        kept = _Kept(ids, filters, limit, ties, names)
        for batch in batches:
            for start in range(0, batch.num_rows, step := max(1, AT_ONCE // len(ids))):
                rows = batch.slice(start, step)
                points = _matrix(rows.column("vector"))
                norms = np.sqrt((points * points).sum(axis=1))
                scale = lengths[:, None] * norms[None, :]
                kept.add(rows, np.divide(vectors @ points.T, scale, out=np.zeros_like(scale), where=scale > 0))
        yield from kept.batches()

    return run


def _few_terms(batches):
    """The rows of the batches in parts of bounded terms, whatever the rows of a batch."""
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("ts").offsets.to_numpy()), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TERMS, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch  # before the next one is read


def _sharing(shared, limit: int, ties: list[str], names: list[str]):
    """The best ``limit`` rows of a partition for each query of a block, of those that share a term with it: a row's terms meet the queries in an index by term."""

    def run(batches):
        ids, filters, vocabulary, counts, queries, weights = shared.value
        ends, kept = np.cumsum(counts), _Kept(ids, filters, limit, ties, names)
        for batch in _few_terms(batches):
            size = np.diff(batch.column("ts").offsets.to_numpy())
            row, terms, own = np.repeat(np.arange(batch.num_rows), size), batch.column("ts").flatten().to_numpy(), batch.column("ws").flatten().to_numpy()
            at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
            known = vocabulary[at] == terms
            row, at, own = row[known], at[known], own[known]
            held = np.cumsum(counts[at])
            start = 0
            while start < batch.num_rows:  # as many rows as there is room for
                lo = np.searchsorted(row, start)
                room = np.searchsorted(held, (held[lo - 1] if lo else 0) + AT_ONCE, side="right")
                stop = batch.num_rows if room >= len(row) else max(start + 1, int(row[room]))
                stop = min(stop, start + max(1, AT_ONCE // len(ids)), batch.num_rows)
                hi = np.searchsorted(row, stop)
                many = counts[at[lo:hi]]
                entry = np.repeat(ends[at[lo:hi]] - np.cumsum(many), many) + np.arange(many.sum())
                place = queries[entry] * (stop - start) + np.repeat(row[lo:hi] - start, many)
                scores = np.bincount(place, np.repeat(own[lo:hi], many) * weights[entry], minlength=len(ids) * (stop - start))
                found = np.zeros(len(scores), bool)
                found[place] = True
                kept.add(batch.slice(start, stop - start), scores.reshape(len(ids), -1), found.reshape(len(ids), -1))
                start = stop
            del batch, row, terms, own, at, known, held  # before more are read
        yield from kept.batches()

    return run


def _best(table: pa.Table, limit: int, ties: list[str]) -> pa.Table:
    table = table.append_column("_s", pa.array(-np.round(table.column("score").to_numpy(), 9)))
    table = table.take(pc.sort_indices(table, [("qid", "ascending"), ("_s", "ascending"), *[(t, "ascending") for t in ties]]))
    qid = table.column("qid").to_numpy()
    first = np.searchsorted(qid, qid)
    return table.filter(pa.array(np.arange(len(qid)) - first < limit)).drop_columns(["_s"])


def block_size(limit: int) -> int:
    """Queries of a block of which each keeps ``limit`` rows."""
    return max(1, min(BLOCK, ROWS // max(1, limit)))


def _nothing(batches):
    return iter(())


def in_blocks(queries: DataFrame, columns: list[str], block, finish, schema: T.StructType, size: int = BLOCK, whole=None) -> DataFrame:
    """``finish(block(rows))`` for the queries in blocks of about ``size`` rows, one after another; each result is stored before the next begins.

    So the driver and the executors hold one block at a time, however many queries
    there are.  ``whole(rows)`` is the same made in one task: where it is given, several
    blocks are taken side by side instead, as many as the cluster runs at once, and what
    is shuffled is the best rows of a query and not those of each partition of points.
    """
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // size))
    if blocks == 1:
        rows = queries.select(*columns).collect()  # at most ``size`` rows
        return finish(block(rows) if rows else spark.createDataFrame([], schema))
    kept = store(queries.select(*columns), "queries")
    found, at_once = [], spark.sparkContext.defaultParallelism if whole else 1
    for first in range(0, blocks, at_once):
        parts = []
        for b in range(first, min(blocks, first + at_once)):
            rows = kept.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()  # about ``size`` rows
            if rows:
                parts.append((whole or block)(rows))
        if parts and whole:  # a union keeps the partitioning that all its parts share, and parts of one task each would be one task
            parts.append(spark.range(0, 2, 1, 2).mapInArrow(_nothing, schema))
        if parts:
            found.append(store(finish(reduce(DataFrame.unionByName, parts)), "found"))
    return reduce(DataFrame.unionByName, found)


def dense_candidates(queries: DataFrame, points: DataFrame, limit: int, point: str = "point_id", ties: list[str] | None = None) -> DataFrame:
    """qid, the columns of ``points`` but its vector, score and pos by cosine, of the best ``limit`` points of each query.

    ``queries`` (qid, qvec, source, categories) are a stated set, taken in
    blocks of bounded size; a block is compared with a batch of points by one
    matrix product, and only each partition's best rows are shuffled.
    """
    ship(points.sparkSession)
    ties = ties or [point]
    names = [c for c in points.columns if c != "vector"]
    schema = T.StructType([T.StructField("qid", T.LongType()), *[points.schema[n] for n in names], T.StructField("score", T.DoubleType())])

    def block(rows: list, side: DataFrame = points) -> DataFrame:
        vectors = np.array([r["qvec"] for r in rows], np.float64)
        shared = points.sparkSession.sparkContext.broadcast(([r["qid"] for r in rows], vectors, np.sqrt((vectors * vectors).sum(axis=1)), [(r["source"] or "", r["categories"] or []) for r in rows]))
        return side.mapInArrow(_nearest(shared, limit, ties, names), schema)

    asked = queries.withColumn("qid", F.col("qid").cast("long"))
    return in_blocks(asked, ["qid", "qvec", "source", "categories"], block, lambda f: top(f, "qid", F.col("score"), limit, ties), schema, block_size(limit), whole=lambda rows: block(rows, points.coalesce(1)))


def containing(texts: DataFrame, key: str, text: str, patterns: DataFrame, most: int = 32 << 20) -> DataFrame:
    """qid and key of the texts that hold each pattern (qid, query): the patterns of a block are one automaton.

    A block has at most ``most`` bytes of patterns, and is stored before the next begins; empty patterns are held by every text.
    """
    ship(texts.sparkSession)
    sizes = patterns.agg(F.coalesce(F.sum(F.octet_length("query")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(sizes) // most))
    schema = T.StructType([T.StructField("qid", patterns.schema["qid"].dataType), T.StructField(key, texts.schema[key].dataType)])
    kept = store(patterns.select("qid", "query"), "patterns") if blocks > 1 else patterns
    parts = []
    for b in range(blocks):
        rows = kept.where(F.col("query").isNotNull() & (F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)).select("qid", "query").collect()
        by_text: dict[str, list] = {}
        for r in rows:
            by_text.setdefault(r["query"], []).append(r["qid"])
        shared = texts.sparkSession.sparkContext.broadcast(by_text)
        found = texts.select(key, text).mapInArrow(_holding(shared, schema.names), schema)
        parts.append(store(found, "holding") if blocks > 1 else found)
        if blocks > 1:
            shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def _holding(shared, names: list[str]):
    def run(batches):
        import ahocorasick

        by_text = shared.value
        machine = ahocorasick.Automaton()
        for pattern in by_text:
            if pattern:
                machine.add_word(pattern, pattern)
        if len(machine):
            machine.make_automaton()
        for batch in batches:
            qid, row = [], []
            for i, value in enumerate(batch.column(1)):
                value = value.as_py()
                if value is None:
                    continue
                held = {p for _, p in machine.iter(value)} if len(machine) and value else set()
                for p in ({""} & by_text.keys()) | held:
                    qid += by_text[p]
                    row += [i] * len(by_text[p])
            yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), batch.column(0).take(pa.array(row, pa.int64()))], names=names)

    return run


def sparse_scores(query_terms: DataFrame, point_terms: DataFrame, point: str) -> DataFrame:
    """qid, point, score: sums of products over shared terms, by an equi-join on terms."""
    q = query_terms.select("qid", "term", F.col("weight").alias("qw"))
    p = point_terms.select(point, "term", F.col("weight").alias("pw"))
    return p.join(q, "term").groupBy("qid", point).agg(F.sum(F.col("qw") * F.col("pw")).alias("score"))


def sparse_candidates(query_terms: DataFrame, points: DataFrame, limit: int, point: str = "point_id", ties: list[str] | None = None, filters: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` points of each query by ``sparse_scores``: qid, the columns of ``points`` but its terms, score and pos.

    ``points`` has one row for each point with its terms and weights (ts, ws), so a
    point is scored where it lies and only each partition's best rows are shuffled.
    ``query_terms`` (qid, term, weight) are a stated set, taken in blocks of bounded
    size; ``filters`` (qid, source, categories) hold for points with these columns.
    """
    ship(points.sparkSession)
    ties = ties or [point]
    names = [c for c in points.columns if c not in ("ts", "ws")]
    schema = T.StructType([T.StructField("qid", T.LongType()), *[points.schema[n] for n in names], T.StructField("score", T.DoubleType())])
    asked = query_terms.groupBy(F.col("qid").cast("long").alias("qid")).agg(F.collect_list(F.struct(F.col("term").cast("long").alias("term"), F.col("weight").cast("double").alias("weight"))).alias("entries"))
    if filters is not None:
        asked = asked.join(filters.select(F.col("qid").cast("long").alias("qid"), "source", "categories"), "qid")

    def block(rows: list, side: DataFrame = points) -> DataFrame:
        query = np.repeat(np.arange(len(rows)), [len(r["entries"]) for r in rows])
        term, weight = (np.array([e[n] for r in rows for e in r["entries"]], kind) for n, kind in (("term", np.int64), ("weight", np.float64)))
        order = np.argsort(term, kind="stable")
        own = [(r["source"] or "", r["categories"] or []) for r in rows] if filters is not None else None
        shared = points.sparkSession.sparkContext.broadcast(([r["qid"] for r in rows], own, *np.unique(term, return_counts=True), query[order], weight[order]))
        return side.mapInArrow(_sharing(shared, limit, ties, names), schema)

    return in_blocks(asked, asked.columns, block, lambda f: top(f, "qid", F.col("score"), limit, ties), schema, block_size(limit), whole=lambda rows: block(rows, points.coalesce(1)))


def late(hits: DataFrame, table: DataFrame, key: str, most: int = FEW, described=lambda rows: rows) -> DataFrame:
    """``hits`` with the rows of ``described(table)`` for their ``key``: if they have few keys, only those rows of ``table`` are described and shuffled."""
    hits = store(hits, "hits")
    wanted = store(hits.select(key).distinct(), "wanted")
    few = wanted.count() <= most
    return hits.join(described(table.join(F.broadcast(wanted), key, "left_semi") if few else table), key)


def fuse(dense: DataFrame, sparse: DataFrame, point: str = "point_id", k: int = RRF_K, keep: tuple[str, ...] = ()) -> DataFrame:
    """qid, point, score: reciprocal rank fusion of two rankings with places from 0; ``keep`` are more columns of points."""
    place = lambda d: d.select("qid", point, *keep, (1 / (F.lit(k) + F.col("pos"))).alias("part"))
    return place(dense).unionByName(place(sparse)).groupBy("qid", point, *keep).agg(F.sum("part").alias("score"))


def collapse(hits: DataFrame, limit, parent: str = "mcp_id") -> DataFrame:
    """The best point of each parent, how many of its points surfaced, and its place among parents.

    ``hits`` has qid, parent, kind, tool_name, score and pos; the first of equal points wins.
    """
    best = F.max_by(F.struct("kind", "tool_name"), F.struct(F.round("score", 9), -F.col("pos")))
    one = hits.groupBy("qid", parent).agg(best.alias("b"), F.max("score").alias("score"), F.count("*").alias("match_count"))
    one = one.select("qid", parent, F.col("b.kind").alias("match_kind"), F.col("b.tool_name").alias("matched_tool"), "score", "match_count")
    return top(one, "qid", F.col("score"), limit, [parent])
