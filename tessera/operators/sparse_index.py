"""Exact sparse top-k without joining every shared term: postings in blocks with upper bounds.

The postings of a term lie in blocks of falling weight, each with its largest
weight; a term that very many points have is dealt to several parts first, each
with blocks of its own.  Beside them each point has one row with all its terms.

A query takes its terms from the rarest on.

1. A few blocks of its rarest terms give the first candidates; their whole scores
   give a threshold, the score of the last wanted place.
2. Let a point's first term be the first in that order that the query shares with
   it.  Its score is then at most the query's weight times the largest weight of
   the block it lies in for that term, plus what the terms after it can give.
   Blocks for which this is below the threshold are left out; every point that
   can reach it lies in another one.
3. The points of the blocks left are candidates, once each, and are scored in
   whole from their own row.

So the blocks of frequent terms, which come last, are mostly never read, and what
is joined is one row for each candidate, not one for each term that it shares.
Postings name a point by a number; filters are applied to the rows of candidates.
Where the blocks left hold more postings than there are points, as for a filter that
few points pass, one pass over the points' rows gives the same with nothing shuffled
but the best rows, and a block of queries takes that.
Weights must not be negative.  A term in any share of the points is many blocks;
queries are a stated set and are taken in blocks, whose terms are broadcast.

Odd input: a query without a term that the points have has no rows; points that
share no term with a query are not found; weights that tie to nine decimals
count as equal, and the points' ids decide; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..scratch import ship, store
from . import retrieve
from .encode import exploded, gathered

NUMBER = "number"

#: Postings in a block, and in a part of a term; first candidates for each wanted place.
BLOCK, PART, SEEDS = 64, 1 << 16, 8
#: Scores that round to the same nine decimals differ by less.
TIE = 2e-9


@dataclass(frozen=True)
class SparseIndex:
    """``terms``: term, df, most; ``postings``: term, part, block, most, points (their numbers); ``forward``: point, what else is known of it, ts (its terms in order), ws, number."""

    terms: DataFrame
    postings: DataFrame
    forward: DataFrame
    point: str

    TABLES = ("terms", "postings", "forward")

    @classmethod
    def build(cls, weights: DataFrame, point: str = "point_id", block: int = BLOCK, part: int = PART) -> SparseIndex:
        """The index of (point, term, weight), one row for each point and term."""
        rows = weights.select(point, F.col("term").cast("bigint").alias("term"), F.col("weight").cast("double").alias("weight")).where("weight > 0")
        return cls.build_rows(gathered(rows, point), point, block, part)

    @classmethod
    def build_rows(cls, rows: DataFrame, point: str = "point_id", block: int = BLOCK, part: int = PART) -> SparseIndex:
        """The same from a row for each point: its terms in order (ts) and their weights (ws), all above 0; searches give other columns back, and filter by ``source`` and ``categories``."""
        others = [c for c in rows.columns if c not in (point, "ts", "ws")]
        forward = store(rows.select(point, *others, "ts", "ws", F.monotonically_increasing_id().alias(NUMBER)), "forward")
        return cls._of(exploded(forward, NUMBER, "ts", "ws", "weight").withColumnRenamed(NUMBER, "p"), forward, point, block, part)

    @classmethod
    def _of(cls, rows: DataFrame, forward: DataFrame, point: str, block: int, part: int) -> SparseIndex:
        terms = store(rows.groupBy("term").agg(F.count("*").alias("df"), F.max("weight").alias("most")), "terms")
        parts = terms.where(F.col("df") > part).select("term", F.ceil(F.col("df") / part).alias("parts"))  # at most a row for each ``part`` postings
        dealt = rows.join(parts, "term", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("p"), "parts"), F.lit(0)).cast("int"))
        place = F.row_number().over(W.partitionBy("term", "part").orderBy(F.desc("weight"), "p")) - 1
        blocks = dealt.withColumn("block", F.floor(place / block).cast("int")).groupBy("term", "part", "block").agg(F.max("weight").alias("most"), F.collect_list("p").alias("points"))
        return cls(terms, store(blocks, "postings"), forward, point)

    def save(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseIndex:
        tables = [spark.read.parquet(f"{path}/{n}") for n in cls.TABLES]
        return cls(*tables, point=tables[2].columns[0])

    @property
    def by(self) -> str:
        """What postings name a point by: its own id, as earlier versions saved them, or its number."""
        return NUMBER if NUMBER in self.forward.columns else self.point

    @property
    def known(self) -> list[str]:
        """The columns of a point that searches give back."""
        return [c for c in self.forward.columns if c not in ("ts", "ws", NUMBER)]

    def beside(self, info: DataFrame) -> SparseIndex:
        """The index with the columns of ``info`` (point and others), unless its rows have them."""
        more = [c for c in info.columns if c not in self.forward.columns]
        return replace(self, forward=self.forward.join(info.select(self.point, *more), self.point)) if more else self

    # ---- searches

    def bounded(self, query_terms: DataFrame) -> DataFrame:
        """qid, term, qw, and ``rest``: what the query's more frequent terms can give at most."""
        known = query_terms.select("qid", F.col("term").cast("bigint").alias("term"), F.col("weight").alias("qw")).join(self.terms, "term")
        after = W.partitionBy("qid").orderBy("df", "term").rowsBetween(1, W.unboundedFollowing)
        before = W.partitionBy("qid").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)
        return known.withColumns({"rest": F.coalesce(F.sum(F.col("qw") * F.col("most")).over(after), F.lit(0.0)), "earlier": F.coalesce(F.sum(F.least("df", F.lit(BLOCK))).over(before), F.lit(0))}).drop("df", "most")

    def left(self, bounded: DataFrame, limit: int, keep: Callable[[DataFrame], DataFrame] | None = None, filters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The blocks (qid, points) that step 2 leaves, and the threshold of each query that has one."""
        wanted = F.broadcast(bounded.where(F.col("earlier") < SEEDS * limit))  # terms of a block of queries
        seeds = self.postings.where("part = 0 AND block = 0").join(wanted, "term")
        first = store(self.scores(self._pairs(seeds, keep), bounded, filters), "seeds")
        last = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"))) == limit
        floor = first.withColumn("_last", last).where("_last").select("qid", F.col("score").alias("floor"))
        reach = F.col("floor").isNull() | (F.col("qw") * F.col("most") + F.col("rest") >= F.col("floor") - TIE)
        return self.postings.join(F.broadcast(bounded.join(floor, "qid", "left")), "term").where(reach).select("qid", "points"), floor

    def _pairs(self, blocks: DataFrame, keep: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
        pairs = blocks.select("qid", F.explode("points").alias(self.by)).distinct()
        if keep is None:
            return pairs
        return keep(pairs if self.by == self.point else pairs.join(self.forward.select(self.by, self.point), self.by).select("qid", self.point))

    def candidates(self, bounded: DataFrame, limit: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """Candidates (qid, and the point or its number) of step 3, and the threshold of each query that has one."""
        left, floor = self.left(bounded, limit, keep)
        return self._pairs(left, keep), floor

    def scores(self, found: DataFrame, bounded: DataFrame, filters: DataFrame | None = None) -> DataFrame:
        """qid, the columns of a point and score of pairs (qid, point or number): the row of each point is read once for all its queries, which are broadcast."""
        spark = found.sparkSession
        ship(spark)
        rows = bounded.select("qid", "term", "qw").toArrow()  # a block of queries
        qid, term = rows.column("qid").to_numpy(), rows.column("term").to_numpy()
        order = np.argsort(term, kind="stable")
        ids, place = np.unique(qid, return_inverse=True)
        own = None
        if filters is not None:
            said = {r["qid"]: (r["source"] or "", r["categories"] or []) for r in filters.join(F.broadcast(bounded.select("qid").distinct()), "qid").select(F.col("qid").cast("long").alias("qid"), "source", "categories").collect()}
            own = [said[q] for q in ids.tolist()]
        shared = spark.sparkContext.broadcast((ids, own, *np.unique(term, return_counts=True), place[order], rows.column("qw").to_numpy()[order]))
        by = self.by if self.by in found.columns else self.point
        pairs = store(found.groupBy(by).agg(F.collect_list(F.col("qid").cast("long")).alias("qids")), "pairs")
        few = (pairs.agg(F.sum(F.size("qids"))).first()[0] or 0) <= 2 * retrieve.FEW  # then no row of terms is shuffled
        schema = T.StructType([T.StructField("qid", T.LongType()), *[self.forward.schema[n] for n in self.known], T.StructField("score", T.DoubleType())])
        return self.forward.join(F.broadcast(pairs) if few else pairs, by).select(*self.known, "ts", "ws", "qids").mapInArrow(_products(shared, self.known), schema)

    def search(self, query_terms: DataFrame, limit: int, keep: Callable[[DataFrame], DataFrame] | None = None, ties: list[str] | None = None, size: int = retrieve.BLOCK, filters: DataFrame | None = None) -> DataFrame:
        """qid, the columns of a point, score and pos of the ``limit`` best points of each query.

        ``keep`` takes pairs (qid, point) and gives back those that pass a filter; ``filters``
        (qid, source, categories, a row for each query) hold for points with these columns.
        Queries are taken in blocks of about ``size``; each block's result is stored before the next begins.
        """
        bounded, ties = store(self.bounded(query_terms), "bounded"), ties or [self.point]
        blocks, n = max(1, -(-bounded.select("qid").distinct().count() // size)), self.forward.count()
        out = []
        for b in range(blocks):
            own = bounded.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else bounded
            left, _ = self.left(own, limit, keep, filters)
            if keep is None and (left.agg(F.sum(F.size("points"))).first()[0] or 0) > n:
                found = retrieve.sparse_candidates(own.select("qid", "term", F.col("qw").alias("weight")), self.forward.select(*self.known, "ts", "ws"), limit, self.point, ties, filters)
            else:
                found = retrieve.top(self.scores(self._pairs(left, keep), own, filters), "qid", F.col("score"), limit, ties)
            out.append(store(found, "found"))
        return reduce(DataFrame.unionByName, out)


#: Products that a task holds at once.
AT_ONCE = 1 << 21


def _products(shared, names: list[str]):
    """Scores of the wanted pairs of each row that pass their query's filter: its terms meet the block's queries in an index by term."""

    def run(batches):
        ids, filters, vocabulary, counts, queries, weights = shared.value
        ends = np.cumsum(counts)
        for batch in batches:
            n = batch.num_rows
            size, wanted = (np.diff(batch.column(c).offsets.to_numpy()) for c in ("ts", "qids"))
            rows, terms, own = np.repeat(np.arange(n), size), batch.column("ts").flatten().to_numpy(), batch.column("ws").flatten().to_numpy()
            at = np.minimum(np.searchsorted(vocabulary, terms), max(0, len(vocabulary) - 1))
            known = vocabulary[at] == terms if len(vocabulary) else np.zeros(len(terms), bool)
            rows, at, own = rows[known], at[known], own[known]
            held = np.cumsum(counts[at])
            pair_row, pair_query = np.repeat(np.arange(n), wanted), np.searchsorted(ids, batch.column("qids").flatten().to_numpy())
            if filters:
                good = _passing(batch, filters, pair_row, pair_query)
                pair_row, pair_query = pair_row[good], pair_query[good]
            score = np.zeros(len(pair_row))
            start = 0
            while start < n:  # as many rows as there is room for
                lo = np.searchsorted(rows, start)
                room = np.searchsorted(held, (held[lo - 1] if lo else 0) + AT_ONCE, side="right")
                stop = n if room >= len(rows) else max(start + 1, int(rows[room]))
                stop = min(stop, start + max(1, AT_ONCE // max(1, len(ids))))
                hi = np.searchsorted(rows, stop)
                many = counts[at[lo:hi]]
                entry = np.repeat(ends[at[lo:hi]] - many, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                flat = np.bincount(np.repeat(rows[lo:hi] - start, many) * len(ids) + queries[entry], np.repeat(own[lo:hi], many) * weights[entry], minlength=(stop - start) * len(ids))
                mine = slice(*np.searchsorted(pair_row, [start, stop]))
                score[mine] = flat[(pair_row[mine] - start) * len(ids) + pair_query[mine]]
                start = stop
            take = pa.array(pair_row)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pair_query], pa.int64()), *[batch.column(c).take(take) for c in names], pa.array(score)], names=["qid", *names, "score"])

    return run


def _passing(batch: pa.RecordBatch, filters: list[tuple], pair_row: np.ndarray, pair_query: np.ndarray) -> np.ndarray:
    """Which pairs of a row and a query pass the query's filter."""
    good, own = np.ones(len(pair_row), bool), retrieve._Filters(batch)
    order = np.argsort(pair_query, kind="stable")
    some, first = np.unique(pair_query[order], return_index=True)
    for query, start, stop in zip(some, first, [*first[1:], len(order)]):
        mask = own.passing(*filters[query])
        if mask is not None:
            good[order[start:stop]] = mask[pair_row[order[start:stop]]]
    return good
