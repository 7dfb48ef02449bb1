"""Approximate nearest neighbours by cosine: inverted lists around centroids.

The number of lists grows with the square root of the table, so a list stays
short and a query looks at a share of the table that falls as it grows.
Centroids are trained by spherical k-means in rounds on the executors, over a
sample whose size grows with the number of lists; every point is then put into
the list of its nearest centroid, and the table is laid out by list, so a scan
for a few lists skips the row groups of the others.

A query visits lists from the nearest on until they hold a given share of the
points that can pass its filters.  How many of each list's points have a source
or a category is counted beforehand: lists without any are not visited, few
matches are looked at all, and a query that still finds too few goes through all
lists.  ``tune`` finds the share that reaches a recall on given queries, against
exact search, and tells the recall on others.

Points are not shuffled by a search: lists are looked up in a broadcast of one
block of queries, and a partition sends its best rows alone.

Bounds: centroids take at most ``MOST_BYTES``; with 256 places that is reached at
some 268 million points, from where lists grow with the table.  Points that are
the same lie in one list, however many; a scan splits that list like any rows.

Odd input: a point without direction (all zero) lies in the first list with cosine
0; a query without direction, for which all points are equal, visits all lists;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..scratch import ship, store
from . import retrieve

#: Lists for each square root of the number of points; sampled points for each list; bytes of all centroids; rounds.
DENSITY, SAMPLED, MOST_BYTES, ROUNDS = 2.0, 64, 64 << 20, 8
#: A query looks at least at so many times the rows that it wants.
SLACK = 8


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _nearest_list(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    found = np.empty(len(x), np.int32)
    for at in range(0, len(x), 4096):
        found[at : at + 4096] = np.argmax(_unit(x[at : at + 4096]) @ centroids.T, axis=1)
    return found


def _vectors(df: DataFrame, name: str) -> np.ndarray:
    column = df.select(name).toArrow().column(0).combine_chunks()
    return retrieve._matrix(column) if len(column) else np.zeros((0, 1))


def _moved(sample: DataFrame, vector: str, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the direction of the sum of each list; one whose list is empty stays."""
    shared = sample.sparkSession.sparkContext.broadcast(centroids)

    def part(batches):
        own = shared.value
        sums, some = np.zeros_like(own), np.zeros(len(own), bool)
        for batch in batches:
            if batch.num_rows:
                x = retrieve._matrix(batch.column(0))
                at = _nearest_list(x, own)
                np.add.at(sums, at, _unit(x))
                some[at] = True
        at = np.flatnonzero(some)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(sums[at]), pa.list_(pa.float64()))], names=["list", "total"])

    def added(group: pa.Table) -> pa.Table:
        total = retrieve._matrix(group.column("total").combine_chunks()).sum(axis=0)
        return pa.table({"list": group.column("list").slice(0, 1), "total": pa.array([total], pa.list_(pa.float64()))})

    schema = "list int, total array<double>"
    sums = sample.select(vector).mapInArrow(part, schema).groupBy("list").applyInArrow(added, schema).toArrow()  # one row for each list
    shared.destroy()
    after = centroids.copy()
    if sums.num_rows:
        totals = _unit(retrieve._matrix(sums.column("total").combine_chunks()))
        alive = (totals != 0).any(axis=1)
        after[sums.column("list").to_numpy()[alive]] = totals[alive]
    return after


def train(points: DataFrame, vector: str = "vector", key: str = "point_id", n: int | None = None, density: float = DENSITY, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of the lists for ``points``."""
    ship(points.sparkSession)
    n = points.count() if n is None else n
    first = points.select(F.size(vector).alias("n")).first()
    if first is None:
        return np.zeros((0, 1))
    lists = max(1, min(int(np.ceil(density * n**0.5)), MOST_BYTES // (8 * first["n"]), n))
    chance = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / (1 << 40)
    sample = store(points.where(chance < min(1.0, SAMPLED * lists / n)).select(vector, F.xxhash64(key).alias("_order")), "sample")
    start = np.unique(_unit(_vectors(sample.orderBy("_order").limit(lists), vector)), axis=0)
    centroids = start[(start != 0).any(axis=1)]
    if not len(centroids):
        return np.eye(1, first["n"])
    for _ in range(rounds):
        after = _moved(sample, vector, centroids)
        still = np.abs(after - centroids).max() < 1e-6
        centroids = after
        if still:
            break
    return centroids


@dataclass(frozen=True)
class DenseIndex:
    """``points`` with the column ``list``; ``facets``: of each source and category the lists that have it, and how often."""

    points: DataFrame
    facets: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    share: float = 0.25
    key: str = "point_id"

    @classmethod
    def build(cls, points: DataFrame, key: str = "point_id", density: float = DENSITY, rounds: int = ROUNDS) -> DenseIndex:
        """The index of ``points`` (key, vector, source, categories and others, which searches give back)."""
        points = store(points, "dense-points")
        n = points.count()
        centroids = train(points, "vector", key, n, density, rounds)
        shared = points.sparkSession.sparkContext.broadcast(centroids)
        schema = T.StructType([T.StructField("list", T.IntegerType()), *points.schema])
        at = points.columns.index("vector")

        def put(batches):
            for batch in batches:
                lists = _nearest_list(retrieve._matrix(batch.column(at)), shared.value) if batch.num_rows else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *batch.columns], names=schema.names)

        listed = points.mapInArrow(put, schema)
        laid = store(listed.repartitionByRange("list", F.xxhash64(key)).sortWithinPartitions("list"), "dense-lists")
        shared.destroy()
        values = F.array_distinct(F.concat(F.array(F.struct(F.lit("source").alias("facet"), F.col("source").alias("value"))), F.transform("categories", lambda c: F.struct(F.lit("category").alias("facet"), c.alias("value")))))
        counts = laid.select("list", F.explode(values).alias("v")).where("v.value <> ''").groupBy("v", "list").agg(F.count("*").alias("n"))
        facets = counts.groupBy("v.facet", "v.value").agg(F.sort_array(F.collect_list(F.struct("list", "n"))).alias("lists"))  # one entry for each list
        sizes = np.zeros(max(1, len(centroids)), np.int64)
        for row in laid.groupBy("list").count().collect():  # one row for each list
            sizes[row["list"]] = row["count"]
        return cls(laid, store(facets, "dense-facets"), centroids, sizes, key=key)

    # ---- lists of each query

    def probes(self, queries: DataFrame, limit: int, everything: bool = False) -> DataFrame:
        """The queries with ``lists``, those that each of them visits, and ``visited``, the points there."""
        spark = queries.sparkSession
        ship(spark)
        facet = lambda kind: self.facets.where(F.col("facet") == kind).select(F.col("value"), "lists")
        q = queries.select(F.col("qid").cast("long").alias("qid"), "qvec", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))
        by_source = q.where("source <> ''").join(facet("source"), q["source"] == F.col("value")).select("qid", F.array("lists").alias("s"))
        wanted = q.select("qid", F.explode(F.array_distinct("categories")).alias("value")).join(facet("category"), "value").groupBy("qid").agg(F.collect_list("lists").alias("c"))
        rows = q.join(by_source, "qid", "left").join(wanted, "qid", "left")
        shared = spark.sparkContext.broadcast((self.centroids, self.sizes))
        share, slack = self.share, SLACK * limit

        def run(batches):
            centroids, sizes = shared.value
            n = len(sizes)

            def held(pairs) -> np.ndarray:
                out = np.zeros(n, np.int64)
                for part in pairs or []:
                    for x in part:
                        out[x["list"]] += x["n"]
                return out

            for batch in batches:
                lists, visited = [], []
                for row in batch.to_pylist():
                    can = sizes
                    if row["source"]:
                        can = np.minimum(can, held(row["s"]))
                    if row["categories"]:
                        can = np.minimum(can, held(row["c"]))
                    v = np.array(row["qvec"], np.float64)
                    some = np.flatnonzero(can)
                    if len(some) and not everything and v.any():
                        some = some[np.argsort(-(centroids[some] @ v), kind="stable")]
                        before = np.cumsum(can[some]) - can[some]
                        some = some[before < max(share * can.sum(), slack)]
                    lists.append(some.tolist()), visited.append(int(sizes[some].sum()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(lists, pa.list_(pa.int32())), pa.array(visited, pa.int64())], names=names)

        schema = T.StructType([*q.schema, T.StructField("lists", T.ArrayType(T.IntegerType())), T.StructField("visited", T.LongType())])
        names = schema.names
        return rows.select(*q.columns, "s", "c").mapInArrow(run, schema)

    # ---- searches

    def search(self, queries: DataFrame, limit: int, ties: list[str] | None = None) -> DataFrame:
        """qid, the columns of the points but the vector, score and pos, of the best points found; like ``dense_candidates``."""
        asked = store(self.probes(queries, limit), "probes")
        found = store(self._scan(asked, limit, ties), "found")
        # too few found although there are lists left: all of them
        few = found.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
        short = asked.where(F.size("lists") < int((self.sizes > 0).sum())).join(few, "qid", "left_anti")
        if short.limit(1).count():
            every = self._scan(store(self.probes(short, limit, True), "probes"), limit, ties)
            found = found.join(short.select("qid"), "qid", "left_anti").unionByName(every)
        return found

    def _scan(self, asked: DataFrame, limit: int, ties: list[str] | None) -> DataFrame:
        ties = ties or [self.key]
        names = [c for c in self.points.columns if c not in ("vector", "list")]
        schema = T.StructType([T.StructField("qid", T.LongType()), *[self.points.schema[n] for n in names], T.StructField("score", T.DoubleType())])

        def block(rows: list) -> DataFrame:
            visits: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                for x in r["lists"]:
                    visits.setdefault(x, []).append(i)
            vectors = _unit(np.array([r["qvec"] for r in rows], np.float64))
            shared = self.points.sparkSession.sparkContext.broadcast((np.array([r["qid"] for r in rows]), vectors, {x: np.array(v) for x, v in visits.items()}, [(r["source"], tuple(r["categories"])) for r in rows]))
            scanned = self.points.where(F.col("list").isin(list(visits))) if len(visits) <= 1000 else self.points
            return scanned.mapInArrow(_visiting(shared, limit, ties, names), schema)

        return retrieve.in_blocks(asked, ["qid", "qvec", "source", "categories", "lists"], block, lambda f: retrieve.top(f, "qid", F.col("score"), limit, ties), schema)

    def tune(self, queries: DataFrame, limit: int, recall: float = 0.95, ties: list[str] | None = None) -> tuple[DenseIndex, float]:
        """The index with the least share of points by which ``recall`` of the nearest is found for half of ``queries``, and the recall for the other half.

        Some hundreds of queries do; their nearest are found exactly, by a scan of all points.
        """
        half = store(queries.withColumn("_learn", F.pmod(F.xxhash64("qid"), F.lit(2)) == 0), "tuning")
        learn, test = half.where("_learn").drop("_learn"), half.where(~F.col("_learn")).drop("_learn")
        full = replace(self, share=1.0)
        right = store(retrieve.dense_candidates(queries, self.points, limit, self.key, ties), "exact")
        # the share that stands before the list of each of the nearest, from the lists in a query's order
        order = full.probes(learn, limit).select("qid", F.posexplode("lists").alias("place", "list"))
        counts = self.points.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(self.sizes)], "list int, n long")
        window = W.partitionBy("qid").orderBy("place")
        before = order.join(F.broadcast(counts), "list").withColumn("before", F.sum("n").over(window) - F.col("n"))
        shares = right.select("qid", "list").join(before, ["qid", "list"]).select((F.col("before") / float(max(1, self.sizes.sum()))).alias("x")).toPandas()["x"].to_numpy()
        share = float(np.quantile(shares, recall, method="higher")) + 1e-9 if len(shares) else 1.0
        tuned = replace(self, share=min(1.0, share))
        return tuned, tuned.recall(test, limit, ties, right)

    def recall(self, queries: DataFrame, limit: int, ties: list[str] | None = None, right: DataFrame | None = None) -> float:
        """How many of the exactly nearest a search finds."""
        right = retrieve.dense_candidates(queries, self.points, limit, self.key, ties) if right is None else right.join(queries.select("qid"), "qid", "left_semi")
        found = self.search(queries, limit, ties).select("qid", self.key).withColumn("_hit", F.lit(1))
        n, hits = right.join(found, ["qid", self.key], "left").agg(F.count("*"), F.sum("_hit")).first()
        return (hits or 0) / n if n else 1.0

    # ---- files

    def save(self, path: str) -> None:
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        self.facets.write.mode("overwrite").parquet(f"{path}/facets")
        rows = [(i, int(n), [float(x) for x in c]) for i, (n, c) in enumerate(zip(self.sizes, self.centroids))]
        self.points.sparkSession.createDataFrame(rows, "list int, n long, centroid array<double>").write.mode("overwrite").parquet(f"{path}/lists")
        self.points.sparkSession.createDataFrame([(self.share, self.key)], "share double, key string").write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DenseIndex:
        lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
        set_ = spark.read.parquet(f"{path}/settings").first()
        centroids = np.array([r["centroid"] for r in lists]) if lists else np.zeros((0, 1))
        return cls(spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/facets"), centroids, np.array([r["n"] for r in lists] or [0], np.int64), set_["share"], set_["key"])


def _visiting(shared, limit: int, ties: list[str], names: list[str]):
    """The best rows of a partition for each query of a block, from the lists that it visits."""

    def run(batches):
        ids, vectors, visits, filters = shared.value
        floor = np.full(len(ids), -2.0)
        held: pa.Table | None = None
        place = {q: i for i, q in enumerate(ids.tolist())}

        def best(table):
            table = retrieve._best(table, limit, ties)
            qid, score = table.column("qid").to_numpy(), np.round(table.column("score").to_numpy(), 9)
            last = np.flatnonzero(np.concatenate([qid[1:] != qid[:-1], [True]])) if len(qid) else []
            first = np.searchsorted(qid, qid)
            for j in last:
                if j - first[j] + 1 >= limit:
                    floor[place[int(qid[j])]] = score[j]
            return table

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("list").to_numpy()
            points = _unit(retrieve._matrix(batch.column("vector")))
            own = retrieve._Filters(batch)
            starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
            who, rows, scored = [], [], []
            for a, b in zip(starts, [*starts[1:], len(lists)]):
                asking = visits.get(int(lists[a]))
                if asking is None:
                    continue
                scores = vectors[asking] @ points[a:b].T
                good = np.round(scores, 9) >= floor[asking][:, None]
                for i, q in enumerate(asking):
                    if any(filters[q]) and good[i].any():
                        good[i] &= own.passing(filters[q][0], list(filters[q][1]))[a:b]
                i, j = np.nonzero(good)
                who.append(ids[asking[i]]), rows.append(a + j), scored.append(scores[i, j])
            if not who:
                continue
            take = pa.array(np.concatenate(rows))
            table = pa.table([pa.array(np.concatenate(who), pa.int64()), *[batch.column(n).take(take) for n in names], pa.array(np.concatenate(scored))], names=["qid", *names, "score"])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows > 4 * limit * len(ids):
                held = best(held)
        if held is not None:
            yield from best(held).to_batches()

    return run
