"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree's upper part is fitted on a bounded sample by the driver.  Leaves that
then hold many rows are divided further by the executors, each on a sample of its
own rows, until there are some 2 to 4 sqrt(N) leaves, so the rows of a leaf grow
no faster than sqrt(N).  Every row is indexed under the leaf whose centres it is
nearest to on the way down.  A query walks the tree best
bin first: a priority queue holds the nodes seen so far by the inner product
with their centres, raised by a part of what their radius allows, and leaves are
visited as they come up; only rows of visited leaves are scored.  How many
leaves is calibrated: queries whose true neighbours are found by brute force
over all rows say how far the visits must widen to reach the recall asked for.
Half of them fix that number; the recall of the other half and the share of
vectors that it visits are columns of the result.

Equal vectors form one class with its smallest ids, so a vector that holds a
third of all rows is one point of the index.  Leaves are dealt to shards of
bounded size; a shard's rows are held while its queries stream past.

Defined results for odd input: vectors that are null, zero, of another length
than most (ties: the shorter), or hold null or non-finite components take no
part, nor do rows without an id; repeated rows count once; an id with several vectors has the best score
of any of them; ties go to the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, drop, materialize, ship


@dataclass(frozen=True)
class Index:
    k: int = 20
    sample: int = 20_000
    branches: int = 8
    leaf: int = 16
    #: Part of a node's radius, times the query's length, that is added to its inner product in the queue.
    reach: float = 0.25
    rounds: int = 8
    calibration: int = 256
    recall: float = 0.97
    shard_rows: int = 20_000
    queries_per_task: int = 100_000
    walks_per_task: int = 500
    seed: int = 6


class Tree:
    """Nodes in breadth-first order; a node without children is a leaf."""

    def __init__(self, centres: np.ndarray, radius: np.ndarray, children: list[np.ndarray], reach: float):
        self.centres, self.radius, self.children, self.reach = centres, radius, children, reach
        inner = np.array([len(c) > 0 for c in children])
        self.leaf_of = np.where(inner, -1, np.cumsum(~inner) - 1)
        self.leaves = int((~inner).sum())

    @classmethod
    def fit(cls, x: np.ndarray, rules: Index) -> Tree:
        rng = np.random.default_rng(rules.seed)
        wide = lambda rows, c: float(np.sqrt(((rows - c) ** 2).sum(axis=1).max()))
        centres, children, todo = [x.mean(axis=0)], [np.zeros(0, np.int64)], [(0, np.arange(len(x)))]
        radius = [wide(x, centres[0])]
        while todo:
            node, rows = todo.pop(0)
            parts = _kmeans(x[rows], rules.branches, rules.rounds, rng) if len(rows) > rules.leaf else []
            if len(parts) < 2:
                continue
            children[node] = np.arange(len(centres), len(centres) + len(parts))
            for part in parts:
                todo.append((len(centres), rows[part]))
                centres.append(x[rows[part]].mean(axis=0))
                radius.append(wide(x[rows[part]], centres[-1]))
                children.append(np.zeros(0, np.int64))
        return cls(np.array(centres), np.array(radius), children, rules.reach)

    def grafted(self, below: dict[int, Tree]) -> Tree:
        """This tree with other trees in the place of some leaves; their roots keep the centres they have here."""
        centres, radius, children = [self.centres], [self.radius], list(self.children)
        for leaf in sorted(below):
            sub, base = below[leaf], len(children) - 1  # node i > 0 of the subtree becomes base + i
            children[int(np.flatnonzero(self.leaf_of == leaf)[0])] = sub.children[0] + base
            children += [c + base for c in sub.children[1:]]
            centres.append(sub.centres[1:]), radius.append(sub.radius[1:])
        return Tree(np.concatenate(centres), np.concatenate(radius), children, self.reach)

    def priorities(self, queries: np.ndarray) -> np.ndarray:
        """The place in the queue of each node, for each query."""
        return queries @ self.centres.T + self.reach * np.sqrt((queries * queries).sum(axis=1))[:, None] * self.radius

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(kids) or not len(rows):
                at[rows] = self.leaf_of[node]
                continue
            c = self.centres[kids]
            nearest = (x[rows] @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            todo += [(int(kid), rows[nearest == j]) for j, kid in enumerate(kids)]
        return at

    def visits(self, priorities: np.ndarray):
        """Leaves best bin first, given a query's priorities of all nodes."""
        place = (-priorities).tolist()
        queue = [(place[0], 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            kids = self.children[node]
            if len(kids):
                for kid in kids.tolist():
                    heapq.heappush(queue, (place[kid], kid))
            else:
                yield int(self.leaf_of[node])


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> list[np.ndarray]:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
        centres = np.array([x[nearest == j].mean(axis=0) for j in range(len(centres)) if (nearest == j).any()])
    nearest = (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
    return [np.flatnonzero(nearest == j) for j in range(len(centres)) if (nearest == j).any()]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: rows whose vector can take part."""
    v = F.col("v")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(v.isNotNull() & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0]["n"] if sizes else 0
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size("v") == dim) & ~bad & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """rep, v, ids: a row for each distinct vector with its k + 1 smallest ids."""
    first = F.dense_rank().over(W.partitionBy("v").orderBy("id"))
    few = rows.withColumn("_r", first).where(F.col("_r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "v", "ids")


def _exact(classes: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query_id, leaf, ids, score of the nearest classes of a bounded set of queries, by brute force."""
    ids, x = [q for q, _ in queries], np.array([v for _, v in queries], float)
    shared = classes.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches):
        ids, x = shared.value
        best: list[list] = [[] for _ in ids]
        for batch in batches:
            y, leaf, names = _matrix(batch.column("v")), batch.column("leaf").to_pylist(), batch.column("ids").to_pylist()
            scores = x @ y.T
            for i in range(len(ids)):
                top = np.argpartition(-scores[i], min(k, len(y) - 1))[: k + 1]
                best[i] = heapq.nlargest(k + 1, best[i] + [(scores[i, j], leaf[j], names[j]) for j in top])
        out = [(q, *row) for q, rows in zip(ids, best) for row in rows]
        yield pa.RecordBatch.from_pylist([{"query_id": q, "leaf": leaf, "ids": names, "score": s} for q, s, leaf, names in out], schema=pa.schema([("query_id", pa.int64()), ("leaf", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())]))

    return classes.select("v", "leaf", "ids").transform(arrow_map, run, "query_id long, leaf long, ids array<long>, score double")


def calibrate(tree: Tree, classes: DataFrame, queries: list[tuple[int, list[float]]], sizes: dict[int, int], rules: Index) -> tuple[int, float, float]:
    """Leaves to visit for the recall asked for, and the recall and share of classes visited of queries that did not fix it.

    Every second query fixes the number; a single one is both.
    """
    if not queries:
        return tree.leaves, 1.0, 1.0
    truth: dict[int, list] = {}
    found = _exact(classes, queries, rules.k)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.element_at("ids", 1))
    for row in found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= rules.k + 1).orderBy("query_id", "_r").collect():
        truth.setdefault(row["query_id"], []).append(row)
    priorities = tree.priorities(np.array([v for _, v in queries], float))
    held = np.array([sizes.get(i, 0) for i in range(tree.leaves)])
    depths: list[list[int]] = [[], []]
    passed: list[list[np.ndarray]] = [[], []]
    for i, ((q, _), p) in enumerate(zip(queries, priorities)):
        order = list(tree.visits(p))
        place = {leaf: i + 1 for i, leaf in enumerate(order)}
        depths[i % 2] += [place[row["leaf"]] for row in truth.get(q, []) for i in row["ids"] if i != q][: rules.k]
        passed[i % 2].append(np.cumsum(held[order]))
    if not depths[0]:
        return tree.leaves, 1.0, 1.0
    fixing = np.sort(depths[0])
    enough = int(fixing[ceil(rules.recall * len(fixing)) - 1])
    other = 1 if depths[1] else 0
    return enough, float((np.array(depths[other]) <= enough).mean()), float(np.mean([x[enough - 1] / x[-1] for x in passed[other]]))


def _deeper(tree: Tree, indexed: DataFrame, sizes: dict[int, int], rules: Index) -> Tree:
    """The tree with leaves divided that hold more than sqrt(N) rows; the same tree if there are none."""
    wanted = max(rules.leaf, ceil(sqrt(sum(sizes.values())) / 2))
    large = {leaf: n for leaf, n in sizes.items() if n > 2 * wanted}
    if not large:
        return tree
    spark = indexed.sparkSession
    # sixteen rows for each leaf to be, and no more than the upper part's sample
    parts = [(leaf, min(1.0, rules.sample / n, rules.leaf * ceil(n / wanted) / n)) for leaf, n in sorted(large.items())]
    share = F.pmod(F.xxhash64("rep", F.lit(rules.seed)), F.lit(1_000_000)) / 1_000_000
    some = indexed.join(F.broadcast(spark.createDataFrame(parts, "leaf long, part double")), "leaf").where(share < F.col("part")).select("leaf", "rep", "v")

    def fit(table):
        table = table.take(pc.sort_indices(table.column("rep"))).slice(0, 2 * rules.sample).combine_chunks()
        sub = Tree.fit(_matrix(table.column("v").combine_chunks()), rules)
        parent = np.full(len(sub.children), -1)
        for node, kids in enumerate(sub.children):
            parent[kids] = node
        n = len(parent)
        centres = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * sub.centres.shape[1], pa.int32()), pa.array(sub.centres.ravel()))
        return pa.table({"leaf": pa.array([table.column("leaf")[0].as_py()] * n, pa.int64()), "node": pa.array(np.arange(n), pa.int64()), "parent": pa.array(parent, pa.int64()), "radius": pa.array(sub.radius), "centre": centres})

    ship(spark)
    made = some.groupBy("leaf").applyInArrow(fit, "leaf long, node long, parent long, radius double, centre array<double>").orderBy("leaf", "node").toArrow()
    below = {}
    whose = made.column("leaf").to_numpy()
    cuts = np.flatnonzero(np.diff(whose)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(whose)]):
        piece = made.slice(lo, hi - lo)
        if hi - lo > 1:
            parent = piece.column("parent").to_numpy()
            below[int(whose[lo])] = Tree(_matrix(piece.column("centre").combine_chunks()), piece.column("radius").to_numpy(), [np.flatnonzero(parent == i) for i in range(hi - lo)], rules.reach)
    return tree.grafted(below) if below else tree


def _shards(sizes: dict[int, int], leaves: int, limit: int) -> list[list[int]]:
    """Shards of each leaf: small leaves share one, large leaves have several."""
    out, shard, held = [], 0, 0
    for leaf in range(leaves):
        n = sizes.get(leaf, 0)
        if n > limit:
            parts = ceil(n / limit)
            shard += held > 0
            out.append(list(range(shard, shard + parts)))
            shard, held = shard + parts, 0
            continue
        if held + n > limit:
            shard, held = shard + 1, 0
        out.append([shard])
        held += n
    return out


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", rules: Index = Index()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for each row that ``queries`` selects.

    ``queries`` is a condition on the column ``id``.  ``recall`` and ``visited``
    are those of the calibration, the same in every row.
    """
    spark = df.sparkSession
    rows = usable(df, key, vector)
    kind = rows.schema["v"].dataType.simpleString()
    classes = materialize(_classes(rows, rules.k), "vectors")
    n = classes.count()
    result = "query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, recall double, visited double")
    share = F.pmod(F.xxhash64("rep"), F.lit(1_000_000))
    sample = classes.where(share < F.lit(ceil(1_000_000 * min(1.0, rules.sample / n)))).orderBy("rep").limit(2 * rules.sample).select("v").toArrow()
    sample = sample if sample.num_rows else classes.select("v").limit(rules.leaf).toArrow()
    tree = Tree.fit(_matrix(sample.column("v").combine_chunks()), rules)

    def placed(rows: DataFrame, tree: Tree) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
        """The rows with their leaves, and the classes and ids of each leaf."""
        tree_b = spark.sparkContext.broadcast(tree)

        def leaf(batches):
            for batch in batches:
                at = tree_b.value.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["rep", "v", "ids", "leaf"])

        out = materialize(rows.select("rep", "v", "ids").transform(arrow_map, leaf, f"rep long, v {kind}, ids array<long>, leaf long"), "index")
        tree_b.unpersist()
        stats = out.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("m")).collect()
        return out, {r["leaf"]: r["n"] for r in stats}, {r["leaf"]: r["m"] for r in stats}

    indexed, sizes, ids = placed(classes, tree)
    grown = _deeper(tree, indexed, sizes, rules)
    if grown is not tree:
        shallow, tree = indexed, grown
        indexed, sizes, ids = placed(shallow, tree)
        drop(shallow)
    drop(classes)
    tree_b = spark.sparkContext.broadcast(tree)
    asked = rows.where(queries).dropDuplicates(["id", "v"])
    few = asked.withColumn("_h", F.xxhash64("id")).orderBy("_h", "id").limit(rules.calibration).select("id", "v").collect()
    enough, recall, visited = calibrate(tree, indexed, [(r["id"], r["v"]) for r in few], sizes, rules)
    shards = _shards(sizes, tree.leaves, rules.shard_rows)
    held = [ids.get(i, 0) for i in range(tree.leaves)]

    def walk(batches):
        tree = tree_b.value
        for batch in batches:
            out: dict[str, list] = {"shard": [], "row": [], "leaves": []}
            if batch.num_rows:
                for i, p in enumerate(tree.priorities(_matrix(batch.column(1)))):
                    per: dict[int, list[int]] = {}
                    seen = 0
                    for count, at in enumerate(tree.visits(p)):
                        if count >= enough and seen > rules.k:
                            break
                        seen += held[at]
                        for s in shards[at]:
                            per.setdefault(s, []).append(at)
                    out["shard"] += per.keys()
                    out["row"] += [i] * len(per)
                    out["leaves"] += per.values()
            take = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(out["leaves"], pa.list_(pa.int64()))], names=["shard", "id", "v", "leaves"])

    # a walk takes some milliseconds, so few rows make a task
    asked = asked.select("id", "v").repartition(max(1, ceil(asked.count() / rules.walks_per_task)), "id")
    visits = materialize(asked.transform(arrow_map, walk, f"shard long, id long, v {kind}, leaves array<long>"), "visits")
    load = {r["shard"]: ceil(r["count"] / rules.queries_per_task) for r in visits.groupBy("shard").count().collect()}
    of_leaf = spark.createDataFrame(list(enumerate(shards)), "leaf long, _s array<long>")  # a row for each leaf
    parts = spark.createDataFrame(sorted(load.items()) or [(0, 1)], "shard long, parts long")
    points = indexed.join(F.broadcast(of_leaf), "leaf").withColumn("shard", F.element_at("_s", (F.pmod(F.xxhash64("rep"), F.size("_s")) + 1).cast("int")))
    points = points.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    points = points.select("shard", "part", F.lit(0).alias("kind"), F.col("rep").alias("id"), "v", "ids", "leaf")
    looking = visits.join(F.broadcast(parts), "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(1).alias("kind"), "id", "v", F.col("leaves").alias("ids"), F.lit(-1).cast("long").alias("leaf"))
    tasks = max(1, sum(load.values()))
    dealt = points.unionByName(looking).repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "kind", "id")

    def answer(batches):
        at, held = None, []
        ready = None
        for batch in batches:
            places = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(places)]):
                shard, part, what = (int(x) for x in places[lo])
                piece = batch.slice(lo, hi - lo)
                if (shard, part) != at:
                    at, held, ready = (shard, part), [], None
                if not what:
                    held.append(piece)
                    continue
                if ready is None:
                    ready = _Shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0]) if held else _Shard(None)
                yield ready.answer(piece, rules.k)

    found = dealt.transform(arrow_map, answer, result).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= rules.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(recall).alias("recall"), F.lit(visited).alias("visited"))


class _Shard:
    """The rows of one shard, and its answers to a batch of queries."""

    def __init__(self, rows: pa.RecordBatch | None):
        self.empty = rows is None
        if rows is not None:
            rows = rows.take(pc.sort_indices(rows.column(6)))
            self.rep, self.x = rows.column(3).to_numpy(), _matrix(rows.column(4))
            self.ids = rows.column(5).to_pylist()
            leaf = rows.column(6).to_numpy()
            self.leaves, first = np.unique(leaf, return_index=True)
            self.ends = [*first.tolist(), len(leaf)]

    def answer(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        names = queries.column(3).to_pylist()
        leaves = queries.column(5)
        y = _matrix(queries.column(4))
        for lo in range(0, 0 if self.empty else len(names), 256):
            part = leaves.slice(lo, 256)
            asked = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy())
            wanted = part.flatten().to_numpy()
            by_leaf = np.argsort(wanted, kind="stable")
            cuts = np.searchsorted(wanted[by_leaf], [self.leaves, self.leaves + 1])
            scores, seen = np.zeros((len(part), len(self.rep))), np.zeros((len(part), len(self.rep)), bool)
            for i, (begin, end) in enumerate(cuts.T):
                if begin < end:  # the rows of one leaf, by the queries that visit it
                    who, rows = asked[by_leaf[begin:end]], slice(self.ends[i], self.ends[i + 1])
                    scores[who, rows] = y[lo + who] @ self.x[rows].T
                    seen[who, rows] = True
            for s, had, q in zip(scores, seen, names[lo : lo + 256]):
                at = np.flatnonzero(had)
                s = s[at]
                if len(at) > k + 1:
                    least = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                    best = s >= least
                    at, s = at[best], s[best]
                order = np.lexsort((self.rep[at], -s))
                rows = [(-float(s[j]), i) for j in order for i in self.ids[at[j]] if i != q]
                for score, i in heapq.nsmallest(k, rows):
                    out[0].append(q), out[1].append(i), out[2].append(-score)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])
