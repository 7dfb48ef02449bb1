"""Connected components of a table of links, by alternating stars and a last union in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop, materialize

#: Links that one task joins at once (two keys of some ten bytes each); more are first shortened by star rounds.
TOGETHER = 1 << 19


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _round(edges: DataFrame) -> DataFrame:
    """One large star and one small star: the components stay, paths shorten."""
    a, b = F.col("a"), F.col("b")
    both = edges.select("a", "b").unionByName(edges.select(b.alias("a"), a.alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = materialize(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "links")
    # of each node its smaller neighbours; a < b holds for every edge
    low = large.groupBy("b").agg(F.min("a").alias("m"))
    small = large.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    after = materialize(small.unionByName(low.select(F.col("m").alias("a"), "b")).distinct(), "links")
    drop(edges, large)
    return after


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches over the links (a[i], b[i])."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _together(batches):
    held = [b for b in batches if b.num_rows]  # at most TOGETHER links
    if not held:
        return
    table = pa.Table.from_batches(held)
    coded = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    code, nodes = place[coded.indices.to_numpy()], coded.dictionary.take(order)
    half = table.num_rows
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(roots_of(code[:half], code[half:], len(nodes))))], names=["node", "root"])


def components(links: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``node, root`` for each node of links (a, b), where root is the least node it reaches.

    More than ``together`` links go through rounds that link the larger
    neighbours of every node to its least neighbour (large star) and then the
    smaller ones (small star), until few enough are left for one task or nothing
    changes.  Counts go to the driver, links never do.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(links.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    before = _state(edges)
    while before[0] > together:
        edges = _round(edges)
        now = _state(edges)
        if now == before:
            roots = edges.select(F.col("a").alias("node")).distinct()
            return edges.select(b.alias("node"), a.alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        before = now
    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").repartition(1).transform(arrow_map, _together, f"node {kind}, root {kind}")
