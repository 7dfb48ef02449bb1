"""Near-duplicate detection with an LSH forest over MinHash signatures.

A document's set is its distinct word shingles.  Documents with equal sets form
one class; classes get a signature of trees x depth MinHash values.  For every
tree the classes are sorted by that tree's values, and a class is compared with
those that share its longest prefix: the prefix is as short as leaves a region
of at most ``region`` classes, so it is deep where the corpus is dense and
shallow where it is sparse.  A region that is larger even at full depth - equal
values in every place - gives each class its next ``width`` in sorted order.
Where more than ``region`` classes share the first ``core`` values of a tree
they are a crowd: what the links so far leave in several components is joined
exactly on full sets, in pairs of blocks of bounded size.

Candidates whose compact sketches agree too rarely are put aside (the limit is
5.5 standard deviations below the threshold), the rest are confirmed on full
sets, most alike first, and pairs that earlier links already join are not
confirmed again.  Links become components; a document is kept if it is the
first of its component.

Defined results for odd input: words are runs without ASCII white space,
A-Z lower-cased; with fewer words than a shingle the whole sequence is one
shingle; null, empty and blank texts have the empty set and are linked with
nothing; repeated rows fall into one class and get the same answer; a row
without an id is kept, and has a component only if it copies one with an id;
rows that share an id but not a text are judged each by its own text; an empty
table gives an empty table; columns other than id and text are not used.

``first_of_each_group`` decides for each row by id and text: rows without an id
are compared like all others and stand behind those with one, all rows without
an id or a word stay, and of rows with one id but no word one stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_map, attach, drop, materialize, ship
from .graph import components

MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Forest:
    shingle: int = 5
    percent: int = 80
    trees: int = 16
    depth: int = 8
    region: int = 16
    width: int = 3
    #: Classes that share so many first values of a tree are all compared, or joined already.
    core: int = 4
    #: Bytes of full sets of one block of a crowd.
    block: int = 1 << 24
    sigmas: float = 5.5
    rows_per_task: int = 150_000
    seed: int = 20

    @property
    def values(self) -> int:
        return self.trees * self.depth

    @property
    def least_agreement(self) -> int:
        """Two-bit sketch places that must agree, of ``values``."""
        p = self.percent / 100
        p += (1 - p) / 4
        return int(self.values * p - self.sigmas * (self.values * p * (1 - p)) ** 0.5)


class _Words(dict):
    """Hashes of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MULTIPLY
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    found = text.encode().lower().split() if text else []
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    size = min(size, n)
    s = h[: n - size + 1].copy()
    for j in range(1, size):
        s = _mix(s) * TURN + h[j : n - size + 1 + j]
    return np.unique(_mix(s))


def _signature(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(least, (s[None, i : i + 2048] * factors[:, None]).min(axis=1), out=least)
    return (_mix(least) >> np.uint64(48)).astype(np.uint16)


def _sketch(df: DataFrame, key: str, text: str, rules: Forest) -> DataFrame:
    """key, text_hash, n_shingles, set_key (null for the empty set), signature and sketch of each row."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("sketch", T.BinaryType())])

    def run(batches):
        words = _Words()
        factors = np.random.default_rng(rules.seed).integers(0, 1 << 63, rules.values, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            n, keys, signatures, sketches = [], [], [], []
            for value in batch.column(1):
                s = shingles(value.as_py(), rules.shingle, words)
                n.append(len(s))
                if not len(s):
                    keys.append(None), signatures.append(None), sketches.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                v = _signature(s, factors)
                signatures.append(v.astype(">u2").tobytes())
                bits = (v & 3).astype(np.uint8).reshape(-1, 4)
                sketches.append((bits[:, 0] | bits[:, 1] << 2 | bits[:, 2] << 4 | bits[:, 3] << 6).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (keys, signatures, sketches)]], names=schema.names)

    return df.select(F.col(key), F.col(text), F.xxhash64(F.col(text))).transform(arrow_map, run, schema)


def neighbours(tree: np.ndarray, values: np.ndarray, rules: Forest) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows sorted by (tree, values) that share a region."""
    n, depth = values.shape
    if n < 2:
        return []
    same = np.cumprod(values[1:] == values[:-1], axis=1).sum(axis=1)
    common = np.where(tree[1:] == tree[:-1], same, 0)
    region, crowded = np.full(n, -1), np.zeros(n, bool)
    for d in range(1, depth + 1):
        block = np.concatenate([[0], np.cumsum(common < d)])
        size = np.bincount(block)[block]
        fits = (region < 0) & ((size <= rules.region) | (d == depth))
        region[fits] = block[fits] * (depth + 1) + d
        crowded[fits & (size > rules.region)] = True
    found = []
    for j in range(1, min(rules.region, n)):
        near = region[j:] == region[:-j]
        if j > rules.width:
            near &= ~crowded[j:]
        if not near.any():
            break
        at = np.flatnonzero(near)
        found.append((at, at + j))
    return found


def crowds(classes: DataFrame, rules: Forest) -> DataFrame:
    """tree, start, node: classes where more than ``region`` share the first ``core`` values of a tree."""
    rows = classes.select(F.col("set_key").alias("node"), "signature", F.explode(F.sequence(F.lit(0), F.lit(rules.trees - 1))).alias("tree"))
    rows = rows.select("tree", F.substring("signature", F.col("tree") * 2 * rules.depth + 1, F.lit(2 * rules.core)).alias("start"), "node")
    large = materialize(rows.groupBy("tree", "start").agg(F.count("*").alias("_n")).where(F.col("_n") > rules.region).select("tree", "start"), "crowds")
    return attach(rows, large, ["tree", "start"])


def crowd_links(sets: list[np.ndarray], roots: list, percent: int, region: int = 16) -> list[tuple[int, int]]:
    """Index pairs of similar sets that join all components of ``roots`` that similar pairs join.

    First the sets made of the commonest elements are compared with all others,
    as long as each joins many; then every set outside the largest component
    counts the rarer elements that it shares with each other set, by their lists
    of holders, and is compared in full only with those that could be similar if
    they shared all common ones.  Two components always have a set outside the
    largest, so no link is lost.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets])
    label = np.unique(np.array(roots, object), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(n)])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = lambda x: code[starts[x] : starts[x + 1]]
    mask = np.zeros(len(count), np.int64)
    found: list[tuple[int, int]] = []

    def join(x: int, y: int) -> None:
        found.append((x, y))
        label[label == label[y]] = label[x]

    for x in np.argsort(-np.add.reduceat(count[code], starts[:-1]) / n, kind="stable"):
        mask[own(x)] = 1
        common = np.add.reduceat(mask[code], starts[:-1])
        mask[own(x)] = 0
        near = np.flatnonzero((100 * common >= percent * (n + n[x] - common)) & (label != label[x]))
        _, at = np.unique(label[near], return_index=True)
        found += [(x, y) for y in near[at]]
        label[np.isin(label, label[near])] = label[x]
        if len(at) < region:
            break
    if (label == label[0]).all():
        return found
    # of the rarer elements of two sets as many as they share, of the others at most as many as the smaller set has
    rare = count <= max(2, m // RARE)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(code, kind="stable")
    holders, ends = owner[order], np.concatenate([[0], np.cumsum(count)])
    usual = n - np.add.reduceat(rare[code].astype(np.int64), starts[:-1])
    values, held = np.unique(label, return_counts=True)
    largest = np.flatnonzero(label == values[held.argmax()])[0]
    for x in range(m):
        if label[x] == label[largest]:
            continue
        mine = own(x)
        shared = np.bincount(_ranges(holders, ends, mine[rare[mine]]), minlength=m) + np.minimum(usual, usual[x])
        near = np.flatnonzero((100 * shared >= percent * (n + n[x] - shared)) & (label != label[x]))
        if not len(near):
            continue
        mask[mine] = 1
        for at in range(0, len(near), AT_ONCE):
            some = near[at : at + AT_ONCE]
            common = np.add.reduceat(mask[_ranges(code, starts, some)], np.concatenate([[0], np.cumsum(n[some])[:-1]]))
            for y in some[100 * common >= percent * (n[some] + n[x] - common)]:
                if label[y] != label[x]:
                    join(x, y)
        mask[mine] = 0
    return found


#: Elements that one set in so many has, or fewer, are looked up; so many sets are compared in full at once.
RARE, AT_ONCE = 8, 1024


def _ranges(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``values[ends[i] : ends[i + 1]]`` for each i of ``which``, one after another."""
    size = ends[which + 1] - ends[which]
    return values[np.repeat(ends[which] - np.cumsum(size) + size, size) + np.arange(size.sum())]


def _join_crowds(crowded: DataFrame, stars: DataFrame, sets: DataFrame, rules: Forest) -> DataFrame | None:
    """Links (a, b) between components that meet in a crowd; None where no crowd has two."""
    rows = crowded.join(stars, "node", "left").select("tree", "start", "node", F.coalesce("root", "node").alias("root"))
    same = (F.count("*").alias("_n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("_h"))
    split = rows.groupBy("tree", "start").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), *same).where("_a <> _b")
    # trees in which the same classes are a crowd need one look
    split = split.groupBy("_n", "_h").agg(F.min(F.struct("tree", "start")).alias("c")).select("c.tree", "c.start")
    rows = materialize(attach(rows, materialize(split, "split"), ["tree", "start"]).join(sets.select(F.col("set_key").alias("node"), F.length("set").alias("bytes")), "node"), "crowded")
    blocks = materialize(rows.groupBy("tree", "start").agg(F.ceil(F.sum("bytes") / rules.block).cast("int").alias("k")), "blocks")
    if not blocks.count():
        return None
    rows = attach(rows, blocks, ["tree", "start"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("tree", "start", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "root").join(sets.select(F.col("set_key").alias("node"), "set"), "node")
    percent, region = rules.percent, rules.region

    def run(table):
        node = table.column("node").to_pylist()
        found = crowd_links([np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")], table.column("root").to_pylist(), percent, region)
        pairs = [sorted((node[x], node[y])) for x, y in found]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    ship(rows.sparkSession)
    return materialize(rows.groupBy("tree", "start", "i", "j").applyInArrow(run, "a binary, b binary"), "joined")


ORDER = "tree int, value binary, sketch binary, node binary"
PAIR = "a binary, b binary, agree int, edge boolean, tree int, value binary, sketch binary"


def _fixed(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return data.view(dtype).reshape(len(column), width // np.dtype(dtype).itemsize)


def _pairs_of_partition(rules: Forest):
    def run(batches):
        held = [b for b in batches if b.num_rows]  # rows_per_task rows of about 100 bytes
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        get = lambda name: table.column(name).combine_chunks() if table.column(name).num_chunks != 1 else table.column(name).chunk(0)
        tree, node = get("tree").to_numpy(), get("node").to_pylist()
        values = _fixed(get("value"), 2 * rules.depth, ">u2")
        sketch = _fixed(get("sketch"), rules.values // 4, np.uint64)
        a, b, agree = [], [], []
        odd = np.uint64(0x5555555555555555)
        for i, j in neighbours(tree, values, rules):
            x = sketch[i] ^ sketch[j]
            hits = rules.values - np.bitwise_count((x | x >> np.uint64(1)) & odd).sum(axis=1, dtype=np.int64)
            for k in np.flatnonzero(hits >= rules.least_agreement):
                p, q = node[i[k]], node[j[k]]
                a.append(min(p, q)), b.append(max(p, q)), agree.append(int(hits[k]))
        n = table.num_rows
        ends = sorted({*range(min(rules.region, n)), *range(max(0, n - rules.region), n)})
        edge = [True] * len(ends)
        none = [None] * len(a)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(a + [node[i] for i in ends], pa.binary()), pa.array(b + [None] * len(ends), pa.binary()), pa.array(agree + [None] * len(ends), pa.int32()), pa.array([False] * len(a) + edge, pa.bool_()),
                pa.array(none + [int(tree[i]) for i in ends], pa.int32()), pa.array(none + get("value").take(pa.array(ends)).to_pylist(), pa.binary()), pa.array(none + get("sketch").take(pa.array(ends)).to_pylist(), pa.binary()),
            ],
            names=["a", "b", "agree", "edge", "tree", "value", "sketch"],
        )

    return run


def candidates(classes: DataFrame, rules: Forest) -> DataFrame:
    """Pairs (a, b, agree) of classes (set_key, signature, sketch) that share a region of some tree.

    Sorted orders are dealt out by range.  The first and last ``region`` rows
    of each task are sorted once more among themselves, until one task holds
    them, so no neighbours are lost where two ranges meet.
    """
    step = 2 * rules.depth
    rows = classes.select(F.col("set_key").alias("node"), "sketch", "signature", F.explode(F.sequence(F.lit(0), F.lit(rules.trees - 1))).alias("tree"))
    rows = rows.select("tree", F.substring("signature", F.col("tree") * step + 1, F.lit(step)).alias("value"), "sketch", "node")
    count = classes.count() * rules.trees
    found = []
    while True:
        tasks = ceil(count / rules.rows_per_task)
        last = tasks <= 1
        dealt = rows.repartition(1) if last else rows.repartitionByRange(tasks, "tree", "value", "node")
        done = materialize(dealt.sortWithinPartitions("tree", "value", "node").transform(arrow_map, _pairs_of_partition(rules), PAIR), "pairs")
        found.append(done.where("not edge").select("a", "b", "agree"))
        if last:
            break
        rows = done.where("edge").select("tree", "value", "sketch", F.col("a").alias("node"))
        count = min(count - 1, rows.count())
        if count <= rules.rows_per_task:
            count = 0
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _confirm(pairs: DataFrame, sets: DataFrame, rules: Forest) -> DataFrame:
    """The pairs whose full sets have the similarity asked for."""
    with_a = pairs.select("a", "b").join(sets.select(F.col("set_key").alias("a"), F.col("set").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("set_key").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                least, most = sorted((len(x), len(y)))
                common = len(np.intersect1d(x, y, assume_unique=True)) if 100 * least >= rules.percent * most else 0
                ok.append(100 * common >= rules.percent * (least + most - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.transform(arrow_map, run, "a binary, b binary")


def _full_sets(df: DataFrame, key: str, text: str, wanted: DataFrame, rules: Forest) -> DataFrame:
    """set_key and full set of each wanted class (set_key, rep), from the text of its representative."""

    def run(batches):
        words = _Words()
        for batch in batches:
            sets = [shingles(x.as_py(), rules.shingle, words).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "set"])

    reps = wanted.select(F.col("rep").alias("_rep")).distinct()
    reps = F.broadcast(reps) if reps.count() <= 200_000 else reps
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = texts.join(reps, F.col("_key") == F.col("_rep"), "left_semi").select("_text").transform(arrow_map, run, "set_key binary, set binary")
    nameless = wanted.where("rep is null").select("set_key")
    if nameless.limit(1).count():
        rows = rows.unionByName(texts.where("_key is null").select("_text").transform(arrow_map, run, "set_key binary, set binary").join(nameless, "set_key", "left_semi"))
    return rows.dropDuplicates(["set_key"])


#: How many of a class's candidates between components are confirmed in each round; the last round takes all.
ROUNDS = (1, 4, None)


def links(df: DataFrame, classes: DataFrame, key: str, text: str, rules: Forest) -> DataFrame:
    """``node, root`` of each class that has a link."""
    pairs = materialize(candidates(classes, rules), "candidates")
    crowded = materialize(crowds(classes, rules), "crowded")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).unionByName(crowded.select(F.col("node").alias("set_key"))).distinct()
    sets = materialize(_full_sets(df, key, text, classes.join(nodes, "set_key", "left_semi"), rules), "sets")
    stars = None
    for budget in ROUNDS:
        left = pairs
        if stars is not None:
            name = lambda c: stars.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
            left = left.join(name("a"), "a", "left").join(name("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        left = left.select("a", "b", "agree")
        if budget:
            both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
            first = W.partitionBy("a").orderBy(F.desc("agree"), "b")
            best = both.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= budget)
            left = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        good = materialize(_confirm(left, sets, rules), "confirmed")
        if stars is not None:
            good = good.unionByName(stars.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
        stars = materialize(components(good), "stars")
    more = _join_crowds(crowded, stars, sets, rules)
    if more is not None:
        stars = materialize(components(more.unionByName(stars.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))), "stars")
    drop(sets)
    return stars


def _judged(df: DataFrame, key: str, text: str, rules: Forest, nameless: bool) -> DataFrame:
    """key, text_hash, n_shingles and set_key of each row, the class that is the first of its component and the id of that.

    Classes without any id take part if ``nameless``, behind all others.
    """
    rows = materialize(_sketch(df, key, text, rules), "sketches")
    rep = rows.where("set_key is not null").groupBy("set_key").agg(F.min("key").alias("rep"))
    rep = rep if nameless else rep.where("rep is not null")
    first = rows.select("key", "set_key", "signature", "sketch").join(rep.withColumnRenamed("set_key", "_k"), F.col("key").eqNullSafe(F.col("rep")) & (F.col("set_key") == F.col("_k"))).dropDuplicates(["set_key"])
    classes = materialize(first.select("set_key", "rep", "signature", "sketch"), "classes")
    stars = links(df, classes, key, text, rules)
    # the smallest id that each class reaches
    order = F.struct(F.col("rep").isNull().alias("nameless"), "rep", F.col("node").alias("set_key"))
    least = stars.join(classes.select(F.col("set_key").alias("node"), "rep"), "node").groupBy("root").agg(F.min(order).alias("least"))
    least = materialize(least, "least")
    named = attach(stars, least, ["root"]).select(F.col("node").alias("set_key"), F.col("least.rep").alias("component_id"), F.col("least.set_key").alias("first"))
    per_class = classes.select("set_key", "rep").join(named, "set_key", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("first", "set_key").alias("first"))
    per_class = materialize(per_class, "components")
    return rows.select("key", "text_hash", "n_shingles", "set_key").join(per_class, "set_key", "left")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Forest = Forest()) -> DataFrame:
    """key, n_shingles, component_id and kept for each row of ``df``."""
    out = _judged(df, key, text, rules, False)
    component = F.coalesce("component_id", "key")
    kept = F.when(F.col("key").isNull() | F.col("set_key").isNull(), True).otherwise((F.col("key") == component) & (F.col("set_key") == F.col("first")))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), kept.alias("kept"))


def first_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Forest = Forest()) -> DataFrame:
    """The rows of ``df`` that are the first of their group, one for each group."""
    rows = materialize(_judged(df, key, text, rules, True).where("key is not null or set_key is not null"), "judged")
    first = rows.where("set_key is null or (set_key = first and key <=> component_id)").groupBy("key", "set_key").agg(F.min("text_hash").alias("text_hash"))
    stay = materialize(first.select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash")), "first")
    here = lambda t: F.col("key").eqNullSafe(t["_key"]) & (F.col("text_hash") == t["_hash"])
    counts = rows.groupBy("key", "text_hash").agg(F.count("*").alias("n"))
    gone = materialize(counts.join(stay, here(stay), "left_anti").select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash")), "duplicates")
    again = materialize(counts.where("n > 1").join(stay, here(stay), "left_semi").select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash")), "repeated")

    def within(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        small = listed.count() <= 200_000
        return rows.join(F.broadcast(listed) if small else listed, rows[key].eqNullSafe(listed["_key"]) & (F.xxhash64(rows[text]) == listed["_hash"]), how)

    out = within(df, gone, "left_anti")
    if not again.count():
        return out
    # only repeated rows are moved
    return within(out, again, "left_anti").unionByName(within(df, again, "left_semi").dropDuplicates([key, text]))


#: Two-word shingles and components in DuckDB, over table ``documents``.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked
), reach AS (
  SELECT a AS node, b AS other FROM both_ways
  UNION SELECT r.node, b.b FROM reach r JOIN both_ways b ON b.a = r.other
), least AS (SELECT node, min(other) AS first FROM reach GROUP BY node)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(first, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(first, s.doc_id)) AS kept
FROM s LEFT JOIN least ON node = s.doc_id
"""
