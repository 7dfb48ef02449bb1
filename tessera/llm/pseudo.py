"""Masked pseudo-likelihood scores from a bidirectional window network.

The network sees the words on both sides of a masked one and predicts it:
embeddings of ``side`` words left and right, one tanh layer, and a softmax in
two steps (class, then word within its class).  It is trained in numpy: every
partition makes one pass of Adagrad from the same start over all windows of all
its texts, and the weights are averaged by windows seen, so training grows with
the table.  A text's score is the sum of the conditional
log-probabilities of its words, all of them.

The vocabulary comes from counts over all texts: frequent words stand for
themselves, the others share hashed entries.

Defined results for odd input: words are lower-cased runs without ASCII white
space; a null or blank text has no words, sum 0 and a null mean; very long texts
are trained on and scored whole; repeated rows score alike; words that tie in
frequency enter the vocabulary by their bytes; with an empty table the start
weights stay; other columns than key and text, whatever their names, are not used.
"""

from __future__ import annotations

import ctypes
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, drop, materialize


@dataclass(frozen=True)
class Network:
    side: int = 2
    embed: int = 16
    hidden: int = 32
    classes: int = 64
    per_class: int = 64
    #: Entries that rare words share; the last class boundary of the vocabulary.
    shared: int = 1024
    #: Words that make up at least this part of all words may have an entry of their own.
    rarest: int = 1 << 15
    batch: int = 4096
    rate: float = 0.1
    block: int = 1 << 14
    seed: int = 10

    @property
    def size(self) -> int:
        return self.classes * self.per_class


class Words(dict):
    """Ids of words; those outside the vocabulary go to shared entries.  Id 0 is the edge of a text."""

    def __init__(self, known: list[bytes], net: Network):
        super().__init__({w: i + 1 for i, w in enumerate(known)})
        self.first, self.shared, self.held = net.size - net.shared, net.shared, len(known) + 300_000
        self.known = known

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.held:
            self.clear()
            self.update((w, i + 1) for i, w in enumerate(self.known))
        value = self[word] = self.first + xxhash.xxh3_64_intdigest(word) % self.shared
        return value


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def word_counts(df: DataFrame, text: str, held: int = 200_000) -> DataFrame:
    """word, n over all texts; the null word has the number of all."""

    def run(batches):
        counts: Counter = Counter()
        total = 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.binary()), pa.array([*counts.values(), total], pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                found = words_of(value.as_py())
                counts.update(found)
                total += len(found)
                if len(counts) > held:
                    yield flush()
                    total = 0
        yield flush()

    return df.select(text).transform(arrow_map, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(df: DataFrame, text: str, net: Network) -> list[bytes]:
    """The most frequent words, in that order (ties: the smaller word first)."""
    counts = materialize(word_counts(df, text).where((F.col("n") >= 4) | F.col("word").isNull()), "counts")
    total = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where(F.col("word").isNotNull() & (F.col("n") * net.rarest >= total)).collect()  # at most ``rarest`` rows
    drop(counts)
    rows.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    return [bytes(r["word"]) for r in rows[: net.size - net.shared - 1]]


def start(net: Network) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(net.seed)
    normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    width = 2 * net.side * net.embed
    return {
        "emb": normal(net.size, net.embed), "w": normal(width, net.hidden), "b": np.zeros(net.hidden, np.float32),
        "uc": normal(net.hidden, net.classes), "bc": np.zeros(net.classes, np.float32), "uw": normal(net.classes, net.hidden, net.per_class), "bw": np.zeros((net.classes, net.per_class), np.float32),
    }


def windows(ids: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
    """Ids around the positions ``at`` of a padded array."""
    return np.stack([ids[at + d] for d in [*range(-side, 0), *range(1, side + 1)]], axis=1)


def _log_chosen(z: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
    """Log-softmax of each row's chosen column; ``safe``: no exponential can overflow."""
    if not safe:
        z -= z.max(axis=1, keepdims=True)
    chosen = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return chosen - np.log(z.sum(axis=1))


def _softmax_error(z: np.ndarray, at: np.ndarray, safe: bool) -> None:
    """Turns ``z`` into its softmax less one in each row's chosen column."""
    if not safe:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(z)), at] -= 1


def _bound(u: np.ndarray, b: np.ndarray, axis: int) -> bool:
    """Can no logit reach 80, where exponentials overflow?"""
    return float((np.abs(u).sum(axis=axis) + np.abs(b)).max()) < 80


def log_probabilities(p: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray, net: Network) -> np.ndarray:
    h = p["emb"][around].reshape(len(around), -1) @ p["w"]
    h += p["b"]
    np.tanh(h, out=h)
    group, inside = np.divmod(target, net.per_class)
    order = np.argsort(group.astype(np.uint16), kind="stable")
    group, inside, h = group[order], inside[order], h[order]
    z = h @ p["uc"]
    z += p["bc"]
    out = _log_chosen(z, group, _bound(p["uc"], p["bc"], 0)).astype(np.float64)
    ends = np.searchsorted(group, np.arange(net.classes + 1))
    safe = _bound(p["uw"], p["bw"], 1)
    for c in np.flatnonzero(np.diff(ends)):
        part = slice(ends[c], ends[c + 1])
        z = h[part] @ p["uw"][c]
        z += p["bw"][c]
        out[part] += _log_chosen(z, inside[part], safe)
    back = np.empty_like(out)
    back[order] = out
    return back


class Trainer:
    """Adagrad over mini-batches."""

    def __init__(self, p: dict[str, np.ndarray], net: Network):
        self.p, self.net, self.seen = {k: v.copy() for k, v in p.items()}, net, 0
        self.g = {k: np.full_like(v, 1e-4) for k, v in p.items()}

    def _move(self, name: str, grad: np.ndarray, rows=slice(None)) -> None:
        self.g[name][rows] += grad * grad
        self.p[name][rows] -= self.net.rate * grad / np.sqrt(self.g[name][rows])

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        p, net, n = self.p, self.net, len(target)
        group, inside = np.divmod(target, net.per_class)
        order = np.argsort(group.astype(np.uint16), kind="stable")
        group, inside, around = group[order], inside[order], around[order]
        x = p["emb"][around].reshape(n, -1)
        h = x @ p["w"]
        h += p["b"]
        np.tanh(h, out=h)
        safe = _bound(p["uc"], p["bc"], 0), _bound(p["uw"], p["bw"], 1)
        d = h @ p["uc"]
        d += p["bc"]
        _softmax_error(d, group, safe[0])
        dh = d @ p["uc"].T
        guc, gbc = h.T @ d, d.sum(axis=0)
        guw, gbw = np.zeros_like(p["uw"]), np.zeros_like(p["bw"])
        ends = np.searchsorted(group, np.arange(net.classes + 1))
        for c in np.flatnonzero(np.diff(ends)):
            part = slice(ends[c], ends[c + 1])
            e = h[part] @ p["uw"][c]
            e += p["bw"][c]
            _softmax_error(e, inside[part], safe[1])
            dh[part] += e @ p["uw"][c].T
            np.matmul(h[part].T, e, out=guw[c])
            gbw[c] = e.sum(axis=0)
        for name, grad in (("uw", guw), ("bw", gbw), ("uc", guc), ("bc", gbc)):
            grad /= n
            self._move(name, grad)
        h *= h
        np.subtract(1, h, out=h)
        h *= dh
        h /= n  # the gradient before the tanh
        dx = (h @ p["w"].T).reshape(-1, net.embed)
        self._move("w", x.T @ h), self._move("b", h.sum(axis=0))
        flat = around.ravel()
        by_word = np.argsort(flat.astype(np.uint16) if net.size <= 1 << 16 else flat, kind="stable")
        flat = flat[by_word]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self._move("emb", np.add.reduceat(dx[by_word], first, axis=0), flat[first])
        self.seen += n


def keep_memory() -> bool:
    """Let this process keep up to 64 MB that it freed: otherwise each step's arrays are pages that the system takes back and clears again.  Only where the C library can."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return False
    return bool(mallopt(-3, 16 << 20)) and bool(mallopt(-1, 64 << 20))  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD


def _kind(net: Network) -> str:
    return "<u2" if net.size <= 1 << 16 else "<u4"


def index(df: DataFrame, known: list[bytes], key: str = "doc_id", text: str = "text", net: Network = Network()) -> DataFrame:
    """key and the ids of the words of each row, as bytes."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.BinaryType())])
    shared = df.sparkSession.sparkContext.broadcast(known)
    kind = _kind(net)

    def run(batches):
        words = Words(shared.value, net)
        for batch in batches:
            found = [words_of(value.as_py()) for value in batch.column(1)]
            ids = [np.fromiter(map(words.__getitem__, f), kind, len(f)).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=schema.names)

    return df.select(F.col(key), F.col(text)).transform(arrow_map, run, schema)


def _portions(batches, net: Network, column: int = 0):
    """Padded ids of many texts in one array, and how many each text has."""
    pad = np.zeros(net.side, np.int32)
    held, sizes, total, kind = [pad], [], 0, _kind(net)
    for batch in batches:
        for value in batch.column(column):
            ids = np.frombuffer(value.as_py(), kind)
            held += [ids, pad]
            sizes.append(len(ids))
            total += len(ids)
            if total >= net.block:
                yield np.concatenate(held), np.array(sizes)
                held, sizes, total = [pad], [], 0
    if sizes:
        yield np.concatenate(held), np.array(sizes)


def _positions(sizes: np.ndarray, net: Network) -> np.ndarray:
    text = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(text)) + net.side * (text + 1)


#: Weights are averaged as whole numbers, so their order does not matter.
FIXED = 1 << 24
CHUNK, LOW = 4096, (1 << 32) - 1
#: Parts in which the copies of a chunk are added up, before the parts' sums are.
PARTS = 32
WEIGHTS = "chunk long, high array<long>, low array<long>, seen long, part int"


def _weights(chunk: int, high: np.ndarray, low: np.ndarray, seen: int, part: int = 0) -> pa.RecordBatch:
    one = lambda x: pa.array([x], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), one(high), one(low), pa.array([seen], pa.int64()), pa.array([part], pa.int32())], names=["chunk", "high", "low", "seen", "part"])


def _add(batches):
    """Sums of each chunk of weights over the copies that a task meets; it holds one array for each chunk."""
    sums: dict[int, list] = {}
    for batch in batches:
        for chunk, high, low, seen in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
            high, low = (x.values.to_numpy() for x in (high, low))
            if chunk not in sums:
                sums[chunk] = [np.zeros(len(high), np.int64), np.zeros(len(low), np.int64), 0]
            own = sums[chunk]
            own[0] += high
            own[1] += low
            own[0] += own[1] >> 32
            own[1] &= LOW
            own[2] += seen
    for chunk, (high, low, seen) in sums.items():
        yield _weights(chunk, high, low, seen)


def train_on(indexed: DataFrame, known: list[bytes], net: Network = Network()) -> tuple[list[bytes], dict[str, np.ndarray]]:
    """The vocabulary and the averaged weights of all partitions of a table with ``ids``."""
    first = start(net)
    shared = indexed.sparkSession.sparkContext.broadcast(first)

    def run(batches):
        keep_memory()
        model, copy = Trainer(shared.value, net), TaskContext.get().partitionId() if TaskContext.get() else 0
        around, target, size = [], [], 0
        for ids, sizes in _portions(batches, net):
            at = _positions(sizes, net)
            around.append(windows(ids, at, net.side)), target.append(ids[at])
            size += len(at)
            if size >= net.batch:
                a, t = np.concatenate(around), np.concatenate(target)
                for i in range(0, size - net.batch + 1, net.batch):
                    model.step(a[i : i + net.batch], t[i : i + net.batch])
                done = size // net.batch * net.batch
                around, target, size = [a[done:]], [t[done:]], size - done
        if size:
            model.step(np.concatenate(around), np.concatenate(target))
        if model.seen:
            flat = np.concatenate([v.ravel() for v in model.p.values()]).astype(np.float64)
            flat = np.round(flat * FIXED).astype(np.int64) * model.seen
            # numbers of the same chunk meet again; a chunk is a bounded row
            for i in range(0, len(flat), CHUNK):
                part = flat[i : i + CHUNK]
                yield _weights(i, part >> 32, part & LOW, model.seen, copy % PARTS)

    rows = indexed.select("ids").transform(arrow_map, run, WEIGHTS)
    n = sum(v.size for v in first.values())
    sums = rows.repartition("chunk", "part").transform(arrow_map, _add, WEIGHTS)
    table = sums.repartition(max(1, n // CHUNK // 8), "chunk").transform(arrow_map, _add, WEIGHTS).toArrow()  # one row for each chunk
    if not table.num_rows:
        return known, first
    flat = np.concatenate([v.ravel() for v in first.values()]).astype(np.float64)
    for row in table.to_pylist():
        high, low = np.array(row["high"], np.float64), np.array(row["low"], np.float64)
        flat[row["chunk"] : row["chunk"] + len(high)] = (high * 2.0**32 + low) / row["seen"] / FIXED
    out, at = {}, 0
    for k, v in first.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return known, out


def score_on(indexed: DataFrame, model: tuple[list[bytes], dict[str, np.ndarray]], key: str = "doc_id", net: Network = Network()) -> DataFrame:
    """key, n_words, pseudo_log_likelihood and mean_log_probability of each row of a table with ``ids``."""
    shared = indexed.sparkSession.sparkContext.broadcast(model[1])
    schema = T.StructType([T.StructField(key, indexed.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("pseudo_log_likelihood", T.DoubleType()), T.StructField("mean_log_probability", T.DoubleType())])

    def run(batches):
        keep_memory()
        p = shared.value
        for batch in batches:
            counts, sums = [], []
            for ids, sizes in _portions([batch], net, 1):
                at = _positions(sizes, net)
                logs = np.zeros(len(at))
                for i in range(0, len(at), net.block):
                    some = at[i : i + net.block]
                    logs[i : i + net.block] = log_probabilities(p, windows(ids, some, net.side), ids[some], net)
                total = np.concatenate([[0.0], np.cumsum(logs)])
                ends = np.cumsum(sizes)
                counts.append(sizes), sums.append(total[ends] - total[ends - sizes])
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            s = np.concatenate(sums) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(s), pa.array(s / np.maximum(n, 1), mask=n == 0)], names=schema.names)

    return indexed.select(F.col(key), "ids").transform(arrow_map, run, schema)


def train(df: DataFrame, text: str = "text", net: Network = Network(), known: list[bytes] | None = None) -> tuple[list[bytes], dict[str, np.ndarray]]:
    """The vocabulary and the averaged weights of all partitions."""
    known = vocabulary(df, text, net) if known is None else known
    return train_on(index(df.select(F.lit(0).alias("_k"), F.col(text)), known, "_k", text, net), known, net)


def score(df: DataFrame, model: tuple[list[bytes], dict[str, np.ndarray]], key: str = "doc_id", text: str = "text", net: Network = Network()) -> DataFrame:
    """The scores of each row under a model trained on these or other texts: see ``score_on``."""
    return score_on(index(df, model[0], key, text, net), model, key, net)


def train_and_score(df: DataFrame, key: str = "doc_id", text: str = "text", net: Network = Network()) -> DataFrame:
    """Scores of each row under the model of all of them; words become ids once."""
    known = vocabulary(df, text, net)
    indexed = materialize(index(df, known, key, text, net), "word-ids")
    return score_on(indexed, train_on(indexed, known, net), key, net)
