"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes of lower-cased
UTF-8.  A byte that a context has not seen is coded by an escape and the next
shorter context (escape method C, no exclusions); below the empty context all
256 bytes are equally likely.  The statistics are frozen, so the code length of
every (context, byte) is known beforehand: a tree becomes an automaton over the
last bytes, with a table of code lengths for each state and byte class.  A text
is scored by a few vectorised look-ups for each byte and language, over its
whole length, and goes to the language with the shortest code.

A tree comes from its own language's sample alone and keeps every context of up
to ``order`` bytes that this sample holds ``min_count`` times or more, so the code
lengths of a language do not depend on which others there are.  Lengths are
rounded to 1/UNIT bit for each byte and not clipped.  Trees are counted and
compiled by the executors, one task for the bounded sample of each language, and
stored; the driver holds the names, the limits and the trees of one pass.  A pass
takes as many languages as ``per_pass`` and ``pass_bytes`` allow, so there is no
limit to their number.

Defined results for odd input: a null text and one without a letter are ``und``
with score 0; ties go to the smaller language name; rows with a null language,
text or key are not learned from, and of rows that share key and language one
is; without any labelled text everything is ``und``; very long texts are learned
from and scored whole; an empty table gives an empty table; repeated rows are
scored alike; columns named like one that is added are replaced, all others
pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import arrow_map, attach, drop, materialize, named_again, numbered, replacing, ship

#: Code lengths are held in units of 1/UNIT bit.
UNIT = 512
START = 10  # a text is coded as if line feeds stood before it
BLOCK = 1 << 20
#: Distinct grams of single texts that are held before they are added up.
MERGE = 1 << 22


@dataclass(frozen=True)
class Training:
    """Bounds of the sample that the trees are grown from; they hold at any size of the table."""

    #: Rows of each language that are learned from, and further ones on which the usual code length is measured.
    rows_per_language: int = 300
    calibration: int = 100
    order: int = 3
    min_count: int = 3
    #: Languages that are shipped together, how many such blocks a pass takes, and the bytes of tables at which it ends.
    block: int = 4
    per_pass: int = 8
    pass_bytes: int = 192 << 20
    #: A text of a language may cost so many times the 99th percentile of its calibration rows.
    slack: float = 2.0


Counts = list[tuple[np.ndarray, np.ndarray]]


def _counted(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at, inverse = np.unique(np.concatenate(grams) if grams else np.zeros(0, np.int64), return_inverse=True)
    weight = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return at, np.bincount(inverse, weight, len(at)).astype(np.int64)


def gram_counts(texts: list[str], order: int) -> Counts:
    """For each order, codes of the context's bytes (older ones weigh more) and the next byte, with counts."""
    held: list[tuple[list, list]] = [([], []) for _ in range(order + 1)]
    size = 0
    for text in texts:
        row = np.frombuffer(text.lower().encode(), np.uint8)
        c = np.concatenate([np.full(order, START), row]).astype(np.int64)
        code = c[order:].copy()
        for k in range(order + 1):
            if k:
                code = code + (c[order - k : len(c) - k] << 8 * k)
            gram, n = np.unique(code, return_counts=True)
            held[k][0].append(gram), held[k][1].append(n)
            size += len(gram)
        if size > MERGE:
            held = [([gram], [n]) for gram, n in (_counted(*h) for h in held)]
            size = 0
    return [_counted(*h) for h in held]


class Tree:
    """Frozen statistics of one language: byte classes, the automaton's tables and code lengths."""

    def __init__(self, classes: np.ndarray, width: int, walks: list[np.ndarray], costs: np.ndarray):
        self.classes, self.width, self.walks, self.costs = classes, width, walks, costs

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in [self.costs, *self.walks])

    @classmethod
    def compile(cls, counts: Counts, rules: Training = Training()) -> Tree:
        present = np.zeros(256, bool)
        present[START] = True
        present[counts[0][0]] = True
        width = int(present.sum()) + 1  # class 0: bytes that the sample does not have
        classes = np.zeros(256, np.int64)
        classes[present] = np.arange(1, width)
        # the same grams with classes in the place of bytes, in ascending order as before
        counted = [(sum(classes[gram >> 8 * j & 255] * width**j for j in range(k + 1)), n) for k, (gram, n) in enumerate(counts)]
        # contexts of each order that are frequent enough, with their suffixes
        kept = [np.zeros(1, np.int64), np.arange(width)]
        for k in range(2, rules.order + 1):
            at, total = _counted([counted[k][0] // width], [counted[k][1]])
            kept.append(at[(total >= rules.min_count) & np.isin(at % width ** (k - 1), kept[-1])])
        tables = []
        for k, at in enumerate(kept):
            if not len(at):
                tables.append(np.empty((0, width)))
                continue
            here = np.full((1, width), 8.0) if k == 0 else tables[-1][np.searchsorted(kept[k - 1], at % max(1, width ** (k - 1)))]
            gram, n = counted[k]
            where = np.searchsorted(at, gram // width)
            ok = (where < len(at)) & (at[np.minimum(where, len(at) - 1)] == gram // width)
            where, symbol, n = where[ok], gram[ok] % width, n[ok]
            seen, kinds = np.bincount(where, n, len(at)), np.bincount(where, None, len(at))
            some = seen > 0
            escape = np.zeros(len(at))
            escape[some] = np.log2((seen + kinds)[some] / kinds[some])
            here += escape[:, None]
            here[where, symbol] = np.log2((seen + kinds)[where] / n)
            tables.append(here)
        # walks[k]: (outcome of the k-1 last bytes, class of the byte before them) -> outcome; an outcome that found no longer context stays
        order = max(1, rules.order)
        outcomes = np.arange(width)  # codes of the contexts of order 1
        depth = np.ones(width, np.int64)
        walks = []
        for k in range(2, order + 1):
            deeper = depth == k - 1
            nexts = outcomes[:, None] + np.arange(width)[None, :] * width ** (k - 1)
            where = np.searchsorted(kept[k], nexts)
            found = deeper[:, None] & (where < len(kept[k])) & (kept[k][np.minimum(where, max(0, len(kept[k]) - 1))] == nexts if len(kept[k]) else False)
            table = np.where(found, where, len(kept[k]) + np.arange(len(outcomes))[:, None])
            walks.append(table.astype(np.int32).ravel())
            outcomes, depth = np.concatenate([kept[k], outcomes]), np.concatenate([np.full(len(kept[k]), k), depth])
        final = np.concatenate([np.empty((0, width))] + [tables[d][np.searchsorted(kept[d], outcomes[depth == d])] for d in range(order, 0, -1)])
        final = np.round(final * UNIT)
        return cls(classes.astype(np.int16), width, walks, final.astype(np.uint16 if final.max() < 1 << 16 else np.uint32).ravel())

    def costs_of(self, last_bytes: list[np.ndarray], following: np.ndarray) -> np.ndarray:
        """Units of code of each following byte after the bytes before it."""
        state = self.classes[last_bytes[0]].astype(np.int32)
        for walk, byte in zip(self.walks, last_bytes[1:]):
            state *= self.width
            state += self.classes[byte]
            state = walk[state]
        state *= self.width
        state += self.classes[following]
        return self.costs[state]


class Trees:
    """The trees of a block of languages."""

    def __init__(self, languages: list[str], trees: list[Tree]):
        self.languages, self.trees = languages, trees

    @classmethod
    def grow(cls, texts: dict[str, list[str]], rules: Training = Training()) -> Trees:
        names = sorted(texts)
        return cls(names, [Tree.compile(gram_counts([t for t in texts[n] if t], rules.order), rules) for n in names])

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Units of code for each text and language; text i is data[offsets[i]:offsets[i + 1]]."""
        n, order = len(offsets) - 1, len(self.trees[0].walks) + 1
        total = np.zeros((n, len(self.languages)), np.int64)
        start, end = int(offsets[0]), int(offsets[-1])
        for lo in range(start, end, BLOCK):
            hi = min(lo + BLOCK, end)
            first, last = np.searchsorted(offsets, [lo, hi], "right") - 1
            edges = offsets[first + 1 : last + 1]
            edges = edges[edges < hi]
            back = min(order, lo - start)
            c = np.concatenate([np.full(order - back, START, np.uint8), data[lo - back : hi]])
            m = hi - lo
            begun = offsets[np.searchsorted(offsets, np.arange(lo, min(lo + order, hi)), "right") - 1]
            early = np.unique(np.concatenate([edges, begun]))
            last_bytes = []
            for j in range(1, order + 1):
                b = c[order - j : order - j + m].copy()
                for back_by in range(j):  # the first j bytes of each text see line feeds
                    at = early + back_by - lo
                    at = at[(at >= 0) & (at < m) & (np.searchsorted(offsets, early + back_by, "right") == np.searchsorted(offsets, early, "right"))]
                    b[at] = START
                last_bytes.append(b)
            cuts = np.unique(np.concatenate([[lo], edges]))
            whose = np.searchsorted(offsets, cuts, "right") - 1
            for j, tree in enumerate(self.trees):
                np.add.at(total[:, j], whose, np.add.reduceat(tree.costs_of(last_bytes, c[order:]), cuts - lo, dtype=np.int64))
        return total


@dataclass
class Model:
    """The stored trees of all languages in the order of their names, their sizes in bytes, and the greatest usual bits a byte of each language."""

    stored: DataFrame
    sizes: dict[str, int]
    limits: dict[str, float]
    rules: Training

    @property
    def languages(self) -> list[str]:
        return sorted(self.sizes)

    @property
    def blocks(self) -> list[Trees]:
        """All trees at once; ``passes`` has them a bounded number at a time."""
        return [trees for some in self.passes() for trees in some]

    def passes(self) -> Iterator[list[Trees]]:
        """The blocks of each pass, read as they are asked for."""
        names, block = self.languages, self.rules.block
        groups, held = [[]], 0
        for at in range(0, len(names), block):
            some = names[at : at + block]
            size = sum(self.sizes[n] for n in some)
            if groups[-1] and (len(groups[-1]) == self.rules.per_pass or held + size > self.rules.pass_bytes):
                groups.append([])
                held = 0
            groups[-1].append(some)
            held += size
        for group in groups:
            wanted = [n for some in group for n in some]
            trees = {r["_lang"]: pickle.loads(r["tree"]) for r in self.stored.where(F.col("_lang").isin(*wanted)).collect()}
            yield [Trees(some, [trees[n] for n in some]) for some in group]


def _sample(labelled: DataFrame, key: str, text: str, lang: str, rules: Training) -> DataFrame:
    """_lang, _r, _text: the rows of each language with the smallest hashes of their key; ``_r`` is their place.

    Counts first say below which hash to look, so that no language's rows are
    ranked but a few times as many as are wanted.
    """
    slim = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(lang).alias("_lang"), F.col(key).alias("_key"))
    wanted = rules.rows_per_language + rules.calibration
    sizes = materialize(slim.groupBy("_lang").agg(F.count("*").alias("_n")), "language-sizes")
    place = F.xxhash64("_key")
    low = (F.shiftrightunsigned(place, 1) / F.lit(2.0**63)) * F.col("_n") <= 4 * wanted
    near = attach(slim, sizes, ["_lang"]).where(low).select("_lang", "_key").distinct()
    first = F.row_number().over(W.partitionBy("_lang").orderBy(F.shiftrightunsigned(place, 1), "_key"))
    picked = materialize(near.withColumn("_r", first).where(F.col("_r") <= wanted), "language-keys")
    drop(sizes)
    body = labelled.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    rows = attach(body, picked, ["_key", "_lang"], limit=100_000)
    return materialize(rows.groupBy("_lang", "_key", "_r").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")).select("_lang", "_r", "_text"), "language-sample")


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rules: Training = Training()) -> Model | None:
    """Trees of every label, from a bounded sample of each."""
    sample = _sample(labelled, key, text, lang, rules)

    def compiled(table):
        rows = sorted(zip(table.column("_r").to_pylist(), table.column("_text").to_pylist()))
        tree = Tree.compile(gram_counts([t for _, t in rows if t], rules.order), rules)
        return pa.table({"_lang": table.column("_lang")[:1].cast(pa.string()), "size": pa.array([tree.nbytes], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    ship(labelled.sparkSession)
    stored = materialize(sample.where(F.col("_r") <= rules.rows_per_language).groupBy("_lang").applyInArrow(compiled, "_lang string, size long, tree binary"), "language-trees")
    sizes = {r["_lang"]: r["size"] for r in stored.select("_lang", "size").collect()}
    if not sizes:
        return None
    model = Model(stored, sizes, {}, rules)
    told = identify(sample.where(F.col("_r") > rules.rows_per_language), model, "_text")
    usual = told.where("lang_pred = _lang").groupBy("_lang").agg(F.percentile("bits_per_byte", F.lit(0.99)).alias("most"), F.count("*").alias("n"))
    model.limits = {r["_lang"]: rules.slack * r["most"] for r in usual.collect() if r["n"] >= 10}
    drop(sample)
    return model


def _told(column: pa.Array, blocks: list[Trees]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of the shortest code, its language, the sum of all languages' odds against it, and bytes, of each text."""
    n = len(column)
    least, names, odds = np.full(n, np.iinfo(np.int64).max >> 1), np.full(n, "", object), np.zeros(n)
    lower = pc.utf8_lower(column)
    offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(lower.buffers()[2] or b"", np.uint8) if n else np.zeros(0, np.uint8)
    for trees in blocks:
        units = trees.code_lengths(data, offsets)
        best = units.min(axis=1)
        here = np.exp2(-(units - best[:, None]) / UNIT).sum(axis=1)
        least, names, odds = _merged(least, names, odds, best, np.array(trees.languages, object)[units.argmin(axis=1)], here)
    return least, names, odds, np.diff(offsets)


def _merged(a, a_names, a_odds, b, b_names, b_odds):
    """Two blocks' results as one; ties stay with the first, whose names are smaller."""
    both = np.minimum(a, b)
    weigh = lambda units, odds: odds * np.exp2(np.maximum(-(units - both) / UNIT, -1000.0))
    return both, np.where(b < a, b_names, a_names), weigh(a, a_odds) + weigh(b, b_odds)


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``bits_per_byte``; columns that had these names are replaced."""
    df = replacing(df, "lang_pred", "score", "bits_per_byte")
    at, own = df.columns.index(text), len(df.columns)
    fields = df.schema.fields
    running = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("_units", T.LongType())]
    final = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    n, last = 0, False
    passes = iter(model.passes() if model else [[]])
    some = next(passes)
    while not last:
        coming = next(passes, None)
        last = coming is None
        schema = T.StructType([*fields, *(final if last else running)])
        shared = df.sparkSession.sparkContext.broadcast(some)
        df = df.transform(arrow_map, _scorer(shared, at, own, n == 0, last, schema.names), schema)
        if not last:
            df = materialize(df, "languages")
            shared.unpersist()
        some, n = coming, n + 1
    return df


def _scorer(shared, at: int, own: int, first: bool, last: bool, names: list[str]):
    """One pass: rows with the best language so far, or at last with the verdict."""

    def score(batches):
        blocks = shared.value
        for batch in batches:
            column = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
            units, told, odds, size = _told(column, blocks)
            if not first:
                units, told, odds = _merged(batch.column(own + 2).to_numpy(), np.array(batch.column(own).to_pylist(), object), batch.column(own + 1).to_numpy(), units, told, odds)
            if last:
                lettered = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool) & (odds > 0)
                told, third = np.where(lettered, told, "und"), np.where(odds > 0, units / UNIT / np.maximum(1, size), 0.0)
                odds = np.divide(1.0, odds, out=np.zeros(len(odds)), where=lettered)
            else:
                third = units
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(told, pa.string()), pa.array(odds), pa.array(third)], names=names)

    return score


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def filter_documents(df: DataFrame, model: Model | None, text: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows whose language is told with at least ``least_score`` and whose code is not much longer than that language's texts have it, with the columns of ``df``."""
    told = identify(numbered(df), model, f"c{df.columns.index(text)}")
    limits = model.limits if model else {}
    usual = F.lit(True)
    if limits:
        of = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        usual = F.col("bits_per_byte") <= F.coalesce(F.try_element_at(of, F.col("lang_pred")), F.lit(float("inf")))
    return named_again(told.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score) & usual), df.columns)
