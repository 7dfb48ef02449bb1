"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Word counts over all texts choose the lexicon.  Its words are compiled, sorted,
into the smallest acyclic automaton (suffixes are shared); the number of words
that each edge skips makes the path of a word its index, under which its ids
lie in one flat array.  The automaton is a file of plain arrays that each
worker maps into memory.  A batch's new words walk it together, one byte a
step; words that it lacks are merged exactly by the tokenizer's own model.

Normalisation and pre-tokenisation are repeated here for characters on which
all Unicode versions agree (``KNOWN``); a run without blanks that has any other
character is normalised and split by the tokenizer's own parts, so its words
meet the transducer like all others.  A special token that a text spells is an
id of its own.

Defined results for odd input: a null text counts as empty: no ids, empty
decoded text; repeated rows are encoded alike; an empty table gives an empty
table (and an empty lexicon); texts of any length are coded whole, one after
another within a row's memory; words that tie in frequency are all in the lexicon
or none is; other columns pass through, those that have an output's name are
replaced.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .common import arrow_map, drop, materialize, replacing
from .tokens import library

NAME = "word_bpe_49k.json"
END = "</w>"
#: The tokenizer's special tokens, which it finds in a text before anything else.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Latin with its extensions (but one capital that lower-cases to two characters), and punctuation that does not change when it is normalised.
KNOWN = [*range(0x130), *range(0x131, 0x250), *range(0x2010, 0x2028), 0x20AC]


def _ranges(codes: list[int]) -> str:
    """The inside of a character class."""
    runs: list[list[int]] = []
    for c in sorted(codes):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _class(kind: str) -> str:
    """Characters of a general category among the known ones and their lower case, part of which lies elsewhere."""
    return _ranges([c for c in {*KNOWN, *(ord(chr(c).lower()) for c in KNOWN)} if unicodedata.category(chr(c))[0] == kind])


_OTHER = re.compile(f"[^{_ranges(KNOWN)}]")
LETTERS, NUMBERS = _class("L"), _class("N")
#: White space of the tokenizer's own patterns, among known characters.
SPACES = r"\x09-\x0d\x20\x85\xa0"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
_SPECIAL = re.compile(f"({'|'.join(map(re.escape, SPECIAL))})")
#: No word and no normalisation reaches over these blanks.
_CHUNK = re.compile(r"[^ \t\n\r]+")


class Splitter:
    """The normalised words of texts: by patterns where all characters are known, by the tokenizer's own normaliser and splitter elsewhere."""

    def __init__(self, folder: str | None = None, held: int = 100_000):
        tok = library(NAME, folder)
        self.normalizer, self.held, self.chunks = tok.normalizer, held, {}
        self.pieces = pre_tokenizers.Split(Regex(json.loads(tok.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)

    def _foreign(self, chunk: str) -> list[str]:
        if chunk not in self.chunks:
            if len(self.chunks) > self.held:
                self.chunks.clear()
            self.chunks[chunk] = [w for w, _ in self.pieces.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
        return self.chunks[chunk]

    def words(self, text: str) -> list[str]:
        """A special token that the text spells is a word of its own."""
        if "<|" in text:
            parts = _SPECIAL.split(text)
            if len(parts) > 1:
                return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.words(part))]
        if text.isascii() or not _OTHER.search(text):
            return WORD.findall(text.lower())
        return [w for chunk in _CHUNK.findall(text) for w in (self._foreign(chunk) if _OTHER.search(chunk) else WORD.findall(chunk.lower()))]


class Lexicon:
    """The automaton's arrays: edges are ordered by their key, which is state << 8 | label."""

    FIELDS = ("key", "target", "skip", "final", "at", "ids")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def compile(cls, words: dict[str, list[int]]) -> Lexicon:
        """Incremental construction from sorted words."""
        items = sorted((w.encode(), ids) for w, ids in words.items())
        register: dict[tuple, int] = {}
        edges: list[tuple] = []  # of registered states: ((label, target), ...)
        finals: list[bool] = []
        path: list[list] = [[False, []]]  # open states: [final, edges]

        def close(state: list) -> int:
            key = (state[0], tuple(state[1]))
            if key not in register:
                register[key] = len(edges)
                edges.append(key[1])
                finals.append(state[0])
            return register[key]

        last = b""
        for word, _ in items:
            common = len(os.path.commonprefix([last, word]))
            while len(path) > common + 1:
                done = close(path.pop())
                path[-1][1].append((last[len(path) - 1], done))
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            done = close(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        root = close(path[0])
        reach = [0] * len(edges)  # words from a state on; targets are registered before their sources
        for s, out in enumerate(edges):
            reach[s] = finals[s] + sum(reach[t] for _, t in out)
        order = [root, *[s for s in range(len(edges)) if s != root]]
        number = {s: i for i, s in enumerate(order)}
        key, target, skip = [], [], []
        for s in order:
            passed = int(finals[s])
            for c, t in edges[s]:
                key.append(number[s] << 8 | c), target.append(number[t]), skip.append(passed)
                passed += reach[t]
        every = [ids for _, ids in items]
        return cls(
            key=np.array(key, np.int64), target=np.array(target, np.int64), skip=np.array(skip, np.int64), final=np.array([finals[s] for s in order], np.int64),
            at=np.concatenate([[0], np.cumsum([len(i) for i in every])]).astype(np.int64), ids=np.array([i for ids in every for i in ids], np.int64),
        )

    def save(self, file: str) -> None:
        with open(file, "wb") as out:
            np.array([len(getattr(self, n)) for n in self.FIELDS], np.int64).tofile(out)
            for n in self.FIELDS:
                getattr(self, n).astype(np.int64).tofile(out)

    @classmethod
    def open(cls, file: str) -> Lexicon:
        """Arrays that lie in the mapped file, not in this process."""
        with open(file, "rb") as f:
            data = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.int64)
        sizes = data[: len(cls.FIELDS)]
        ends = len(cls.FIELDS) + np.cumsum(sizes)
        return cls(**{n: data[e - s : e] for n, s, e in zip(cls.FIELDS, sizes, ends)})

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 for those that are missing."""
        n = len(words)
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if n else size
        state, index = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.arange(n)
        if not len(self.key):
            state[:] = -1
        for step in range(int(size.max()) if n and len(self.key) else 0):
            alive = alive[size[alive] > step]
            key = state[alive] << 8 | flat[begin[alive] + step]
            edge = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[edge] == key
            state[alive[~ok]] = -1
            alive, edge = alive[ok], edge[ok]
            index[alive] += self.skip[edge]
            state[alive] = self.target[edge]
            if not len(alive):
                break
        return np.where((state >= 0) & (self.final[np.maximum(state, 0)] > 0), index, -1)


def _chunks(column, most: int = 500_000):
    """Texts of a batch in portions of about ``most`` characters."""
    rows, size = [], 0
    for value in column:
        text = value.as_py() or ""
        rows.append(text)
        size += len(text)
        if size >= most:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def word_counts(df: DataFrame, text: str = "text", held: int = 200_000, most: int = 32 << 20, folder: str | None = None) -> DataFrame:
    """word, n over all texts; the row without a word has the number of all words.

    A task hands its counts on when it holds ``held`` words, or has read ``most``
    characters since it last did, so few very long words are bounded as well.
    """

    def run(batches):
        counts: Counter = Counter()
        splitter = Splitter(folder)
        total = size = 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), total], pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for texts in _chunks(batch.column(0)):
                for t in texts:
                    words = splitter.words(t)
                    counts.update(words)
                    total += len(words)
                    size += len(t)
                if len(counts) > held or size > most:
                    yield flush()
                    total = size = 0
        yield flush()

    return df.select(text).transform(arrow_map, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build(df: DataFrame, text: str = "text", most: int = 1 << 18, least: int = 16, folder: str | None = None) -> Lexicon:
    """A lexicon of the words that make up 1 / ``most`` of all words or more, and occur ``least`` times.

    There can be ``most`` such words at most, at any size of the table.
    """
    counts = materialize(word_counts(df, text, folder=folder).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    total = counts.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = [r["word"] for r in counts.where(F.col("word").isNotNull() & ~F.col("word").isin(*SPECIAL) & (F.col("n") * most >= total)).select("word").collect()]
    drop(counts)
    ids, ends = _merge(words, folder)
    return Lexicon.compile({w: x.tolist() for w, x in zip(words, np.split(ids, ends[:-1]))} if words else {})


def _merge(words: list[str], folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words by the tokenizer's exact merges, one after another, and where each word's end.

    The words are normalised and split, so its model is called without the rest.
    """
    key = ("merger", folder)
    if key not in _cached:
        parts = json.loads(library(NAME, folder).to_str())
        parts["normalizer"], parts["added_tokens"] = None, []
        parts["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        _cached[key] = Tokenizer.from_str(json.dumps(parts))
    ids, sizes = [], []
    for i in range(0, len(words), 4096):
        some = words[i : i + 4096]
        got = np.array(_cached[key].encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(_ends(folder)[got]) + 1
        if len(ends) != len(some):
            each = [_cached[key].encode(w, add_special_tokens=False).ids for w in some]
            got, ends = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each])
        ids.append(got), sizes.append(np.diff(ends, prepend=0))
    return (np.concatenate(ids), np.cumsum(np.concatenate(sizes))) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


_cached: dict = {}


def _ends(folder: str | None) -> np.ndarray:
    if ("ends", folder) not in _cached:
        tok = library(NAME, folder)
        _cached["ends", folder] = np.array([(tok.id_to_token(i) or "").endswith(END) for i in range(tok.get_vocab_size())])
    return _cached["ends", folder]


class Coder:
    """Encodes and decodes with a lexicon; remembers its words, and of others so many and so many bytes."""

    def __init__(self, lexicon: Lexicon, folder: str | None = None, held: int = 100_000, most: int = 16 << 20):
        self.lexicon, self.folder, self.held, self.most = lexicon, folder, held, most
        self.tok = library(NAME, folder)
        self.pieces = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())]
        self.splitter = Splitter(folder)
        self.ids: dict[str, bytes] = {w: np.array([self.tok.token_to_id(w)], "<u4").tobytes() for w in SPECIAL}
        self.decoded: dict[str, str] = {w: w for w in SPECIAL}
        self.rare: list[str] = []  # words that the lexicon lacks
        self.bytes = 0  # of those words, their ids and decoded forms

    def learn(self, words: set[str]) -> None:
        if len(self.rare) > self.held or self.bytes > self.most:
            for w in self.rare:
                del self.ids[w], self.decoded[w]
            self.rare, self.bytes = [], 0
        new = list(words - self.ids.keys())
        index = self.lexicon.find([w.encode() for w in new])
        at, flat = self.lexicon.at, self.lexicon.ids
        for i in np.flatnonzero(index >= 0):
            w, ids = new[i], flat[at[index[i]] : at[index[i] + 1]]
            self._hold(w, ids.astype("<u4").tobytes(), " ".join([self.pieces[k] for k in ids]))
        rare = [new[i] for i in np.flatnonzero(index < 0)]
        ids, ends = _merge(rare, self.folder)
        data, pieces = ids.astype("<u4").tobytes(), [self.pieces[k] for k in ids.tolist()]
        begin = 0
        for w, end in zip(rare, ends.tolist()):
            self._hold(w, data[4 * begin : 4 * end], " ".join(pieces[begin:end]))
            self.bytes += 2 * len(w) + 4 * (end - begin)
            begin = end
        self.rare += rare

    def _hold(self, word: str, ids: bytes, decoded: str) -> None:
        self.ids[word], self.decoded[word] = ids, word if decoded == word else decoded

    def code(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids, as little-endian 32-bit integers, and the decoded text."""
        parts = [self.splitter.words(t) for t in texts]
        self.learn(set().union(*parts))
        return [(b"".join(map(self.ids.__getitem__, words)), " ".join(map(self.decoded.__getitem__, words))) for words in parts]


#: What ``encode`` can add: each column with its type and its value of (ids, decoded).
OUTPUTS = {
    "n_tokens": (T.LongType(), pa.int64(), lambda i, d: len(i) // 4),
    "ids": (T.ArrayType(T.LongType()), pa.list_(pa.int64()), lambda i, d: np.frombuffer(i, "<u4").astype(np.int64)),
    "decoded": (T.StringType(), pa.string(), lambda i, d: d),
    "ids_sha256": (T.StringType(), pa.string(), lambda i, d: hashlib.sha256(i).hexdigest()),
    "decoded_sha256": (T.StringType(), pa.string(), lambda i, d: hashlib.sha256(d.encode()).hexdigest()),
}


def share(df: DataFrame, lexicon: Lexicon) -> str:
    """Send the lexicon's file to all executors; returns the name it has there."""
    sc = df.sparkSession.sparkContext
    with tempfile.TemporaryDirectory() as folder:
        file = os.path.join(os.path.realpath(folder), "lexicon")
        lexicon.save(file)
        with open(file, "rb") as f:
            name = f"tessera-{hashlib.sha256(f.read()).hexdigest()[:24]}.lexicon"
    known = _cached.setdefault(("files", sc.applicationId), {})
    if name not in known:
        known[name] = tempfile.mkdtemp(prefix="tessera-")
        file = os.path.join(os.path.realpath(known[name]), name)
        lexicon.save(file)
        sc.addFile(file)
    return name


def encode(df: DataFrame, lexicon: Lexicon, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), folder: str | None = None) -> DataFrame:
    """``df`` with the columns of OUTPUTS that are asked for; columns that had these names are replaced."""
    df = replacing(df, *outputs)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, OUTPUTS[n][0]) for n in outputs]])
    name, at = share(df, lexicon), df.columns.index(text)

    def run(batches):
        coder = Coder(Lexicon.open(SparkFiles.get(name)), folder)
        for batch in batches:
            done = [[] for _ in outputs]
            for texts in _chunks(batch.column(at)):
                for ids, decoded in coder.code(texts):
                    for column, n in zip(done, outputs):
                        column.append(OUTPUTS[n][2](ids, decoded))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, OUTPUTS[n][1]) for c, n in zip(done, outputs)]], names=schema.names)

    return df.transform(arrow_map, run, schema)


def decode(df: DataFrame, ids: str = "ids", folder: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text that the tokenizer gives for each row's ids (null: null)."""
    df = replacing(df, "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    at = df.columns.index(ids)

    def run(batches):
        tok = library(NAME, folder)
        for batch in batches:
            texts = [None if v.as_py() is None else tok.decode(v.as_py(), skip_special_tokens=False) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.transform(arrow_map, run, schema)
