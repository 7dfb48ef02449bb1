"""Dense and sparse encodings of texts.

The terms of a text are one row, a bag: norms, lengths and weights come from the
row itself, so only what goes over texts (frequencies, statistics) is shuffled.
The long form, a row for each term, is that row exploded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import scoring as S
from ..functions import text as X
from ..scratch import ship

K1, B, DIM = 1.2, 0.75, 256
#: Words that a task counts at once, but for a text that has more.
AT_ONCE = 1 << 18


def word_counts(df: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """key, word, term, n: how often each text has each token, with the token's hash.

    A text is counted within its own row, and a batch of rows hashes each of its
    distinct words once; what is dealt out by key is counts, not texts.  Texts that
    share a key give rows of their own each.
    """
    ship(df.sparkSession)
    keys = [key] if isinstance(key, str) else key
    rows = df.select(*keys, X.tokens(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    schema = T.StructType([*rows.drop("_words").schema, T.StructField("word", T.StringType()), T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])
    return rows.mapInArrow(_counted(schema.names), schema).repartition(*keys)


def _parts(batches):
    """The rows of the batches in parts of bounded words: all columns, the lists of words, and the row of each word."""
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column(batch.num_columns - 1).offsets.to_numpy()), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, side="right")))
            part = batch.slice(start, stop - start)
            words = part.column(part.num_columns - 1)
            yield part, words, np.repeat(np.arange(part.num_rows, dtype=np.int64), np.diff(words.offsets.to_numpy()))
            start = stop
            del part, words
        del batch  # before the next one is read


def _counted(names: list[str]):
    def run(batches):
        for part, words, row in _parts(batches):
            coded = words.flatten().dictionary_encode()
            size = len(coded.dictionary)
            pairs, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
            of, code = pa.array(pairs // size), pairs % size
            yield pa.RecordBatch.from_arrays([*[c.take(of) for c in part.columns[:-1]], coded.dictionary.take(pa.array(code)), pa.array(hashes(coded.dictionary)[code]), pa.array(n.astype(np.int64))], names=names)

    return run


BAG = ("ts", "tf", "stop_ts", "stop_tf")
_BAG_FIELDS = [T.StructField(n, T.ArrayType(T.LongType())) for n in BAG]


def bags(df: DataFrame, key: str | list[str], text: str, stop: list[str] | None = X.SPARSE_STOP) -> DataFrame:
    """key, ts, tf, stop_ts, stop_tf: one row for each key with tokens, its hashed terms in order and how often it has each.

    Stop words are counted apart, since their hashes may be those of other words.
    Texts are counted within their own rows and nothing is shuffled; only where
    several texts share a key are their counts added up.
    """
    ship(df.sparkSession)
    keys = [key] if isinstance(key, str) else key
    rows = df.select(*keys, X.tokens(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    schema = T.StructType([*rows.drop("_words").schema, *_BAG_FIELDS])
    found = rows.mapInArrow(_bagged(schema.names, stop or []), schema)
    return found if df.groupBy(*keys).count().where("count > 1").isEmpty() else _merged(found, keys)


def with_bags(df: DataFrame, text: str, stop: list[str] | None = X.SPARSE_STOP, dim: int | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the bag of each row's text beside its other columns, and with ``dim`` its ``vector``; nothing is shuffled.

    A row without tokens has empty lists and a vector of zeros.  Columns ``without`` are left out, before the rows go to Python.
    """
    ship(df.sparkSession)
    rows = df.withColumn("_words", F.coalesce(X.tokens(F.col(text)), F.array().cast("array<string>"))).drop(*without)
    schema = T.StructType([*df.drop(*without).schema, *_BAG_FIELDS])
    count = _bagged(schema.names, stop or [])
    if dim is None:
        return rows.mapInArrow(count, schema)
    wide = T.StructType([*schema, T.StructField("vector", T.ArrayType(T.FloatType()))])
    embed = _vectored(wide.names, dim, schema.names.index("ts"))
    return rows.mapInArrow(lambda batches: embed(count(batches)), wide)


def _bagged(names: list[str], stop: list[str]):
    def run(batches):
        for part, words, row in _parts(batches):
            coded = words.flatten().dictionary_encode()
            stops = pc.is_in(coded.dictionary, value_set=pa.array(stop, coded.dictionary.type)).to_numpy(zero_copy_only=False)
            both, own = np.unique(hashes(coded.dictionary) * 2 + stops, return_inverse=True)
            pairs, n = np.unique(row * len(both) + own[coded.indices.to_numpy()], return_counts=True)
            of, code = np.divmod(pairs, max(1, len(both)))
            out = list(part.columns[:-1])
            for kind in (0, 1):
                mine = both[code] & 1 == kind
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[mine], minlength=part.num_rows))]).astype(np.int32))
                out += [pa.ListArray.from_arrays(offsets, pa.array(v[mine].astype(np.int64))) for v in (both[code] >> 1, n)]
            yield pa.RecordBatch.from_arrays(out, names=names)
            del part, words, row, coded, out  # before more are read

    return run


def _merged(found: DataFrame, keys: list[str]) -> DataFrame:
    """One bag for each key: the counts of its bags added up."""
    entries = lambda kind, at: F.transform(F.arrays_zip(F.col(kind + "ts").alias("t"), F.col(kind + "tf").alias("n")), lambda e: F.struct(e["t"].alias("t"), e["n"].alias("n"), F.lit(at).alias("stop")))
    long = found.repartition(*keys).select(*keys, F.explode(F.concat(entries("", False), entries("stop_", True))).alias("_e"))
    sums = long.groupBy(*keys, F.col("_e.t").alias("_t"), F.col("_e.stop").alias("_s")).agg(F.sum("_e.n").alias("_n"))
    one = lambda own: F.sort_array(F.collect_list(F.when(own, F.struct("_t", "_n"))))
    both = sums.groupBy(*keys).agg(one(~F.col("_s")).alias("_own"), one(F.col("_s")).alias("_stop"))
    return both.select(*keys, F.col("_own._t").alias("ts"), F.col("_own._n").alias("tf"), F.col("_stop._t").alias("stop_ts"), F.col("_stop._n").alias("stop_tf"))


def _once(value: Column, make) -> Column:
    """``make(value)``, where ``value`` is not made again for each item of a list."""
    return F.element_at(F.transform(F.array(value), make), 1)


def exploded(rows: DataFrame, key: str, items: str, values: str, name: str) -> DataFrame:
    """key, term and ``name`` from lists of terms and their values."""
    return rows.select(key, F.explode(F.arrays_zip(F.col(items).alias("t"), F.col(values).alias("v"))).alias("_e")).select(key, F.col("_e.t").alias("term"), F.col("_e.v").alias(name))


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """key, ts, ws from weights in long form (key, term, weight)."""
    found = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("_e"))
    return found.select(key, F.col("_e.term").alias("ts"), F.col("_e.weight").alias("ws"))


def counts_of(bag: DataFrame, key: str) -> DataFrame:
    """key, term, tf of bags, without stop words."""
    return exploded(bag, key, "ts", "tf", "tf")


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda total, n: total + n)


def stats_of(bag: DataFrame) -> DataFrame:
    """``corpus_stats`` from bags."""
    per = bag.where(F.size("ts") > 0).select(_total(F.col("tf")).alias("dl"))
    return per.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"))


def tf_bags(bag: DataFrame, key: str | list[str]) -> DataFrame:
    """key, ts, ws: the weights of ``tf_weights``, a row for each text with terms."""
    logs = F.transform("tf", lambda n: 1 + F.ln(n))
    norm = F.sqrt(F.aggregate(logs, F.lit(0.0), lambda total, w: total + w * w))
    return bag.where(F.size("ts") > 0).select(*([key] if isinstance(key, str) else key), "ts", _once(norm, lambda n: F.transform("tf", lambda c: (1 + F.ln(c)) / n)).alias("ws"))


def bm25_bags(bag: DataFrame, stats: DataFrame, key: str | list[str], k1: float = K1, b: float = B) -> DataFrame:
    """key, ts, ws: the weights of ``bm25_document_weights``, a row for each text with terms."""
    k1, b = (k1 if k1 > 0 else K1), (b if 0 <= b <= 1 else B)
    rows = bag.where(F.size("ts") > 0).crossJoin(F.broadcast(stats.select("avgdl")))  # one row
    dl = _total(F.col("tf"))
    length = F.when(F.col("avgdl") > 0, dl / F.col("avgdl")).otherwise(F.lit(1.0))
    return rows.select(*([key] if isinstance(key, str) else key), "ts", _once(k1 * (1 - b + b * length), lambda w: F.transform("tf", lambda c: c * (k1 + 1) / (c + w))).alias("ws"))


def embedded(bag: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """key, vector: ``hash_embedding`` of bags as arrays of floats, made within their rows."""
    ship(bag.sparkSession)
    schema = T.StructType([bag.schema[key], T.StructField("vector", T.ArrayType(T.FloatType()))])
    embed = _vectored([key, *BAG, "vector"], dim, 1)
    return bag.select(key, *BAG).mapInArrow(lambda batches: (b.select(schema.names) for b in embed(batches)), schema)


def _vectored(names: list[str], dim: int, first: int):
    """Each batch, in parts, with the vectors of its bags, which are the four columns from ``first`` on."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, step := max(1, AT_ONCE // dim)):
                part = batch.slice(start, step)
                sums = np.zeros(part.num_rows * dim)
                for at in (first, first + 2):
                    terms, n = part.column(at).flatten().to_numpy(), part.column(at + 1).flatten().to_numpy()
                    row = np.repeat(np.arange(part.num_rows), np.diff(part.column(at).offsets.to_numpy()))
                    sums += np.bincount(row * dim + terms % dim, np.where(terms >= X.FNV_SIZE // 2, -n, n), minlength=len(sums))
                vectors = sums.reshape(-1, dim)
                norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                flat = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0).astype(np.float32).ravel()
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(flat))], names=names)

    return run


def hashes(words: pa.Array) -> np.ndarray:
    """``text.fnv1a`` of every word, byte by byte of all words at once."""
    raw = words.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, longest = offsets[:-1][order], size[order]
    found = np.full(len(raw), X.FNV_START, np.uint64)
    for at in range(int(longest[0]) if len(raw) else 0):
        m = np.searchsorted(-longest, -at)  # words with a byte here come first
        found[:m] = ((found[:m] ^ data[start[:m] + at]) * np.uint64(X.FNV_PRIME)) & np.uint64(X.FNV_SIZE - 1)
    out = np.empty(len(raw), np.int64)
    out[order] = found.astype(np.int64)
    return out


def terms_of(words: DataFrame, key: str, stop: list[str] | None = X.SPARSE_STOP) -> DataFrame:
    """key, term, tf from ``word_counts``, without stop words."""
    rows = words.where(~F.col("word").isin(*stop)) if stop else words
    return rows.groupBy(key, "term").agg(F.sum("n").alias("tf"))


def term_counts(df: DataFrame, key: str, text: str, stop: list[str] | None = X.SPARSE_STOP) -> DataFrame:
    """key, term, tf: counts of hashed terms in each text."""
    return counts_of(bags(df, key, text, stop), key)


def _unit(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    norm = F.sqrt(F.sum(value * value).over(W.partitionBy(key)))
    return rows.withColumn(name, value / norm)


def hash_embedding(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """key, idx, value: signed hashing of all tokens into ``dim`` places, of unit length.

    Places whose counts cancel are left out; so are texts without tokens.
    """
    return hash_embedding_of(term_counts(df, key, text, None), key, dim)


def hash_embedding_of(counts: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """The same from counts of all terms."""
    sign = F.when(F.col("term") >= X.FNV_SIZE // 2, -F.col("tf")).otherwise(F.col("tf"))
    sums = counts.groupBy(key, (F.col("term") % dim).cast("int").alias("idx")).agg(F.sum(sign).cast("double").alias("v"))
    return _unit(sums.where("v <> 0"), key, F.col("v"), "value").select(key, "idx", "value")


def dense_vectors(long: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """key, vector: the long form as arrays of floats, made of the values in their order and the zeros between them."""
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    entries = long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", F.col("value").cast("float").alias("value")))).alias("e"))
    before = lambda i: F.coalesce(F.get("e", i - 1)["idx"], F.lit(-1))
    parts = F.transform("e", lambda x, i: F.concat(zeros(x["idx"] - before(i) - 1), F.array(x["value"])))
    return entries.select(key, F.concat(F.flatten(parts), zeros(F.lit(dim - 1) - F.element_at("e", -1)["idx"])).alias("vector"))


def tf_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, weight: 1 + ln(tf) of terms that are no stop words, of unit length."""
    return exploded(tf_bags(bags(df, key, text), key), key, "ts", "ws", "weight")


def tf_weights_of(counts: DataFrame, key: str) -> DataFrame:
    """The same from counts of terms in long form."""
    rows = counts.withColumn("w", 1 + F.ln("tf"))
    return _unit(rows, key, F.col("w"), "weight").select(key, "term", "weight")


def corpus_stats(counts: DataFrame, key: str) -> DataFrame:
    """One row: n texts with terms, and their mean length avgdl."""
    per = counts.groupBy(key).agg(F.sum("tf").alias("dl"))
    return per.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def bm25_document_weights(counts: DataFrame, stats: DataFrame, key: str, k1: float = K1, b: float = B) -> DataFrame:
    """key, term, weight of the document side; the query side carries the idf."""
    k1, b = (k1 if k1 > 0 else K1), (b if 0 <= b <= 1 else B)
    rows = counts.withColumn("dl", F.sum("tf").over(W.partitionBy(key))).crossJoin(F.broadcast(stats.select("avgdl")))  # one row
    length = F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.col("dl"))
    return rows.select(key, "term", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length))).alias("weight"))


def bm25_query_weights(queries: DataFrame, key: str, text: str, frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """key, term, weight: the idf of each distinct term that the corpus has."""
    return bm25_query_weights_of(bags(queries, key, text), key, frequencies, stats)


def bm25_query_weights_of(bag: DataFrame, key: str, frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """The same from bags."""
    terms = counts_of(bag, key).select(key, "term")
    rows = terms.join(frequencies, "term").crossJoin(F.broadcast(stats.select("n")))  # one row
    return rows.select(key, "term", S.idf(F.col("n"), F.col("df")).alias("weight"))


def save_stats(counts: DataFrame, key: str, path: str) -> None:
    """Corpus statistics as two Parquet tables."""
    corpus_stats(counts, key).write.mode("overwrite").parquet(f"{path}/stats")
    document_frequencies(counts).write.mode("overwrite").parquet(f"{path}/df")


def load_stats(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/df")


def chosen(sparse: str, stats: DataFrame | None) -> str:
    """The sparse encoder that can be used: BM25 without statistics of any text falls back to term frequencies."""
    if sparse == "bm25" and (stats is None or not (stats.select("n").first() or [0])[0]):
        return "tf"
    return sparse
