"""Registered queries of the retrieval operators, and their DuckDB text.

The driver's tables stand for a catalogue: documents are its rows, benchmark
texts the labelled queries, embeddings the points, events the calls.  Every
query runs over its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import scoring as S
from .functions import text as X
from .operators import encode, enrich, evaluate, points, rank, resolve, retrieve, usage
from .operators.dense_index import DenseIndex
from .operators.sparse_index import SparseIndex
from .schema import CARD, normalized
from .scratch import new_path, store
from .streaming.usage import start_tally

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TOP, POOL = 10, 30
AS_OF = "2026-01-01T00:00:00Z"


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- pieces of DuckDB text

def _words(of: str, stop: list[str] | None = None) -> str:
    found = rf"list_filter(regexp_split_to_array(lower({of}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return found if stop is None else f"list_filter({found}, lambda w: NOT list_contains({_strings(stop)}, w))"


def _strings(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def _nibble(place: str) -> str:
    return f"strpos('123456789ABCDEF', substr(x, ({place})::INT, 1))"


HASHES = f"""hashed AS (
  SELECT word, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(x) // 2 + 1), lambda i: (16 * {_nibble('2 * i - 1')} + {_nibble('2 * i')})::BIGINT)),
         lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS term
  FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM every)))"""


def _counts(stop: list[str] | None = X.SPARSE_STOP) -> str:
    """CTEs d (documents) and q (benchmark): id, term, tf."""
    return f"""
  every AS (SELECT 'd' AS side, doc_id AS id, unnest({_words('text', stop)}) AS word FROM documents
            UNION ALL SELECT 'q', item_id, unnest({_words('text', stop)}) FROM benchmark),
  {HASHES},
  counted AS (SELECT side, id, term, count(*) AS tf FROM every JOIN hashed USING (word) GROUP BY ALL),
  d AS (SELECT id, term, tf FROM counted WHERE side = 'd'), q AS (SELECT id, term, tf FROM counted WHERE side = 'q')"""


TF = """
  dw AS (SELECT id, term, (1 + ln(tf)) / sqrt(sum(pow(1 + ln(tf), 2)) OVER (PARTITION BY id)) AS weight FROM d),
  qw AS (SELECT id AS qid, term, (1 + ln(tf)) / sqrt(sum(pow(1 + ln(tf), 2)) OVER (PARTITION BY id)) AS weight FROM q)"""
BM25 = """
  stats AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM (SELECT sum(tf) AS dl FROM d GROUP BY id)),
  df AS (SELECT term, count(*) AS df FROM d GROUP BY term),
  bd AS (SELECT id, term, tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS weight FROM (SELECT *, sum(tf) OVER (PARTITION BY id) AS dl FROM d), stats),
  bq AS (SELECT id AS qid, q.term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS weight FROM q JOIN df USING (term), stats)"""


def _topk(name: str, qw: str, dw: str, k: int) -> str:
    return f"""
  {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS pos FROM
      (SELECT qid, {dw}.id, sum({qw}.weight * {dw}.weight) AS score FROM {qw} JOIN {dw} USING (term) GROUP BY 1, 2)) WHERE pos < {k})"""


# ---- tables that several queries share

def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalogue rows, with ``doc_id``, ``pos`` and tools from part names of the same key."""
    d = read(spark, sf_dir, "documents")
    source = F.element_at(F.array(*map(F.lit, ("registry", "github", "file"))), (F.col("doc_id") % 3 + 1).cast("int"))
    row = d.select(
        "doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("description"), F.array(F.col("lang")).alias("categories"), source.alias("source"), F.col("n_chars").alias("popularity"),
    )
    return normalized(row, "doc_id", "pos")


def doc_counts(spark: SparkSession, sf_dir: str, stop: list[str] | None = X.SPARSE_STOP) -> DataFrame:
    return encode.term_counts(read(spark, sf_dir, "documents"), "doc_id", "text", stop)


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of all documents, stored a row for each: every weight comes from them."""
    return store(encode.bags(read(spark, sf_dir, "documents"), "doc_id", "text"), "bags")


def tf_scores(spark: SparkSession, sf_dir: str, k: int, bag: DataFrame | None = None) -> DataFrame:
    q = encode.tf_weights(read(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "qid")
    bag = encode.bags(read(spark, sf_dir, "documents"), "doc_id", "text") if bag is None else bag
    return retrieve.sparse_candidates(q, encode.tf_bags(bag, "doc_id"), k, "doc_id")


def _bm25_sides(spark, sf_dir, bag: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The terms of the benchmark texts with their weights, and the statistics of the documents."""
    stats = encode.stats_of(bag)
    return encode.bm25_query_weights(read(spark, sf_dir, "benchmark"), "item_id", "text", encode.document_frequencies(encode.counts_of(bag, "doc_id")), stats), stats


def bm25_scores(spark: SparkSession, sf_dir: str, k: int, bag: DataFrame | None = None, k1: float = encode.K1, b: float = encode.B) -> DataFrame:
    bag = _bags(spark, sf_dir) if bag is None else bag
    q, stats = _bm25_sides(spark, sf_dir, bag)
    return retrieve.sparse_candidates(q.withColumnRenamed("item_id", "qid"), encode.bm25_bags(bag, stats, "doc_id", k1, b), k, "doc_id")


# ---- text

@query(f"SELECT doc_id, len({_words('text')})::BIGINT AS n_tokens, len(list_distinct({_words('text')}))::BIGINT AS n_distinct FROM documents")
def tokenize_terms(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


@query(f"WITH every AS (SELECT unnest({_words('text')}) AS word FROM documents), {HASHES} SELECT word, term FROM hashed")
def term_hash_fnv1a(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", X.fnv1a(F.col("word")).alias("term"))


@query(f"WITH {_counts()} SELECT id AS doc_id, term, tf::BIGINT AS tf FROM d")
def doc_term_counts(spark, sf_dir):
    return doc_counts(spark, sf_dir)


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({_words('text', X.RERANK_STOP)})), ' ') AS terms FROM documents")
def distinct_term_set(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(X.term_set(F.col("text"))), " ").alias("terms"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name || '_' || p_type, '[_\\-./]+', ' ', 'g'),
  '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) AS phrase FROM part""")
def humanize_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.humanize(F.concat_ws("_", "p_name", "p_type")).alias("phrase"))


_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_FIRST = rf"CASE WHEN regexp_matches({_TRIM.format('text')}, '^[.!?\n]') THEN {_TRIM.format('text')} ELSE {_TRIM.format(rf'''regexp_extract({_TRIM.format('text')}, '^[^.!?\n]*', 0)''')} END"
_KEYS = f"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z0-9 ]+', ' ', 'g'), ' +'), lambda w: length(w) >= 4 AND NOT list_contains({_strings(X.KEYWORD_STOP)}, w))))[1:8]"


@query(f"SELECT doc_id, {_FIRST} AS sentence FROM documents")
def first_sentence(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("sentence"))


@query(f"SELECT doc_id, array_to_string({_KEYS}, ' ') AS words FROM documents")
def keywords_top8(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.keywords(F.col("text")), " ").alias("words"))


@query("SELECT c_custkey, CASE WHEN trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END) <> '' THEN c_mktsegment ELSE c_name END AS shown FROM customer")
def display_name(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("title", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", X.display_name(F.col("title"), F.col("c_name")).alias("shown"))


def _repo_sql(of: str) -> str:
    out = f"lower(trim({of}))"
    for prefix in (*X.PREFIXES, "git@"):
        out = f"regexp_replace({out}, '^{prefix.replace('+', '[+]')}', '')"
    for old, new in (("^(.*?)github[.]com:", r"\1github.com/"), ("^www[.]", ""), ("/$", ""), ("[.]git$", "")):
        out = f"regexp_replace({out}, '{old}', '{new}')"
    return out


@query(f"SELECT page_id, {_repo_sql('url')} AS address FROM pages")
def normalize_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.repository(F.col("url")).alias("address"))


_CARD = rf"""tasks AS (SELECT p_partkey AS k, lower(trim(regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) AS phrase, p_type AS about FROM part)
SELECT doc_id, CASE WHEN phrase IS NULL OR phrase = '' THEN '' ELSE phrase END AS tasks,
  array_to_string(list_filter([x FOR x IN [CASE WHEN phrase <> '' THEN 'how do I ' || phrase END, CASE WHEN phrase <> '' THEN 'I need to ' || phrase END, CASE WHEN phrase <> '' THEN about END, {_FIRST}, 'doc-' || doc_id]], lambda x: x IS NOT NULL AND x <> ''), '|') AS asked
FROM documents LEFT JOIN tasks ON k = doc_id"""


def tooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with the part of the same key as a tool, and a title."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("description"))).alias("_tools"))
    c = catalog(spark, sf_dir).join(p, "doc_id", "left").withColumn("tools", F.coalesce("_tools", "tools")).drop("_tools")
    return c.withColumn("title", F.col("name"))


@query(f"WITH {_CARD}")
def heuristic_card(spark, sf_dir):
    c = enrich.enrich(tooled(spark, sf_dir))
    return c.select("doc_id", F.array_join("enrichment.tasks", "|").alias("tasks"), F.array_join("enrichment.exampleQueries", "|").alias("asked"))


@query(f"""SELECT doc_id, array_to_string(list_filter(['doc-' || doc_id, 'doc-' || doc_id, {_TRIM.format('text')}, CASE WHEN len(k) > 0 THEN 'Related: ' || array_to_string(k, ', ') ELSE '' END,
  'Categories: ' || lang], lambda x: x <> ''), chr(10)) AS body FROM (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower('doc-' || doc_id || ' ' || text), '[^a-zA-Z0-9 ]+', ' ', 'g'), ' +'),
  lambda w: length(w) >= 4 AND NOT list_contains({_strings(X.KEYWORD_STOP)}, w))))[1:8] AS k FROM documents)""")
def embedding_text(spark, sf_dir):
    c = enrich.enrich(catalog(spark, sf_dir).withColumn("title", F.col("name")))
    return c.select("doc_id", X.embedding_text(F.col).alias("body"))


# ---- encodings

@query(f"""WITH {_counts(None)}, sums AS (SELECT id, (term % 256)::INT AS idx, sum(CASE WHEN term >= 2147483648 THEN -tf ELSE tf END)::DOUBLE AS v FROM d GROUP BY ALL)
SELECT id AS doc_id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM sums WHERE v <> 0""")
def hash_embedding_dense(spark, sf_dir):
    return encode.hash_embedding(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "idx", r6(F.col("value")).alias("value"))


@query(f"WITH {_counts()}, {TF} SELECT id AS doc_id, term, round(weight, 6) AS weight FROM dw")
def tf_sparse_encode(spark, sf_dir):
    return encode.tf_weights(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@query(f"WITH {_counts()}, {BM25} SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl FROM stats")
def bm25_corpus_stats(spark, sf_dir):
    return encode.stats_of(encode.bags(read(spark, sf_dir, "documents"), "doc_id", "text")).select("n", r6(F.col("avgdl")).alias("avgdl"))


@query(f"WITH {_counts()}, {BM25} SELECT term, df::BIGINT AS df FROM df")
def bm25_term_df(spark, sf_dir):
    return encode.document_frequencies(doc_counts(spark, sf_dir))


@query(f"WITH {_counts()}, {BM25} SELECT id AS doc_id, term, round(weight, 6) AS weight FROM bd")
def bm25_doc_weights(spark, sf_dir):
    bag = _bags(spark, sf_dir)
    found = encode.exploded(encode.bm25_bags(bag, encode.stats_of(bag), "doc_id"), "doc_id", "ts", "ws", "weight")
    return found.select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@query(f"WITH {_counts()}, {BM25} SELECT qid AS item_id, term, round(weight, 6) AS weight FROM bq")
def bm25_query_idf(spark, sf_dir):
    return _bm25_sides(spark, sf_dir, _bags(spark, sf_dir))[0].select("item_id", "term", r6(F.col("weight")).alias("weight"))


# ---- retrieval

def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "doc_id", (F.col("pos") + 1).cast("bigint").alias("rank"), r6(F.col("score")).alias("score"))


_SHOW = "SELECT qid, id AS doc_id, (pos + 1)::BIGINT AS rank, round(score, 6) AS score FROM"


@query(f"WITH {_counts()}, {TF}, {_topk('hits', 'qw', 'dw', TOP)} {_SHOW} hits")
def sparse_topk_tf(spark, sf_dir):
    return _shown(tf_scores(spark, sf_dir, TOP))


@query(f"WITH {_counts()}, {BM25}, {_topk('hits', 'bq', 'bd', TOP)} {_SHOW} hits")
def bm25_topk(spark, sf_dir):
    return _shown(bm25_scores(spark, sf_dir, TOP))


@query(f"WITH {_counts()}, {TF}, {_topk('hits', 'qw', 'dw', TOP)} {_SHOW} hits")
def sparse_index_topk_tf(spark, sf_dir):
    """The same as ``sparse_topk_tf`` from blocks of postings with upper bounds."""
    index = SparseIndex.build_rows(encode.tf_bags(encode.bags(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id"), "doc_id")
    asked = encode.tf_weights(read(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "qid")
    return _shown(index.search(asked, TOP))


@query(f"WITH {_counts()}, {BM25}, {_topk('hits', 'bq', 'bd', TOP)} {_SHOW} hits")
def bm25_index_topk(spark, sf_dir):
    """The same as ``bm25_topk`` from blocks of postings with upper bounds."""
    bag = _bags(spark, sf_dir)
    asked, stats = _bm25_sides(spark, sf_dir, bag)
    return _shown(SparseIndex.build_rows(encode.bm25_bags(bag, stats, "doc_id"), "doc_id").search(asked.withColumnRenamed("item_id", "qid"), TOP))


_FUSED = f"""{_counts()}, {TF}, {BM25}, {_topk('a', 'qw', 'dw', POOL)}, {_topk('b', 'bq', 'bd', POOL)},
  f AS (SELECT qid, id, sum(1.0::DOUBLE / (2 + pos)) AS score FROM (SELECT qid, id, pos FROM a UNION ALL SELECT qid, id, pos FROM b) GROUP BY 1, 2)"""


@query(f"WITH {_FUSED} {_SHOW} (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) - 1 AS pos FROM f) WHERE pos < {TOP}")
def rrf_fusion_topk(spark, sf_dir):
    bag = _bags(spark, sf_dir)
    fused = retrieve.fuse(tf_scores(spark, sf_dir, POOL, bag), bm25_scores(spark, sf_dir, POOL, bag), "doc_id")
    return _shown(retrieve.top(fused, "qid", F.col("score"), TOP, ["doc_id"]))


def _embeddings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    kind = F.when(F.col("vec_id") % 5 == 0, "server").when(F.col("vec_id") % 5 < 3, "tool").otherwise("query")
    p = e.select("vec_id", F.floor(F.col("vec_id") / 5).cast("bigint").alias("mcp_id"), kind.alias("kind"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("tool_name"), F.lit("").alias("source"), F.array(F.col("label").cast("string")).alias("categories"), F.col("embedding").alias("vector"))
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.lit("").alias("source"), F.array(F.col("label").cast("string")).alias("categories"))
    return q, p


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _knn(where: str, k: int) -> str:
    return f"""knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) - 1 AS pos FROM
  (SELECT a.vec_id AS qid, b.vec_id, {_DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND {where})) WHERE pos < {k})"""


@query(f"WITH {_knn('true', TOP)} SELECT qid, vec_id, (pos + 1)::BIGINT AS rank, round(score, 6) AS score FROM knn")
def dense_knn_topk(spark, sf_dir):
    q, p = _embeddings(spark, sf_dir)
    hits = retrieve.dense_candidates(q.withColumn("categories", F.array().cast("array<string>")), p, TOP, "vec_id")
    return hits.select("qid", "vec_id", (F.col("pos") + 1).cast("bigint").alias("rank"), r6(F.col("score")).alias("score"))


@query(f"WITH {_knn('a.label = b.label', TOP)} SELECT qid, vec_id, (pos + 1)::BIGINT AS rank, round(score, 6) AS score FROM knn")
def dense_knn_filtered_category(spark, sf_dir):
    q, p = _embeddings(spark, sf_dir)
    hits = retrieve.dense_candidates(q, p, TOP, "vec_id")
    return hits.select("qid", "vec_id", (F.col("pos") + 1).cast("bigint").alias("rank"), r6(F.col("score")).alias("score"))


@query(f"""WITH {_knn('true', 4 * TOP + 10)}, best AS (
  SELECT qid, vec_id // 5 AS mcp_id, arg_min(vec_id, pos) AS v, max(score) AS score, count(*) AS match_count FROM knn GROUP BY 1, 2)
SELECT qid, mcp_id, CASE WHEN v % 5 = 0 THEN 'server' WHEN v % 5 < 3 THEN 'tool' ELSE 'query' END AS match_kind, 't' || v AS matched_tool, match_count::BIGINT AS match_count, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, mcp_id) AS r FROM best) WHERE r <= {TOP}""")
def hybrid_collapse_parent(spark, sf_dir):
    q, p = _embeddings(spark, sf_dir)
    hits = retrieve.dense_candidates(q.withColumn("categories", F.array().cast("array<string>")), p, 4 * TOP + 10, "vec_id")
    return retrieve.collapse(hits, TOP).select("qid", "mcp_id", "match_kind", "matched_tool", "match_count", r6(F.col("score")).alias("score"))


@query(None)
def dense_index_topk(spark, sf_dir):
    """Every benchmark text by inverted lists over the vectors of all documents, with the recall on the half of the queries that the share of visited points was not fitted to."""
    none = F.array().cast("array<string>")
    vectors = lambda name, key: encode.embedded(encode.bags(read(spark, sf_dir, name), key, "text"), key)
    docs = vectors("documents", "doc_id").join(read(spark, sf_dir, "documents").select("doc_id", "source", F.array("lang").alias("categories")), "doc_id")
    asked = store(vectors("benchmark", "item_id").select(F.col("item_id").alias("qid"), F.col("vector").alias("qvec"), F.lit("").alias("source"), none.alias("categories")), "asked")
    index, recall = DenseIndex.build(docs, "doc_id").tune(asked, TOP)
    visited = index.probes(asked, TOP).select("qid", (F.col("visited") / float(max(1, index.sizes.sum()))).alias("visited"))
    found = index.search(asked, TOP).join(visited, "qid")
    return found.select("qid", "doc_id", (F.col("pos") + 1).cast("bigint").alias("rank"), r6(F.col("score")).alias("score"), r6(F.col("visited")).alias("visited"), F.lit(round(recall, 6)).alias("recall"))


# ---- ranking

def _reranked(spark, sf_dir) -> DataFrame:
    hits = retrieve.late(bm25_scores(spark, sf_dir, POOL), read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "doc_id")
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), X.term_set(F.col("text")).alias("_qt"))
    return rank.lexical_rerank(hits.join(q, "qid").withColumn("_ct", X.term_set(F.col("text"))), "_qt", "_ct").drop("_qt", "_ct", "text")


_RERANKED = f"""{_counts()}, {BM25}, {_topk('hits', 'bq', 'bd', POOL)},
  terms AS (SELECT doc_id AS id, list_distinct({_words('text', X.RERANK_STOP)}) AS ct, n_chars FROM documents),
  asked AS (SELECT item_id AS qid, list_distinct({_words('text', X.RERANK_STOP)}) AS qt FROM benchmark),
  shares AS (SELECT qid, id, score AS old, pos AS oldpos, n_chars, len(list_intersect(qt, ct))::DOUBLE / len(qt) AS share FROM hits JOIN terms USING (id) JOIN asked USING (qid)),
  ranked AS (SELECT qid, id, share AS score, n_chars, row_number() OVER (PARTITION BY qid ORDER BY round(share, 9) DESC, round(old, 9) DESC, oldpos) - 1 AS pos FROM shares)"""


@query(f"WITH {_RERANKED} {_SHOW} ranked")
def lexical_rerank(spark, sf_dir):
    return _shown(_reranked(spark, sf_dir))


_REL = "CASE WHEN max(score::FLOAT::DOUBLE) OVER w > min(score::FLOAT::DOUBLE) OVER w THEN (score::FLOAT::DOUBLE - min(score::FLOAT::DOUBLE) OVER w) / (max(score::FLOAT::DOUBLE) OVER w - min(score::FLOAT::DOUBLE) OVER w) ELSE 1 - pos::DOUBLE / count(*) OVER w END"


@query(f"WITH {_RERANKED} SELECT qid, id AS doc_id, round({_REL}, 6) AS relevance FROM ranked WINDOW w AS (PARTITION BY qid)")
def minmax_relevance(spark, sf_dir):
    return _reranked(spark, sf_dir).select("qid", "doc_id", r6(rank.relevance(F.col("score").cast("float").cast("double"), F.col("pos"))).alias("relevance"))


@query(f"WITH {_RERANKED} SELECT qid, id AS doc_id, round(1 - pos::DOUBLE / count(*) OVER (PARTITION BY qid), 6) AS relevance FROM ranked")
def rank_decay_fallback(spark, sf_dir):
    return _reranked(spark, sf_dir).withColumn("score", F.lit(0.5)).select("qid", "doc_id", r6(rank.relevance(F.col("score"), F.col("pos"))).alias("relevance"))


_USAGE = """calls AS (SELECT user_id, count(*) AS calls, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS successes, count(*) FILTER (event_type = 'signup') AS tool_errors FROM events WHERE user_id IS NOT NULL GROUP BY 1),
  used AS (SELECT *, CASE WHEN calls <= 0 THEN 0 ELSE (successes + 0.5::DOUBLE * tool_errors + 1) / (calls + 2) * least(1.0::DOUBLE, log10(calls + 1) / 2) END AS usage FROM calls)"""
_BLEND = f"""{_RERANKED}, {_USAGE},
  rel AS (SELECT *, {_REL} AS rel FROM ranked WINDOW w AS (PARTITION BY qid)),
  blended AS (SELECT qid, id, pos, score::FLOAT AS confidence, 0.7::DOUBLE * rel + 0.05::DOUBLE * (CASE WHEN 1 + id % 4 <= 1 THEN 0 ELSE 1 - 1.0::DOUBLE / (1 + id % 4) END) + 0.15::DOUBLE * least(1.0::DOUBLE, log10(n_chars + 1) / 4) + 0.1::DOUBLE * coalesce(usage, 0) AS final
    FROM rel LEFT JOIN used ON user_id = id),
  final AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(final, 9) DESC, pos) AS r FROM blended)"""


def _blended(spark, sf_dir) -> DataFrame:
    u = usage.with_scores(usage.tally(_calls(read(spark, sf_dir, "events")))).select(F.col("mcp_id").cast("bigint").alias("doc_id"), "usage")
    hits = _reranked(spark, sf_dir).join(u, "doc_id", "left").withColumn("usage", F.coalesce("usage", F.lit(0.0)))
    return rank.blend(hits.withColumns({"match_count": 1 + F.col("doc_id") % 4, "trust": S.popularity(F.col("n_chars"))}))


@query(f"WITH {_BLEND} SELECT qid, id AS doc_id, r::BIGINT AS rank, round(confidence::DOUBLE, 6) AS confidence, round(final::FLOAT::DOUBLE, 5) AS score FROM final")
def blend_final(spark, sf_dir):
    return _blended(spark, sf_dir).select("qid", "doc_id", (F.col("pos") + 1).cast("bigint").alias("rank"), r6(F.col("confidence").cast("double")).alias("confidence"), F.round(F.col("score").cast("double"), 5).alias("score"))


@query(f"WITH {_BLEND} SELECT qid, id AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY r)::BIGINT AS rank FROM final WHERE confidence::DOUBLE >= 0.7::DOUBLE QUALIFY rank <= {TOP}")
def min_score_cutoff(spark, sf_dir):
    return rank.cut(_blended(spark, sf_dir), F.lit(0.7), F.lit(TOP)).select("qid", "doc_id", F.col("rank").cast("bigint").alias("rank"))


# ---- evaluation

def _labelled(spark, sf_dir) -> DataFrame:
    """Benchmark texts with the documents that hold them: a stated set of queries against all rows."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = retrieve.containing(d, "doc_id", "text", b).groupBy("qid").agg(F.collect_set("doc_id").alias("expected"))
    return b.join(found, "qid", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<bigint>")))


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    golden = _labelled(spark, sf_dir)
    returned = bm25_scores(spark, sf_dir, TOP).select("qid", (F.col("pos") + 1).alias("rank"), F.col("doc_id").alias("id"))
    return golden, returned, evaluate.per_query(golden, returned, TOP)


_EVAL = f"""{_counts()}, {BM25}, {_topk('hits', 'bq', 'bd', TOP)},
  golden AS (SELECT item_id AS qid, any_value(b.text) AS query, list(doc_id) FILTER (doc_id IS NOT NULL) AS expected FROM benchmark b LEFT JOIN documents t ON contains(t.text, b.text) GROUP BY item_id),
  rel AS (SELECT h.qid, pos + 1 AS rank FROM hits h JOIN golden g ON g.qid = h.qid AND list_contains(expected, h.id)),
  found AS (SELECT qid, min(rank) AS rank, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg FROM rel GROUP BY 1),
  per AS (SELECT g.qid, query, coalesce(rank, 0) AS rank, CASE WHEN len(expected) > 0 THEN coalesce(found, 0)::DOUBLE / len(expected) ELSE 0 END AS recall,
    CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END AS rr,
    CASE WHEN len(expected) > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(len(expected), {TOP}) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg FROM golden g LEFT JOIN found USING (qid))"""


@query(f"WITH {_EVAL} SELECT qid, rank::INT AS rank, (rank = 1)::INT::DOUBLE AS hit1, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM per")
def eval_per_query(spark, sf_dir):
    rows = _judged(spark, sf_dir)[2]
    return rows.select("qid", "rank", "hit1", *[r6(F.col(c)).alias(c) for c in ("recall", "rr", "ndcg")])


@query(f"WITH {_EVAL} SELECT count(*)::BIGINT AS n, round(avg((rank = 1)::INT), 6) AS hit_at_1, round(avg(recall), 6) AS recall_at_k, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_at_k FROM per")
def eval_report(spark, sf_dir):
    out = evaluate.report(_judged(spark, sf_dir)[2])
    return out.select("n", *[r6(F.col(c)).alias(c) for c in out.columns if c != "n"])


@query(f"WITH {_EVAL} SELECT p.qid, any_value(query) AS query, coalesce(string_agg(h.id, ',' ORDER BY pos) FILTER (pos < 3), '') AS returned FROM per p LEFT JOIN hits h ON h.qid = p.qid WHERE rank = 0 GROUP BY p.qid")
def eval_misses(spark, sf_dir):
    golden, returned, rows = _judged(spark, sf_dir)
    returned = returned.withColumn("id", F.col("id").cast("string"))
    return evaluate.misses(golden, rows, returned).select("qid", "query", F.array_join("returned", ",").alias("returned"))


# ---- identity

_SOURCE = "CASE doc_id % 3 WHEN 0 THEN 'registry' WHEN 1 THEN 'github' ELSE 'file' END"
_PRIO = "CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END"


def _named_by_text(spark, sf_dir) -> DataFrame:
    """The catalogue with each text as its own name: copies are one identity."""
    return catalog(spark, sf_dir).withColumn("name", F.col("description")).withColumn("title", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), F.col("id"))).otherwise(F.lit("")))


@query(f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'name:' || lower('Page ' || page_id) WHEN page_id % 3 = 1 AND {_repo_sql('url')} <> '' THEN 'repo:' || {_repo_sql('url')} ELSE 'id:p' || page_id END AS key FROM pages""")
def identity_key(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" Page "), F.col("page_id").cast("string"))).otherwise("")
    repo = F.when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("")
    return p.select("page_id", resolve.identity_key(name, repo, F.concat(F.lit("P"), F.col("page_id").cast("string"))).alias("key"))


@query(f"""WITH g AS (SELECT *, lower({_TRIM.format('text')}) AS key, {_PRIO} AS prio FROM documents WHERE {_TRIM.format('text')} <> '')
SELECT arg_max(doc_id, (prio, -doc_id))::VARCHAR AS id, coalesce(arg_max('T' || doc_id, (prio, -doc_id)) FILTER (doc_id % 2 = 0), '') AS title, max(n_chars)::BIGINT AS popularity, count(*)::BIGINT AS members FROM g GROUP BY key""")
def dedup_merge_scalars(spark, sf_dir):
    rows = _named_by_text(spark, sf_dir).where(~X.blank(F.col("name"))).withColumn("key", resolve.identity_key(F.col("name"), F.col("repository"), F.col("id")))
    n = rows.groupBy("key").agg(F.count("*").alias("members"))
    return resolve.merge_groups(rows).join(n, "key").select("id", "title", "popularity", "members")


@query(f"""WITH g AS (SELECT *, lower({_TRIM.format('text')}) AS key, {_PRIO} AS prio, {_SOURCE} AS src FROM documents WHERE {_TRIM.format('text')} <> ''),
l AS (SELECT key, arg_max(doc_id, (prio, -doc_id))::VARCHAR AS id, list(lang ORDER BY prio DESC, doc_id) AS langs, list(src ORDER BY prio DESC, doc_id) AS srcs, count(*) AS n FROM g GROUP BY key)
SELECT id, array_to_string(list_filter(langs, lambda x, i: list_position(langs, x) = i), ',') AS categories, CASE WHEN n > 1 THEN array_to_string(list_filter(srcs, lambda x, i: list_position(srcs, x) = i), ',') ELSE '' END AS sources FROM l""")
def dedup_union_lists(spark, sf_dir):
    rows = _named_by_text(spark, sf_dir).where(~X.blank(F.col("name")))
    return resolve.dedup(rows).select("id", F.array_join("categories", ",").alias("categories"), F.array_join("sources", ",").alias("sources"))


@query(f"SELECT source, prio::INT AS priority, count(*)::BIGINT AS n FROM (SELECT {_SOURCE} AS source, {_PRIO} AS prio FROM documents) GROUP BY ALL")
def source_priority(spark, sf_dir):
    return catalog(spark, sf_dir).groupBy("source", X.source_priority(F.col("source")).alias("priority")).agg(F.count("*").alias("n"))


# ---- quality priors and usage

@query("SELECT doc_id, round(CASE WHEN n_chars <= 0 THEN 0 ELSE least(1.0::DOUBLE, log10(n_chars + 1) / 4) END, 6) AS score FROM documents")
def trust_popularity(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", r6(S.popularity(F.col("n_chars"))).alias("score"))


_DAYS = "(epoch_us(TIMESTAMP '1998-08-02 00:00:00') - epoch_us(o_orderdate)) / 86400e6"


@query(f"SELECT o_orderkey, round(CASE WHEN o_orderkey % 7 = 0 THEN 0.5 WHEN {_DAYS} <= 90 THEN 1 WHEN {_DAYS} >= 730 THEN 0 ELSE 1 - ({_DAYS} - 90) / 640 END, 9)::DOUBLE AS score FROM orders")
def trust_recency(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stamp = F.when(F.col("o_orderkey") % 7 == 0, day).otherwise(F.concat(day, F.lit("T"), F.date_format("o_orderdate", "HH:mm:ss"), F.lit("Z")))
    return o.select("o_orderkey", F.round(S.recency(stamp, F.to_timestamp(F.lit("1998-08-02T00:00:00Z"))), 9).alias("score"))


@query("SELECT doc_id, ((text <> '')::INT + (p_partkey IS NOT NULL)::INT + 1) / 4.0::DOUBLE AS score FROM documents LEFT JOIN part ON p_partkey = doc_id")
def trust_completeness(spark, sf_dir):
    return tooled(spark, sf_dir).select("doc_id", S.completeness(F.col).alias("score"))


@query("SELECT doc_id, round(0.4::DOUBLE * (CASE WHEN n_chars <= 0 THEN 0 ELSE least(1.0::DOUBLE, log10(n_chars + 1) / 4) END) + 0.15::DOUBLE + 0.3::DOUBLE * ((text <> '')::INT + (p_partkey IS NOT NULL)::INT + 1) / 4, 6) AS trust FROM documents LEFT JOIN part ON p_partkey = doc_id")
def trust_score(spark, sf_dir):
    return enrich.score_trust(tooled(spark, sf_dir), AS_OF).select("doc_id", r6(F.col("trust")).alias("trust"))


def _calls(events: DataFrame) -> DataFrame:
    failed = F.when(F.col("event_type") == "error", "connection refused")
    return events.select(F.col("user_id").cast("string").alias("mcp_id"), S.outcome(F.col("event_type") == "signup", failed).alias("outcome"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'unreachable' WHEN 'signup' THEN 'tool_error' ELSE 'success' END AS outcome FROM events")
def outcome_classify(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", S.outcome(F.col("event_type") == "signup", F.when(F.col("event_type") == "error", "x")).alias("outcome"))


_TALLY = f"WITH {_USAGE} SELECT user_id::VARCHAR AS mcp_id, calls::BIGINT AS calls, successes::BIGINT AS successes, tool_errors::BIGINT AS tool_errors FROM calls"


@query(_TALLY)
def usage_tally(spark, sf_dir):
    return usage.tally(_calls(read(spark, sf_dir, "events")))


@query(f"WITH {_USAGE} SELECT user_id::VARCHAR AS mcp_id, round(usage, 6) AS usage FROM used")
def usage_score(spark, sf_dir):
    return usage.with_scores(usage_tally(spark, sf_dir)).select("mcp_id", r6(F.col("usage")).alias("usage"))


@query(_TALLY)
def usage_stream_tally(spark, sf_dir):
    schema = T.StructType(read(spark, sf_dir, "events").schema.fields)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"usage_{uuid.uuid4().hex}"
    start_tally(_calls(events), new_path(spark, name), name, once=True).awaitTermination()
    return spark.table(name)


# ---- the point table

@query("SELECT DISTINCT lang AS category FROM documents WHERE lang <> ''")
def category_facet(spark, sf_dir):
    return points.category_facet(catalog(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND lang IN ('de', 'fr')")
def filter_source_and_category(spark, sf_dir):
    ok = retrieve.passes(F.lit("registry"), F.array(F.lit("de"), F.lit("fr")), F.col("source"), F.col("categories"))
    return catalog(spark, sf_dir).where(ok).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def prune_anti_join(spark, sf_dir):
    gone = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("mcp_id"))
    return points.delete_by_parent(read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "mcp_id"), gone).select("o_orderkey")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_last_write_wins(spark, sf_dir):
    return points.last_write_wins(read(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


_NS = f"from_hex('{points.URL_NAMESPACE}')"
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"SELECT p_partkey, {_UUID} AS point_id FROM (SELECT p_partkey, sha1({_NS} || encode(p_name || '|tool|' || p_type)) AS h FROM part)")
def point_uuid5(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", points.point_id(F.col("p_name"), F.lit("tool"), F.col("p_type")).alias("point_id"))


_ASKED = f"""[CASE WHEN phrase <> '' THEN 'how do I ' || phrase END, CASE WHEN phrase <> '' THEN 'I need to ' || phrase END, CASE WHEN phrase <> '' THEN about END, {_FIRST}, 'doc-' || doc_id]"""


@query(f"""WITH {_CARD.partition('SELECT doc_id')[0]}, c AS (SELECT doc_id, p_name, list_filter({_ASKED}, lambda x: x IS NOT NULL AND x <> '') AS asked FROM documents LEFT JOIN tasks ON k = doc_id LEFT JOIN part ON p_partkey = doc_id),
made AS (SELECT doc_id, 'server' AS kind, '' AS tool_name, '' AS query, 0 AS ordinal FROM c
  UNION ALL SELECT doc_id, 'tool', p_name, '', 1 FROM c WHERE p_name IS NOT NULL
  UNION ALL SELECT doc_id, 'query', '', unnest(asked), unnest(range(0, len(asked))) + CASE WHEN p_name IS NULL THEN 1 ELSE 2 END FROM c)
SELECT {_UUID} AS point_id, doc_id::VARCHAR AS mcp_id, kind, tool_name, query, ordinal::BIGINT AS ordinal FROM (SELECT *, sha1({_NS} || encode(doc_id || '|' || kind || '|' || tool_name || query)) AS h FROM made)""")
def explode_points(spark, sf_dir):
    """Server, tool and query points of the whole catalogue."""
    made = points.build_points(enrich.enrich(tooled(spark, sf_dir)))
    return made.select("point_id", "mcp_id", "kind", "tool_name", "query", F.col("ordinal").cast("bigint").alias("ordinal"))


# ---- parsing of model answers

@query(r"SELECT event_id, 'k ' || (regexp_extract(props, '\{.*\}', 0) ->> '$.k') AS summary, 'a,b' AS tasks, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS synonyms FROM events WHERE event_id % 5 > 0 UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_id % 5 = 0")
def parse_card_json(spark, sf_dir):
    """A model's card out of its answer, with or without fences; an answer that has none gives null."""
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    synonyms = F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(', "synonyms": ["'), F.col("event_type"), F.lit('"]')))
    body = F.concat(F.lit('{"summary": "k '), F.get_json_object("props", "$.k"), F.lit('", "tasks": ["a", "b"], "unknown": {"x": 1}'), synonyms, F.lit("}"))
    raw = F.when(i % 5 == 0, "I cannot say.").when(i % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(body)
    card = F.from_json(S.json_object(raw), CARD)
    return e.select("event_id", card["summary"].alias("summary"), F.array_join(card["tasks"], ",").alias("tasks"), F.array_join(card["synonyms"], ",").alias("synonyms"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 9 + 1 > 5 AND turn + 1 > 5 THEN NULL WHEN conv_id % 9 + 1 > 5 OR conv_id % 9 = turn THEN least(turn + 1, CASE WHEN conv_id % 9 + 1 > 5 THEN turn + 1 ELSE conv_id % 9 + 1 END)::VARCHAR
  WHEN turn + 1 > 5 THEN (conv_id % 9 + 1)::VARCHAR ELSE (conv_id % 9 + 1) || ',' || (turn + 1) END AS places FROM conversations""")
def parse_rank_order(spark, sf_dir):
    """Distinct places within five of a model's order; null if none is valid."""
    raw = F.concat(F.lit("Order: ["), (F.col("conv_id") % 9 + 1).cast("string"), F.lit(", "), (F.col("turn") + 1).cast("string"), F.lit(", 99, 0] done"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(S.rank_order(raw, F.lit(5)).cast("array<string>"), ",").alias("places"))
