"""Searches: a batch of queries through retrieval, fusion, reranking and blending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import remote
from ..functions import text as X
from ..operators import encode, points, rank, retrieve
from ..scratch import store
from .config import Config
from .index import Index
from .strategies import Clients


def candidates(queries: DataFrame, index: Index, config: Config = Config(), embed=None) -> DataFrame:
    """The pool of each query: the best parents, with what matched.

    A query without terms of its own, or with hybrid search off, ranks by
    cosine alone; the others by reciprocal rank fusion of both retrievals.
    Filters hold inside both.  With ``retrieval`` "index" the nearest come from inverted lists,
    approximately, and the sparse side, exactly, from blocks of postings.  Queries and their terms are stored
    first: each of the joins below would encode them anew, in a plan that the driver holds many times.
    """
    q = store(queries.withColumn("_pool", F.greatest(F.when(F.col("top_k") > 0, F.col("top_k")).otherwise(5), F.lit(config.rerank_pool))), "asked")
    bag = store(encode.bags(q.select("qid", "query"), "qid", "query"), "asked-terms")
    limits = q.select("qid", "_pool", (4 * F.col("_pool") + 10).alias("_outer"), (8 * F.col("_pool") + 20).alias("_inner"))
    if config.embedder == "openai" and embed:
        vectors = points.ensure_dimension(store(remote.embed_texts(q, "qid", "query", embed), "query-vectors"), "vector", index.dim)
    else:
        vectors = encode.embedded(bag, "qid", index.dim)
    zero = F.array_repeat(F.lit(0.0).cast("float"), index.dim)
    if encode.chosen(config.sparse, index.stats) == "bm25":
        terms = encode.bm25_query_weights_of(bag, "qid", index.frequencies, index.stats)
    else:
        terms = encode.exploded(encode.tf_bags(bag, "qid"), "qid", "ts", "ws", "weight")
    terms = store(terms if config.hybrid else terms.limit(0), "asked-weights")
    hybrid = terms.select("qid").distinct().withColumn("_h", F.lit(True))
    q = q.join(vectors.withColumnRenamed("vector", "qvec"), "qid", "left").withColumn("qvec", F.coalesce("qvec", zero))
    order = ["mcp_id", "ordinal"]
    inner, indexed = 8 * _most(config, q) + 20, config.retrieval == "index" and index.lists is not None and index.blocks is not None
    light, own = index.points.select(*index.LIGHT), ("mcp_id", "kind", "tool_name", "ordinal")
    dense = store(index.lists.search(q, inner, order) if indexed else retrieve.dense_candidates(q, light, inner, "point_id", order), "nearest")
    dense = dense.join(limits, "qid").join(hybrid, "qid", "left").withColumn("_h", F.coalesce("_h", F.lit(False)))
    alone = dense.where(~F.col("_h") & (F.col("pos") < F.col("_outer"))).select("qid", "point_id", *own, "score", "pos")
    first = dense.where(F.col("_h") & (F.col("pos") < F.col("_inner"))).select("qid", "point_id", *own, "pos")
    if indexed:
        sparse = index.blocks.beside(light.drop("vector")).search(terms, inner, ties=order, filters=q)
    else:
        scored = index.scored()
        if index.scanned is None and q.count() > retrieve.block_size(inner):  # a join, which each block would make again
            scored = store(scored, "scored")
        sparse = retrieve.sparse_candidates(terms, scored, inner, "point_id", order, q)
    sparse = sparse.select("qid", "point_id", *own, "score").join(limits, "qid")
    second = retrieve.top(sparse, "qid", F.col("score"), F.col("_inner"), order).select("qid", "point_id", *own, "pos")
    fused = retrieve.fuse(first, second, "point_id", config.rrf_k, own).join(limits, "qid")
    hits = alone.unionByName(retrieve.top(fused, "qid", F.col("score"), F.col("_outer"), order).select("qid", "point_id", *own, "score", "pos"))
    pool = retrieve.collapse(hits, F.lit(2**31 - 1)).join(limits.select("qid", "_pool"), "qid")
    return pool.where(F.col("pos") < F.col("_pool")).drop("_pool")


def _most(config: Config, queries: DataFrame) -> int:
    top = queries.agg(F.coalesce(F.max("top_k"), F.lit(5))).first()[0]
    return max(config.rerank_pool, top, 5)


def _lexical(hits: DataFrame, queries: DataFrame) -> DataFrame:
    terms = queries.select("qid", X.term_set(F.col("query")).alias("_qt"))
    return rank.lexical_rerank(hits.join(terms, "qid").withColumn("_ct", X.term_set(X.candidate_text(F.col))), "_qt", "_ct").drop("_qt", "_ct")


def search(queries: DataFrame, index: Index, config: Config = Config(), usage: DataFrame | None = None, clients: Clients = Clients()) -> DataFrame:
    """qid, rank, id, score, confidence, match_kind, matched_tool, match_count and the row itself, for each query."""
    pool = candidates(queries, index, config, clients.embed)
    # late: the full rows of the pool alone
    hits = retrieve.late(pool, index.plain.withColumnRenamed("id", "mcp_id"), "mcp_id", described=lambda rows: index.described(rows.withColumnRenamed("mcp_id", "id")).drop("pos").withColumnRenamed("id", "mcp_id"))
    if config.reranker == "llm" and clients.chat:
        hits = remote.model_rerank_all(store(hits, "pool"), queries, clients.chat, lambda h: _lexical(h, queries))
    elif config.reranker != "none":
        hits = _lexical(hits, queries)
    if usage is not None:
        hits = hits.join(usage.select("mcp_id", "usage"), "mcp_id", "left")
    hits = hits.withColumn("usage", F.coalesce("usage", F.lit(0.0)) if usage is not None else F.lit(0.0))
    hits = rank.blend(hits, config.trust_weight, config.usage_weight, config.coverage_weight)
    asked = queries.select("qid", F.coalesce("min_score", F.lit(0.0)).alias("_min"), F.when(F.col("top_k") > 0, F.col("top_k")).otherwise(5).alias("_k"))
    out = rank.cut(hits.join(asked, "qid"), F.col("_min"), F.col("_k"))
    return out.drop("_min", "_k", "pos", "usage").withColumnRenamed("mcp_id", "id")
