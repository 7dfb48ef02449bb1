"""Second-stage ranking: reranking, relevance, blending, cut-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scoring as S


def lexical_rerank(hits: DataFrame, q_terms: str, c_terms: str) -> DataFrame:
    """Score becomes the share of the query's terms that a candidate has; a query without terms changes nothing.

    New places ``pos`` go by that share, then by the score before, then by the place before.
    """
    n = F.size(q_terms)
    share = F.when(n > 0, F.size(F.array_intersect(q_terms, c_terms)) / n)
    w = W.partitionBy("qid").orderBy(F.round("_s", 9).desc_nulls_last(), F.when(n > 0, F.round("score", 9)).desc_nulls_last(), "pos")
    moved = hits.withColumn("_s", share).withColumn("_p", F.row_number().over(w) - 1)
    return moved.withColumn("score", F.coalesce("_s", "score")).withColumn("pos", F.col("_p")).drop("_s", "_p")


def relevance(score: Column, pos: Column) -> Column:
    """Min-max over the query's pool; where all are equal, 1 - pos / n."""
    w = W.partitionBy("qid")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(1 - pos / F.count("*").over(w))


def blend(hits: DataFrame, trust_weight: float = 0.15, usage_weight: float = 0.10, coverage_weight: float = 0.05) -> DataFrame:
    """Adds ``confidence`` (the score before, in [0, 1], single precision) and makes ``score`` the weighted blend.

    ``hits`` has qid, pos, score, match_count, trust and usage.
    """
    wt, wu, wc = S.clamp_weights(trust_weight, usage_weight, coverage_weight)
    final = (1 - wt - wu - wc) * F.col("_rel") + wc * S.coverage(F.col("match_count")) + wt * S.clamp01(F.col("trust")) + wu * F.col("usage")
    out = hits.withColumn("_rel", relevance(F.col("score").cast("float").cast("double"), F.col("pos")))
    out = out.withColumns({"confidence": S.clamp01(F.col("score")).cast("float"), "_final": final})
    w = W.partitionBy("qid").orderBy(F.round("_final", 9).desc(), "pos")
    return out.withColumn("pos", F.row_number().over(w) - 1).withColumn("score", F.col("_final").cast("float")).drop("_rel", "_final")


def cut(hits: DataFrame, min_score: Column, top_k: Column) -> DataFrame:
    """Drops hits below the confidence asked for, then keeps ``top_k``; adds ``rank`` from 1."""
    kept = hits.where((min_score <= 0) | (F.col("confidence").cast("double") >= min_score))
    w = W.partitionBy("qid").orderBy("pos")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
