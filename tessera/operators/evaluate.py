"""Ranking quality: Hit@1, Recall@k, reciprocal rank and nDCG@k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(golden: DataFrame, returned: DataFrame, k: int = 5) -> DataFrame:
    """qid, rank (of the first relevant, 0: none), hit1, recall, rr, ndcg.

    ``golden`` has qid and expected (ids); ``returned`` qid, rank from 1 and id.
    """
    k = k if k > 0 else 5
    wanted = golden.select("qid", F.array_distinct("expected").alias("expected"))
    hits = returned.where(F.col("rank") <= k).join(wanted, "qid").where(F.array_contains("expected", F.col("id")))
    found = hits.groupBy("qid").agg(F.min("rank").alias("rank"), F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"))
    n = F.size("expected")
    ideal = F.aggregate(F.filter(F.sequence(F.lit(0), F.least(n, F.lit(k))), lambda i: i > 0), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = wanted.join(found, "qid", "left").withColumn("ideal", ideal)
    return rows.select(
        "qid", zero("rank").cast("int").alias("rank"), (zero("rank") == 1).cast("double").alias("hit1"), F.when(n > 0, zero("found") / n).otherwise(0.0).alias("recall"),
        F.when(zero("rank") > 0, 1 / F.col("rank")).otherwise(0.0).alias("rr"), F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"),
    )


def report(rows: DataFrame) -> DataFrame:
    """Means over all labelled queries; zeros when there are none."""
    mean = lambda c, n: F.coalesce(F.avg(c), F.lit(0.0)).alias(n)
    return rows.agg(F.count("*").alias("n"), mean("hit1", "hit_at_1"), mean("recall", "recall_at_k"), mean("rr", "mrr"), mean("ndcg", "ndcg_at_k"))


def scorecard(row, k: int) -> str:
    return f"n={row['n']} Hit@1={row['hit_at_1']:.3f} Recall@{k}={row['recall_at_k']:.3f} MRR={row['mrr']:.3f} nDCG@{k}={row['ndcg_at_k']:.3f}"


def misses(golden: DataFrame, rows: DataFrame, returned: DataFrame, most: int = 3) -> DataFrame:
    """Queries without a relevant result, with the first few ids they got."""
    first = returned.where(F.col("rank") <= most).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("returned"))
    none = F.array().cast("array<string>")
    return golden.join(rows.where("rank = 0").select("qid"), "qid").join(first, "qid", "left").select("qid", "query", F.coalesce("returned", none).alias("returned")).orderBy("query")
