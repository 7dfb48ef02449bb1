"""Registered queries of the operators in this subpackage.

``queries()`` maps names to functions of (spark, sf_dir); ``oracle_sql()`` has
the DuckDB text of those that SQL can express on whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, chat, langid, lexicon, linedrop, neardup, packing, pseudo, quality, secrets, separators
from .common import documents


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(chat.neighbouring_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op2_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    counts = [secrets.counted(base, k).alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op4_language_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), trees).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), rules=neardup.Forest(shingle=2))


def op6_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


def op7_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.robust_outliers(documents(spark, sf_dir))


def op8_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    words = lexicon.build(docs)
    return lexicon.encode(docs.select("doc_id", "text"), words, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(documents(spark, sf_dir))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo.train_and_score(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linedrop.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_preference_pairs, op2_histogram_packing, op3_secret_links, op4_language_trees, op5_minhash_forest, op6_kmeans_tree, op7_quality_outliers, op8_transducer_bpe, op9_separator_scan, op10_pseudo_likelihood, op11_filter_audit, op12_line_dedup, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_pairs": chat.ORACLE, "op5_minhash_forest": neardup.ORACLE, "op11_filter_audit": audit.ORACLE, "op12_line_dedup": linedrop.ORACLE}
