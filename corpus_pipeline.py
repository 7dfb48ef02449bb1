"""A corpus pipeline: quality rules, language, near-duplicates, secrets, packing.

Each stage reads what the one before it kept.  A stage's table is Parquet in
the folder that ``spark.checkpoint.dir`` names.

Defined results for odd input: null, empty and blank texts go with the first
stage, as texts below its least number of words; very long texts pass whole; of
repeated rows one stays; rows without an id are compared like all others and
keep a null id; rows without a language or source are judged in a cell of their
own; extra columns, whatever their names, pass through all stages but the last;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, neardup, packing, quality, secrets
from tessera.llm.common import documents, made, materialize, sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the robust distances reject."""
    return quality.filter_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the context trees can tell."""
    return langid.filter_documents(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, by five-word shingles and a similarity of 0.8."""
    return neardup.first_of_each_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets found replaced by a mark."""
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: Robust estimates, context trees and tokenizers are not SQL; tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    before = made()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(before, docs)  # the stage's own tables and the one that it read
    return docs
