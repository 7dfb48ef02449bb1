"""Capability cards and quality priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X


def card(description: Column, title: Column, tools: Column) -> Column:
    """A card from what the row says itself.

    Each tool with a readable name gives a task and, together, two questions
    and the first sentence of its description.
    """
    named = F.filter(F.transform(tools, lambda t: F.struct(X.humanize(t["name"]).alias("phrase"), X.trim(t["description"]).alias("text"))), lambda t: t["phrase"] != "")
    asked = F.flatten(F.transform(named, lambda t: F.array(F.concat(F.lit("how do I "), t["phrase"]), F.concat(F.lit("I need to "), t["phrase"]), X.first_sentence(t["text"]))))
    return F.struct(
        X.trim(description).alias("summary"),
        X.ordered_set(F.transform(named, lambda t: t["phrase"])).alias("tasks"),
        X.ordered_set(F.concat(asked, F.array(X.first_sentence(description), title))).alias("exampleQueries"),
        X.keywords(F.concat_ws(" ", title, description)).alias("synonyms"),
        F.array().cast("array<string>").alias("categories"),
        F.lit("heuristic").alias("enricher"),
    )


def enrich(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("enrichment", card(F.col("description"), F.col("title"), F.col("tools")))


def is_empty(c: Column) -> Column:
    """A card with nothing in it, whoever made it."""
    return (c["summary"] == "") & (F.size(c["tasks"]) == 0) & (F.size(c["exampleQueries"]) == 0) & (F.size(c["synonyms"]) == 0) & (F.size(c["categories"]) == 0)


def score_trust(catalog: DataFrame, as_of: str) -> DataFrame:
    """``trust`` as of a stated time, never the clock's."""
    return catalog.withColumn("trust", S.trust(F.col, F.to_timestamp(F.lit(as_of))))
