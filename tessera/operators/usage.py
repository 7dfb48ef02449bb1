"""Outcomes of calls and the prior they give."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S

OUTCOMES = ("success", "tool_error", "unreachable")


def tally(events: DataFrame, *by: str) -> DataFrame:
    """Other keys, mcp_id, calls, successes, tool_errors; unreachable calls are the rest.  Works on batches and streams."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return events.where("mcp_id is not null and mcp_id <> ''").groupBy(*by, "mcp_id").agg(F.count("*").alias("calls"), count("success").alias("successes"), count("tool_error").alias("tool_errors"))


def merge_tallies(*tallies: DataFrame) -> DataFrame:
    """Sums of snapshots, as a restart continues one."""
    out = tallies[0]
    for more in tallies[1:]:
        out = out.unionByName(more)
    return out.groupBy("mcp_id").agg(*[F.sum(c).alias(c) for c in ("calls", "successes", "tool_errors")])


def with_scores(tallies: DataFrame) -> DataFrame:
    return tallies.withColumn("usage", S.usage_score(F.col("calls"), F.col("successes"), F.col("tool_errors")))


def save_snapshot(tallies: DataFrame, path: str) -> None:
    tallies.write.mode("overwrite").parquet(path)


def load_snapshot(spark, path: str) -> DataFrame:
    """Tallies of a snapshot, the last of each item where a stream wrote several; none where there is no readable one."""
    counts = ("calls", "successes", "tool_errors")
    try:
        found = spark.read.parquet(path)
        if "batch" in found.columns:
            last = F.max_by(F.struct(*counts), "batch")
            return found.groupBy("mcp_id").agg(last.alias("last")).select("mcp_id", *[F.col(f"last.{c}").alias(c) for c in counts])
        return found.select("mcp_id", *counts)
    except AnalysisException:
        return spark.createDataFrame([], "mcp_id string, calls bigint, successes bigint, tool_errors bigint")
