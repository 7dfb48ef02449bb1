"""Rolls call logs up by day, and says how every item stands over the last days.

    spark-submit jobs/usage_rollup.py --events IN --out OUT [--config FILE]

Two tables, in partitions of the day (UTC for times with a zone):

- ``daily``: calls, successes and tool errors of each item and day;
- ``standing``: of each day and each item that was called in the ``trailing_days``
  up to it, those sums over that time, the usage prior that ranking blends in,
  the prior without the day itself, the days since the last call, and whether
  too many calls went wrong.

The high-water mark is the last day that a run has finished; it is added to the
table ``mark`` when both tables are written.  A run begins ``late_days`` before
the mark, so late calls of those days count, and reads only events from then on,
``daily`` from ``trailing_days`` before that.  It overwrites the days it computes
and no others.  Later calls of earlier days are not read; a run with ``since``
takes them in.

Reruns: whatever is written is computed anew from events and ``daily``, from a
day on that is known before; a run that was cut off left the mark where it was,
so the next one computes the same days again and gives the same tables.

Odd input: events without a time or an item are left out and counted in the log;
outcomes other than ``success`` and ``tool_error`` count as unreachable; events
that repeat one another count each; no events give no tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command, replace_partitions, session, settings
from tessera.functions import scoring as S
from tessera.operators.usage import tally

COUNTS = ("calls", "successes", "tool_errors")


@dataclass(frozen=True)
class Rollup:
    """``time``: the column of the call's time; ``item`` and ``outcome``: SQL over an event."""

    time: str
    item: str
    outcome: str
    format: str = "parquet"
    late_days: int = 2
    trailing_days: int = 7
    failing_share: float = 0.5
    failing_calls: int = 5


def high_water(spark: SparkSession, path: str) -> date | None:
    """The last day that a run has finished."""
    try:
        return spark.read.parquet(path).agg(F.max("day")).first()[0]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def daily_tallies(events: DataFrame, rules: Rollup) -> DataFrame:
    """day, mcp_id and the counts of each."""
    rows = events.select(F.to_date(rules.time).alias("day"), F.expr(rules.item).cast("string").alias("item"), F.expr(rules.outcome).alias("outcome")).where("day IS NOT NULL AND item <> ''")
    return tally(rows.withColumnRenamed("item", "mcp_id"), "day")


def standings(daily: DataFrame, start: date, end: date, rules: Rollup) -> DataFrame:
    """How each item stands on each day from ``start`` to ``end``: every daily row counts on its own day and those after it."""
    counts_on = F.sequence(F.greatest("day", F.lit(start)), F.least(F.date_add("day", rules.trailing_days - 1), F.lit(end)))
    rows = daily.where(F.date_add("day", rules.trailing_days - 1) >= F.lit(start)).withColumn("on", F.explode(counts_on))
    today = F.col("on") == F.col("day")
    sums = rows.groupBy("on", "mcp_id").agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.sum(F.when(today, 0).otherwise(F.col(c))).alias(f"before_{c}") for c in COUNTS], F.max("day").alias("last_call"))
    failed = F.col("calls") - F.col("successes")
    return sums.select(
        F.col("on").alias("day"), "mcp_id", *COUNTS, S.usage_score(*map(F.col, COUNTS)).alias("usage"), S.usage_score(*[F.col(f"before_{c}") for c in COUNTS]).alias("usage_before"),
        F.datediff("on", "last_call").alias("idle_days"), ((F.col("calls") >= rules.failing_calls) & (failed > rules.failing_share * F.col("calls"))).alias("failing"),
    )


def run(spark: SparkSession, events: str, out: str, rules: Rollup, since: date | None = None) -> dict[str, int]:
    """Brings both tables up to the last event; returns what was read and written."""
    out = out.rstrip("/")
    mark = high_water(spark, f"{out}/mark")
    start = since or (mark - timedelta(days=rules.late_days) if mark else None)
    every = spark.read.format(rules.format).load(events)
    new = every.where(F.col(rules.time) >= F.lit(start).cast(every.schema[rules.time].dataType)) if start else every
    seen = new.agg(F.count("*"), F.count(F.when(F.col(rules.time).isNotNull() & (F.expr(rules.item).cast("string") != ""), 1)), F.min(F.to_date(rules.time)), F.max(F.to_date(rules.time))).first()
    done = {"read": seen[0], "left out": seen[0] - seen[1], "daily": 0, "standing": 0}
    if seen[1]:
        start, end = start or seen[2], max(seen[3], mark or seen[3])
        replace_partitions(daily_tallies(new, rules).repartition("day"), f"{out}/daily", "day")
        daily = spark.read.parquet(f"{out}/daily").where(F.col("day") >= F.lit(start - timedelta(days=rules.trailing_days - 1)))
        replace_partitions(standings(daily, start, end, rules).repartition("day"), f"{out}/standing", "day")
        for name in ("daily", "standing"):
            done[name] = spark.read.parquet(f"{out}/{name}").where(F.col("day") >= F.lit(start)).count()
        if mark is None or end > mark:
            spark.createDataFrame([(end,)], "day date").write.mode("append").parquet(f"{out}/mark")
    LOG.info("mark %s: read %d events of %s from %s on, left out %d; wrote %d rows of daily and %d of standing to %s", mark, done["read"], events, start, done["left out"], done["daily"], done["standing"], out)
    return done


def main() -> None:
    given = command("Rolls call logs up by day.", "events", "out")
    spark = session("usage_rollup", given.shared)
    try:
        run(spark, given.events, given.out, settings(Rollup, given.config, "usage_rollup"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
