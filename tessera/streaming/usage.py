"""Usage tallies as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import tally


def start_tally(events: DataFrame, checkpoint: str, name: str, once: bool = False) -> StreamingQuery:
    """Keeps tallies of a stream of (mcp_id, outcome) in the table ``name``; every 30 s, or once over what is there."""
    writer = tally(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def start_snapshots(events: DataFrame, checkpoint: str, path: str, once: bool = False) -> StreamingQuery:
    """Writes the tallies that a batch has changed to ``path``, a directory for each batch; ``load_snapshot`` takes the last of each item.

    The tallies themselves are the stream's keyed state, which the checkpoint
    keeps, so a restart goes on from them.  A batch that is repeated has the same
    number and overwrites its own directory.  Where there are more items than fit
    in an executor, set ``spark.sql.streaming.stateStore.providerClass`` to
    Spark's RocksDB provider.
    """

    def flush(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch:012d}")

    writer = tally(events).writeStream.outputMode("update").foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def windowed_tally(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An extension: outcomes of each event-time window, with a bound on late events (``ts``)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("window"), "mcp_id", "outcome").agg(F.count("*").alias("calls"))
