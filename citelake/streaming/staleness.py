"""An extension: a stream of changed passages against stored hashes, and windowed event counts.

Stale rows are keyed by what they are about, so a batch that is delivered twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_rows(passages: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded hashes (id, ref, content_hash) that a changed passage (ref, content_hash) no longer has."""
    now = passages.select("ref", F.col("content_hash").alias("now"))
    return recorded.join(now, "ref").filter(F.col("content_hash") != F.col("now")).select("id", "ref", "content_hash", "now").distinct()


def watch(stream: DataFrame, recorded: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands the stale rows of each batch to sink(rows, batch)."""

    def each(batch: DataFrame, number: int) -> None:
        sink(stale_rows(batch, recorded), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", key, "n")
