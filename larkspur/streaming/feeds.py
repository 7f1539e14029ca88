"""Windowed sums and customer state of a feed, for late and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str = "ts", group: str = "event_type", value: str = "value", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum of each group in tumbling windows; rows later than `late` are dropped
    by the watermark in a stream, and none in a batch."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    g = rows.groupBy(F.window(time, window).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), group, "n", "total")


def without_repeats(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "2 days") -> DataFrame:
    """One row a key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def to_memory(stream: DataFrame, name: str, mode: str = "append"):
    """Runs a stream over what there is and ends; the result is the table `name`."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
