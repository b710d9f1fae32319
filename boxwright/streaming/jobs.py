"""Job states and event windows, the same functions over batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status(events: DataFrame) -> DataFrame:
    """job, status, ts, events: the last event of each job (the largest id of equal times). Run a stream in update or complete mode."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy(F.col("user_id").alias("job")).agg(last.alias("l"), F.count("*").alias("events")).select("job", F.col("l.event_type").alias("status"), F.col("l.ts").alias("ts"), "events")


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """start, event_type, n, total for each hour. late: the watermark of a stream; an hour's state goes once it has passed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def resumed(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of a batch whose key is not done yet (for foreachBatch): a run that is resumed gives what one run gives."""
    return batch.join(done.select(key), key, "left_anti").dropDuplicates([key])
