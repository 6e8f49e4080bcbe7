"""Extensions: Structured Streaming over the status log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """The latest status of each item as the log grows (update or complete mode). log: job_id, to_status, changed_at."""
    return log.groupBy("job_id").agg(F.max(F.struct("changed_at", "to_status")).alias("x")).select("job_id", "x.to_status", "x.changed_at")


def changes(log: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Changes to each status by window; rows later than `late` are left out (append mode). changed_at: a timestamp."""
    w = log.withWatermark("changed_at", late).groupBy(F.window("changed_at", window), "to_status").agg(F.count("*").alias("changes"))
    return w.select(F.col("window.start").alias("start"), "to_status", "changes")
