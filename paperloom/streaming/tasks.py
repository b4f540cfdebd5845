"""A stream of task events as a table of tasks. An extra: job state may come as a stream instead of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import TERMINAL


def latest(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """task_id, status, at: each task's newest event by event time; state is kept by task for update mode."""
    newest = events.withWatermark("at", lateness).groupBy("task_id").agg(F.max(F.struct("at", "status")).alias("n"))
    return newest.select("task_id", "n.status", "n.at")


def ended_per_hour(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """window, status, n: how many tasks ended each hour; final once the watermark has passed the hour."""
    done = events.where(F.col("status").isin(*TERMINAL)).withWatermark("at", lateness)
    return done.groupBy(F.window("at", "1 hour"), "status").agg(F.count(F.lit(1)).alias("n"))
