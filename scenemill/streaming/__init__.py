"""Task progress as a stream (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_progress(events: DataFrame) -> DataFrame:
    """Latest state of each task of a stream or table (task_id, seq, state, progress); in update mode one row per changed task."""
    return events.groupBy("task_id").agg(F.max_by("state", "seq").alias("state"), F.max_by("progress", "seq").alias("progress"), F.max("seq").alias("seq"))
