"""States of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(jobs: DataFrame) -> DataFrame:
    """``(file_name, id, status, progress, error_count)``: the last state of each file, by ``updated_at``, then ``id``; errors count only once a job is completed."""
    last = jobs.groupBy("file_name").agg(F.max_by(F.struct("id", "status", "progress", "error_count"), F.struct("updated_at", "id")).alias("s"))
    return last.select("file_name", "s.id", "s.status", "s.progress", F.when(F.col("s.status") == "completed", F.col("s.error_count")).alias("error_count"))
