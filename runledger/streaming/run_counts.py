"""Runs per hour and outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.states import outcome

# Run tables are complete 15 minutes after the fact.
SOURCE_LAG = "15 minutes"


def stream_run_counts(runs: DataFrame, lag: str = SOURCE_LAG, width: str = "1 hour") -> DataFrame:
    """Tumbling counts; a window is emitted once the watermark has passed its end."""
    return (
        runs.withColumn("period_start_time", F.col("period_start_time").cast("timestamp"))
        .withWatermark("period_start_time", lag)
        .groupBy(F.window("period_start_time", width), outcome().alias("outcome"))
        .agg(F.count(F.lit(1)).alias("runs"))
        .select(F.col("window.start").alias("period"), "outcome", "runs")
    )
