"""Cost anomalies: spikes and jobs that cost much for little output."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY, join_jobs
from ..functions.numbers import fixed_text, ratio
from ..functions.wording import fill
from ..operators.cost import job_costs, little_output
from ..operators.health import run_stats


def cost_anomalies(
    usage: DataFrame, runs: DataFrame, jobs: DataFrame, as_of: date, days: int = 30
) -> DataFrame:
    """Spiking jobs, and idle-cost jobs that are not already spiking.

    Both rules are read off one row per job with its costs and run counts, so neither a union
    nor an anti-join is needed. The multiplier of a spike relates the week to the baseline, as
    its alert does.
    """
    zero = F.lit(0).cast("long")
    output = run_stats(runs, as_of, days).select(*JOB_KEY, F.col("total_runs").alias("run_count"), "success_count")
    rows = (
        join_jobs(job_costs(usage, jobs, as_of, days), output, "left")
        .withColumn("run_count", F.coalesce("run_count", zero))
        .withColumn("success_count", F.coalesce("success_count", zero))
    )
    total, week, base = F.col("total_dbus_30d"), F.col("current_7d_dbus"), F.col("baseline_p90_dbus")
    kind = F.when(F.col("is_anomaly"), "cost_spike").when(little_output(total), "zombie")
    spiking = F.col("anomaly_type") == "cost_spike"
    amount, count = fixed_text(total, 1), F.col("run_count").cast("string")
    idle = (
        F.when(F.col("run_count") == 0, fill("High cost ({t} DBUs) with no detected runs", t=amount))
        .when(
            F.col("success_count") == 0,
            fill("High cost ({t} DBUs) with 0 successful runs out of {n} attempts", t=amount, n=count),
        )
        .otherwise(
            fill(
                "High cost per run ({r} DBUs/run) may indicate inefficiency",
                r=fixed_text(ratio(total, F.col("run_count")), 1),
            )
        )
    )
    return (
        rows.withColumn("anomaly_type", kind)
        .filter("anomaly_type IS NOT NULL")
        .withColumn("multiplier", F.when(spiking, ratio(week, base)))
        .select(
            *JOB_KEY,
            "job_name",
            "team",
            "anomaly_type",
            F.when(spiking, fill("Cost {x}x higher than p90 baseline", x=fixed_text(F.col("multiplier"), 1)))
            .otherwise(idle)
            .alias("reason"),
            F.when(spiking, week).otherwise(total).alias("current_dbus"),
            F.when(spiking, base).alias("baseline_p90_dbus"),
            "multiplier",
        )
    )
