"""Usage per hour of run time, and what it says about cluster size."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY, join_jobs, together
from ..functions.load import driver_utilization, right_sizing, worker_utilization
from ..functions.states import is_finished
from ..functions.timing import effective_seconds, trailing
from .cost import daily_job
from .runs import recent_runs

MIN_RUNS = 3
OVERPROVISIONED_BELOW = 40


def measured_runs(runs: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Completed runs of the window with a positive effective duration."""
    return (
        runs.filter(
            trailing("period_start_time", as_of, days) & F.col("period_end_time").isNotNull() & is_finished()
        )
        .select(
            *JOB_KEY,
            "run_id",
            "period_start_time",
            F.to_date("period_start_time").alias("usage_date"),
            effective_seconds().alias("seconds"),
        )
        .filter("seconds > 0")
    )


def run_dbu_rate(runs: DataFrame, usage: DataFrame, as_of: date, days: int = 30, allocate: bool = False) -> DataFrame:
    """Mean usage per hour over the runs of every job with at least three runs.

    By default the net usage of a day is charged in full to every run of that day;
    ``allocate`` divides it among the runs by their duration. Runs are reduced to one row per
    (job, day) before usage is joined, so no run-level join on a hot job takes place.
    """
    measured = measured_runs(runs, as_of, days)
    by_day = together(
        measured.groupBy(*JOB_KEY, "usage_date").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.lit(3600.0) / F.col("seconds")).alias("inverse_hours"),
            F.sum("seconds").alias("day_seconds"),
        )
    )
    spend = daily_job(usage, as_of, days).filter("dbus > 0")
    dbus = F.coalesce(F.col("dbus").cast("double"), F.lit(0.0))
    if allocate:
        day_sum = dbus * 3600.0 / F.col("day_seconds") * F.col("n")
    else:
        day_sum = dbus * F.col("inverse_hours")
    rates = (
        by_day.join(spend.hint("merge"), [*JOB_KEY, "usage_date"], "left")
        .groupBy(*JOB_KEY)
        .agg((F.sum(day_sum) / F.sum("n")).alias("avg_dbus_per_hour"))
    )
    # A run may have several period rows; distinct run ids are counted in their own two-step aggregate.
    analyzed = (
        measured.groupBy(*JOB_KEY)
        .agg(F.count_distinct("run_id").alias("runs_analyzed"))
        .filter(F.col("runs_analyzed") >= MIN_RUNS)
    )
    return join_jobs(rates, analyzed)


def cluster_utilization(runs: DataFrame, usage: DataFrame, as_of: date, last_runs: int = 5) -> DataFrame:
    """Estimated utilisation over the latest runs of every job.

    A job is over-provisioned only if it has ``last_runs`` runs and every one of them is low.
    """
    latest = recent_runs(measured_runs(runs, as_of), last_runs, finished_only=False)
    spend = daily_job(usage, as_of).filter("dbus <> 0")
    rate = F.coalesce(F.col("dbus").cast("double"), F.lit(0.0)) / (F.col("seconds") / F.lit(3600.0))
    rated = latest.join(spend, [*JOB_KEY, "usage_date"], "left").withColumn("rate", rate)
    summary = rated.groupBy(*JOB_KEY).agg(
        F.count(F.lit(1)).alias("runs_analyzed"),
        F.avg(F.when(F.col("rate") > 0, F.col("rate"))).alias("avg_rate"),
        F.count_if(F.coalesce(worker_utilization(F.col("rate")) < OVERPROVISIONED_BELOW, F.lit(False))).alias("low_runs"),
    )
    worker, driver = worker_utilization(F.col("avg_rate")), driver_utilization(F.col("avg_rate"))
    mean = (F.col("driver_percent") + F.col("worker_percent")) / 2
    low = (
        (F.col("runs_analyzed") >= last_runs)
        & (mean < OVERPROVISIONED_BELOW)
        & (F.col("low_runs") == F.col("runs_analyzed"))
    )
    flagged = (
        summary.withColumn("driver_percent", driver)
        .withColumn("worker_percent", worker)
        .withColumn("is_over_provisioned", F.coalesce(low, F.lit(False)))
    )
    return flagged.select(
        *JOB_KEY,
        F.col("driver_percent").alias("driver_cpu_percent"),
        F.col("driver_percent").alias("driver_memory_percent"),
        F.col("worker_percent").alias("worker_cpu_percent"),
        F.col("worker_percent").alias("worker_memory_percent"),
        "is_over_provisioned",
        F.when(F.col("is_over_provisioned"), right_sizing(mean)).alias("recommendation"),
        "runs_analyzed",
    )
