"""Job health tables and per-job detail."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY, in_workspace, join_jobs, together
from ..functions.numbers import percent, rounded
from ..functions.states import PRIORITY_ORDER, is_failed, is_finished, is_success, priority, traffic_light
from ..functions.timing import effective_seconds, trailing
from ..operators.health import (
    MIN_RUNS_FOR_STATS,
    day_count,
    day_words,
    job_priorities,
    percentiles,
    run_stats_with_last,
)
from ..operators.jobs import with_job_names
from ..operators.ordering import health_order
from ..operators.runs import last_two, recent_runs

DETAIL_RUNS = 10
ANOMALY_FACTOR = 2


def job_health(
    runs: DataFrame, jobs: DataFrame, as_of: date, days: int = 7, workspace_id: str | int | None = None
) -> DataFrame:
    """Finished runs, success rate, priority, status, retries and last run of every job.

    Two passes over the window: one hash aggregate for all counters, one rank that keeps two
    rows per job. They meet on their shared partitioning; names come in at job grain.
    """
    stats = run_stats_with_last(in_workspace(runs, workspace_id), as_of, days)
    rate = F.col("success_rate")
    return with_job_names(stats, jobs).select(
        *JOB_KEY,
        "job_name",
        "total_runs",
        "success_count",
        "success_rate",
        "last_run_time",
        "last_duration_seconds",
        priority(F.col("last_failed"), F.col("previous_failed"), rate).alias("priority"),
        traffic_light(rate).alias("status"),
        "retry_count",
        "open_runs",
    )


def health_ordered(health: DataFrame) -> DataFrame:
    return health.orderBy(*health_order())


def health_rollup(runs: DataFrame, jobs: DataFrame, as_of: date, approximate: bool = False) -> DataFrame:
    """Both windows, durations and flags of every job, as stored in the health rollup.

    All counters and the duration distribution come from one pass: rows are first counted per
    (job, duration), then summed per job with duration percentiles weighted by the counts.
    """
    week = trailing("period_start_time", as_of, 7)
    words = day_words(as_of, 7, is_finished() & week)
    recorded = F.col("run_duration_seconds").cast("long")
    pieces = together(
        runs.filter(trailing("period_start_time", as_of, 30))
        .groupBy(*JOB_KEY, F.when(is_finished(), recorded).alias("seconds"))
        .agg(
            F.count_if(is_finished()).alias("n30"),
            F.count_if(is_success()).alias("s30"),
            F.count_if(is_finished() & week).alias("n7"),
            F.count_if(is_success() & week).alias("s7"),
            *[bits.alias(name) for name, bits in words.items()],
        )
    )
    measured = F.when(F.col("seconds").isNotNull(), F.col("n30")).otherwise(F.lit(0).cast("long"))
    totals = (
        pieces.withColumn("measured", measured)
        .groupBy(*JOB_KEY)
        .agg(
            F.sum("n30").alias("total_runs_30d"),
            F.sum("s30").alias("success_count_30d"),
            F.sum("n7").alias("total_runs_7d"),
            F.sum("s7").alias("success_count_7d"),
            *[F.bit_or(name).alias(name) for name in words],
            percentiles(F.col("seconds"), [0.5, 0.9], F.col("measured"), approximate).alias("q"),
            (F.sum(F.col("seconds") * F.col("measured")).cast("double") / F.nullif(F.sum("measured"), F.lit(0))).alias(
                "avg_duration_seconds"
            ),
            F.max(F.when(F.col("measured") > 0, F.col("seconds"))).cast("double").alias("max_duration_seconds"),
        )
        .filter("total_runs_30d > 0")
    )
    flags = last_two(runs, as_of, 30, recent_days=7)
    rate_7d = percent(F.col("success_count_7d"), F.col("total_runs_7d"))
    joined = with_job_names(join_jobs(totals, flags), jobs)
    return joined.select(
        *JOB_KEY,
        "job_name",
        "total_runs_30d",
        "success_count_30d",
        percent(F.col("success_count_30d"), F.col("total_runs_30d")).alias("success_rate_30d"),
        "total_runs_7d",
        "success_count_7d",
        rate_7d.alias("success_rate_7d"),
        "last_run_time",
        "last_duration_seconds",
        priority(F.col("last_failed"), F.col("previous_failed"), rate_7d).alias("priority"),
        (F.col("total_runs_7d") - day_count(words)).alias("retry_count"),
        F.col("q")[0].alias("median_duration_seconds"),
        F.col("q")[1].alias("p90_duration_seconds"),
        "avg_duration_seconds",
        "max_duration_seconds",
    )


def health_counts(health: DataFrame) -> DataFrame:
    """Jobs per priority; the rest count as healthy."""
    return health.agg(
        *[F.count_if(F.col("priority") == level).alias(f"{level.lower()}_count") for level in PRIORITY_ORDER],
        F.count_if(F.col("priority").isNull()).alias("healthy_count"),
    )


def health_summary(runs: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Counts per priority and mean success rate, without names or durations."""
    return job_priorities(runs, as_of, days).agg(
        F.count(F.lit(1)).alias("total_count"),
        *[F.count_if(F.col("priority") == level).alias(f"{level.lower()}_count") for level in PRIORITY_ORDER],
        F.count_if(F.col("priority").isNull()).alias("healthy_count"),
        rounded(F.coalesce(mean_rate(), F.lit(0.0)), 1).alias("avg_success_rate"),
    )


def mean_rate(column: str = "success_rate"):
    """Mean of one-decimal rates, summed as decimals so the order of rows does not matter."""
    return F.sum(F.col(column).cast("decimal(10,1)")).cast("double") / F.count(column)


def job_details(runs: DataFrame, jobs: DataFrame, as_of: date) -> DataFrame:
    """Latest runs with anomaly flags, duration statistics, retries and failure reasons of every job.

    Everything but the run list comes from one pass that counts rows per (job, duration,
    termination code); the run list holds at most ten entries per job.
    """
    week = trailing("period_start_time", as_of, 7)
    words = day_words(as_of, 7, is_finished() & week)
    ended = is_finished() & F.col("period_end_time").isNotNull()
    seconds = F.when(ended & (effective_seconds() > 0), effective_seconds())
    pieces = together(
        runs.filter(trailing("period_start_time", as_of, 30))
        .groupBy(*JOB_KEY, seconds.alias("seconds"), F.when(is_failed(), F.col("termination_code")).alias("code"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(is_finished() & week).alias("n7"),
            *[bits.alias(name) for name, bits in words.items()],
        )
    )
    measured = F.when(F.col("seconds").isNotNull(), F.col("n")).otherwise(F.lit(0).cast("long"))
    stats = (
        pieces.withColumn("measured", measured)
        .groupBy(*JOB_KEY)
        .agg(
            F.percentile("seconds", [0.5, 0.9], F.col("measured")).alias("q"),
            (F.sum(F.col("seconds") * F.col("measured")).cast("double") / F.nullif(F.sum("measured"), F.lit(0))).alias(
                "avg_duration_seconds"
            ),
            F.max("seconds").cast("double").alias("max_duration_seconds"),
            F.sum("measured").alias("run_count"),
            F.sum("n7").alias("n7"),
            *[F.bit_or(name).alias(name) for name in words],
            F.sort_array(F.collect_set("code")).alias("failure_reasons"),
        )
        .withColumn("median_duration_seconds", F.col("q")[0])
        .withColumn("retry_count_7d", F.col("n7") - day_count(words))
    )
    window = runs.filter(trailing("period_start_time", as_of, 30)).select(
        *JOB_KEY, "run_id", "period_start_time", "period_end_time", "result_state", effective_seconds().alias("seconds")
    )
    latest = recent_runs(window, DETAIL_RUNS, finished_only=False)
    lists = latest.groupBy(*JOB_KEY).agg(
        F.sort_array(
            F.collect_list(
                F.struct("rn", "run_id", "period_start_time", "period_end_time", "seconds", "result_state")
            )
        ).alias("latest")
    )
    median = F.col("median_duration_seconds")

    def detail(entry: Column) -> Column:
        slow = (median > 0) & (entry.seconds > ANOMALY_FACTOR * median)
        return F.struct(
            entry.rn.alias("rn"),
            entry.run_id.alias("run_id"),
            entry.period_start_time.alias("start_time"),
            entry.period_end_time.alias("end_time"),
            entry.seconds.alias("duration_seconds"),
            entry.result_state.alias("result_state"),
            F.coalesce(slow, F.lit(False)).alias("is_anomaly"),
        )

    return with_job_names(join_jobs(lists, stats), jobs).select(
        *JOB_KEY,
        "job_name",
        F.transform("latest", detail).alias("recent_runs"),
        "median_duration_seconds",
        F.col("q")[1].alias("p90_duration_seconds"),
        "avg_duration_seconds",
        "max_duration_seconds",
        "run_count",
        (F.col("run_count") >= MIN_RUNS_FOR_STATS).alias("has_sufficient_data"),
        "retry_count_7d",
        "failure_reasons",
    )
