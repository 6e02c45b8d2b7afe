"""Run-level operators: scans, run spans, latest runs per job, active runs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY, join_spread
from ..functions.naming import is_streaming_name
from ..functions.states import is_failed, is_finished, outcome
from ..functions.timing import effective_seconds, elapsed_seconds, moment_like, trailing
from .jobs import with_job_names

# Run time after which a run counts as long, batch and streaming.
LONG_BATCH_HOURS = 4
LONG_STREAMING_HOURS = 24


def newest_first():
    """Per-job order of runs; the run id breaks ties so results do not depend on input order."""
    return Window.partitionBy(*JOB_KEY).orderBy(F.col("period_start_time").desc(), F.col("run_id").desc())


def list_runs(runs: DataFrame, as_of: date, days: int = 7, limit: int | None = None) -> DataFrame:
    if not 1 <= days <= 90:
        raise ValueError("days must be between 1 and 90")
    result = (
        runs.filter(trailing("period_start_time", as_of, days))
        .select(
            *JOB_KEY, "run_id", "period_start_time", "period_end_time", "run_duration_seconds", "result_state"
        )
        .orderBy(F.col("period_start_time").desc(), F.col("run_id").desc())
    )
    return result if limit is None else result.limit(limit)


def run_outcomes(runs: DataFrame) -> DataFrame:
    return runs.select(*JOB_KEY, "run_id", "result_state", outcome().alias("outcome"))


def effective_durations(runs: DataFrame) -> DataFrame:
    """Finished runs with a positive effective duration."""
    return (
        runs.filter(is_finished() & F.col("period_end_time").isNotNull())
        .select(*JOB_KEY, "run_id", effective_seconds().alias("effective_seconds"))
        .filter("effective_seconds > 0")
    )


def within(runs: DataFrame, as_of: date | None, days: int | None) -> DataFrame:
    """The runs of a window, or all runs where none is given."""
    return runs if as_of is None or days is None else runs.filter(trailing("period_start_time", as_of, days))


def runs_for_jobs(runs: DataFrame, ids: DataFrame, as_of: date | None = None, days: int | None = None) -> DataFrame:
    """Runs of the listed jobs, of a window if given; a semi join, so the list may be of any length."""
    return join_spread(within(runs, as_of, days), ids.select(*JOB_KEY).distinct(), "run_id", "left_semi")


def run_spans(periods: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """One row per finished run over all its periods: first start, last end, whole seconds."""
    return (
        periods.filter(trailing("period_start_time", as_of, days) & is_finished())
        .groupBy(*JOB_KEY, "run_id", "result_state")
        .agg(
            F.min("period_start_time").alias("period_start_time"),
            F.max("period_end_time").alias("period_end_time"),
        )
        .withColumn(
            "duration_seconds",
            F.timestamp_diff("SECOND", F.col("period_start_time"), F.col("period_end_time")),
        )
    )


def recent_runs(
    runs: DataFrame, limit: int, finished_only: bool = True, as_of: date | None = None, days: int | None = None
) -> DataFrame:
    """Latest ``limit`` runs of every job, numbered from 1, of a window if given.

    The rank filter is applied before the shuffle as well, so a job with a third of all
    runs sends at most ``limit`` rows per task.
    """
    runs = within(runs, as_of, days)
    source = runs.filter(is_finished()) if finished_only else runs
    return source.withColumn("rn", F.row_number().over(newest_first())).filter(F.col("rn") <= limit)


def last_two(runs: DataFrame, as_of: date, days: int, recent_days: int | None = None) -> DataFrame:
    """Newest finished run of every job, and whether it and the one before it failed.

    ``recent_days`` narrows the two failure flags to a shorter window than ``days``.
    """
    flags_since = trailing("period_start_time", as_of, recent_days or days)
    candidates = runs.filter(trailing("period_start_time", as_of, days)).select(
        *JOB_KEY,
        "run_id",
        "period_start_time",
        "run_duration_seconds",
        "result_state",
        (is_failed() & flags_since).alias("failed"),
    )
    newest, second = F.col("rn") == 1, F.col("rn") == 2
    return (
        recent_runs(candidates, 2)
        .groupBy(*JOB_KEY)
        .agg(
            F.max(F.when(newest, F.col("period_start_time"))).alias("last_run_time"),
            F.max(F.when(newest, F.col("run_duration_seconds"))).alias("last_duration_seconds"),
            F.max(newest & F.col("failed")).alias("last_failed"),
            F.max(second & F.col("failed")).alias("previous_failed"),
        )
    )


def consecutive_failures(runs: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """The last two finished states of every job."""
    finished = runs.filter(trailing("period_start_time", as_of, days))
    newest, second = F.col("rn") == 1, F.col("rn") == 2
    return (
        recent_runs(finished, 2)
        .groupBy(*JOB_KEY)
        .agg(
            F.max(F.when(newest, F.upper("result_state"))).alias("last_state"),
            F.max(F.when(second, F.upper("result_state"))).alias("previous_state"),
            F.max(newest & is_failed()).alias("last_failed"),
            (F.max(newest & is_failed()) & F.max(second & is_failed())).alias("consecutive_failure"),
        )
    )


def recent_runs_by_job(
    periods: DataFrame, ids: DataFrame, as_of: date, limit: int = 5, days: int = 30
) -> DataFrame:
    """Every requested job with its latest finished runs, newest first, or an empty list."""
    lists = (
        recent_runs(run_spans(periods, as_of, days), limit)
        .groupBy(*JOB_KEY)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "rn",
                        "run_id",
                        "result_state",
                        F.col("period_start_time").alias("start_time"),
                        F.col("period_end_time").alias("end_time"),
                        "duration_seconds",
                    )
                )
            ).alias("recent_runs")
        )
    )
    empty = F.array().cast(lists.schema["recent_runs"].dataType)
    return (
        ids.select(*JOB_KEY)
        .distinct()
        .join(lists, JOB_KEY, "left")
        .withColumn("recent_runs", F.coalesce("recent_runs", empty))
    )


def open_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs without an end, newest first."""
    result = (
        runs.filter(F.col("period_end_time").isNull())
        .select(*JOB_KEY, "run_id", "period_start_time")
        .orderBy(F.col("period_start_time").desc(), F.col("run_id").desc())
    )
    return result if limit is None else result.limit(limit)


def active_in_state(active: DataFrame, state: str = "all") -> DataFrame:
    """PENDING includes queued runs."""
    if state == "all":
        return active
    states = ["PENDING", "QUEUED"] if state == "PENDING" else [state]
    return active.filter(F.col("state").isin(states))


def active_summary(active: DataFrame) -> DataFrame:
    return active.agg(
        F.count(F.lit(1)).alias("total_active"),
        F.count_if(F.col("state") == "RUNNING").alias("running_count"),
        F.count_if(F.col("state") == "PENDING").alias("pending_count"),
        F.count_if(F.col("state") == "QUEUED").alias("queued_count"),
    )


def long_running(active: DataFrame, jobs: DataFrame, as_of_ts: datetime) -> DataFrame:
    """Active runs with their run time and whether it is long for their kind of job."""
    named = with_job_names(active, jobs)
    seconds = elapsed_seconds(F.col("start_time"), moment_like(active, "start_time", as_of_ts))
    streaming = is_streaming_name(F.col("job_name"))
    threshold = F.when(F.col("is_streaming"), LONG_STREAMING_HOURS * 3600).otherwise(LONG_BATCH_HOURS * 3600)
    return (
        named.withColumn("elapsed_seconds", seconds)
        .withColumn("is_streaming", streaming)
        .withColumn("is_long_running", F.coalesce(F.col("elapsed_seconds") > threshold, F.lit(False)))
        .select(*JOB_KEY, "run_id", "job_name", "elapsed_seconds", "is_streaming", "is_long_running")
    )


def active_with_history(
    active: DataFrame, runs: DataFrame, limit: int = 5, as_of: date | None = None, days: int | None = None
) -> DataFrame:
    """Active runs, each with the latest finished runs of its job, of a window if given.

    Histories are built only for jobs that are active: the run table is reduced by a semi
    join before it is ranked.
    """
    ids = active.select(*JOB_KEY).distinct()
    history = (
        recent_runs(runs_for_jobs(runs.filter(is_finished()), ids, as_of, days), limit)
        .groupBy(*JOB_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("rn", "run_id", "result_state"))).alias("recent_runs"))
    )
    empty = F.array().cast(history.schema["recent_runs"].dataType)
    return active.join(history, JOB_KEY, "left").withColumn("recent_runs", F.coalesce("recent_runs", empty))
