"""Per-job health: counts, rates, retries, durations, failure reasons."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY, join_jobs, together
from ..functions.numbers import interpolated, percent
from ..functions.states import is_failed, is_finished, is_success, priority
from ..functions.timing import effective_seconds, trailing
from .jobs import job_tags
from .runs import last_two

MIN_RUNS_FOR_STATS = 5
# Days are kept as bits of BIGINTs, this many in each.
BITS_PER_WORD = 63


def day_words(as_of: date, days: int, condition: Column) -> dict[str, Column]:
    """Set of days with a matching row, as mergeable 8-byte words: one for each 63 days of the window.

    Their bits are an exact distinct day count that needs no extra shuffle; see ``day_count``.
    """
    offset = F.date_diff(F.lit(as_of), F.to_date("period_start_time"))
    words = {}
    for number in range(days // BITS_PER_WORD + 1):
        bit = offset - number * BITS_PER_WORD
        mine = condition & bit.between(0, BITS_PER_WORD - 1)
        words[f"days_{number}"] = F.bit_or(F.when(mine, F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
    return words


def day_count(words: Iterable[str]) -> Column:
    """Distinct days in the words; a word without a day is NULL."""
    total = F.lit(0)
    for word in words:
        total = total + F.coalesce(F.bit_count(word), F.lit(0))
    return total


def run_stats(runs: DataFrame, as_of: date, days: int = 7, reasons: bool = False) -> DataFrame:
    """Finished and open runs, successes, rate and retries of every job from one pass.

    With ``reasons`` the distinct termination codes of failed runs come along: rows are first
    counted per (job, code), so duplicates are gone before a job's codes are collected, and
    codes are a closed vocabulary.
    """
    counters = {
        "total_runs": is_finished(),
        "success_count": is_success(),
        "failed_count": is_failed(),
        "open_runs": F.col("period_end_time").isNull(),
    }
    counts = [F.count_if(condition).alias(name) for name, condition in counters.items()]
    in_window = runs.filter(trailing("period_start_time", as_of, days))
    extra: list[Column] = []
    words = day_words(as_of, days, is_finished())
    seen = [bits.alias(name) for name, bits in words.items()]
    if reasons:
        code = F.when(is_failed(), F.col("termination_code")).alias("code")
        pieces = in_window.groupBy(*JOB_KEY, code).agg(*counts, *seen)
        per_job = pieces.groupBy(*JOB_KEY).agg(
            *[F.sum(name).alias(name) for name in counters],
            *[F.bit_or(name).alias(name) for name in words],
            F.sort_array(F.collect_list("code")).alias("failure_reasons"),
        )
        extra.append(F.col("failure_reasons"))
    else:
        per_job = in_window.groupBy(*JOB_KEY).agg(*counts, *seen)
    return per_job.filter("total_runs > 0").select(
        *JOB_KEY,
        *counters,
        percent(F.col("success_count"), F.col("total_runs")).alias("success_rate"),
        (F.col("total_runs") - day_count(words)).alias("retry_count"),
        *extra,
    )


def run_stats_with_last(runs: DataFrame, as_of: date, days: int = 7, reasons: bool = False) -> DataFrame:
    """Run statistics plus the newest finished run and the two failure flags.

    Both sides are hash partitioned by job after their own shuffle, so the join adds none.
    """
    return join_jobs(run_stats(runs, as_of, days, reasons), last_two(runs, as_of, days))


def success_rates(runs: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    return run_stats(runs, as_of, days).select(*JOB_KEY, "total_runs", "success_count", "success_rate")


def retry_counts(runs: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Runs beyond the first of each day, summed over the days."""
    return (
        runs.filter(trailing("period_start_time", as_of, days) & is_finished())
        .groupBy(*JOB_KEY, F.to_date("period_start_time").alias("run_date"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*JOB_KEY)
        .agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("retry_count"))
    )


def retry_counts_distinct(runs: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Runs minus distinct run days: the same number from a single aggregate."""
    return run_stats(runs, as_of, days).select(
        *JOB_KEY, F.greatest(F.col("retry_count"), F.lit(0)).alias("retry_count")
    )


def job_priorities(runs: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    flagged = run_stats_with_last(runs, as_of, days)
    return flagged.select(
        *JOB_KEY,
        "success_rate",
        priority(F.col("last_failed"), F.col("previous_failed"), F.col("success_rate")).alias("priority"),
    )


def duration_rows(runs: DataFrame, as_of: date, days: int, effective: bool) -> DataFrame:
    """Finished runs of the window with their duration: as recorded, or the positive effective one."""
    in_window = runs.filter(trailing("period_start_time", as_of, days) & is_finished())
    start = F.to_date("period_start_time").alias("run_date")
    if effective:
        in_window = in_window.filter(F.col("period_end_time").isNotNull())
        return in_window.select(*JOB_KEY, start, effective_seconds().alias("seconds")).filter("seconds > 0")
    recorded = F.col("run_duration_seconds").cast("long").alias("seconds")
    return in_window.select(*JOB_KEY, start, recorded).filter("seconds IS NOT NULL")


def duration_histogram(
    runs: DataFrame, as_of: date, days: int, effective: bool, by_day: bool = False
) -> DataFrame:
    """Rows per job and duration in seconds: an exact, mergeable form of the distribution."""
    keys = [*JOB_KEY, "run_date", "seconds"] if by_day else [*JOB_KEY, "seconds"]
    return together(duration_rows(runs, as_of, days, effective).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


def percentiles(value: Column, points: list[float], weight: Column, approximate: bool) -> Column:
    if approximate:
        return F.percentile_approx(value.cast("double"), points, 10_000)
    return F.percentile(value, points, weight)


def duration_stats(
    runs: DataFrame, as_of: date, days: int = 30, effective: bool = False, approximate: bool = False
) -> DataFrame:
    """Median, p90, mean and maximum duration per job, exact by default.

    The rows are first counted per (job, seconds), which spreads a hot job over all tasks;
    what reaches the per-job aggregate is its distinct durations. ``approximate`` skips the
    histogram and keeps a fixed-size sketch per job instead.
    """
    if approximate:
        source = duration_rows(runs, as_of, days, effective).withColumn("n", F.lit(1).cast("long"))
    else:
        source = duration_histogram(runs, as_of, days, effective)
    return (
        source.groupBy(*JOB_KEY)
        .agg(
            percentiles(F.col("seconds"), [0.5, 0.9], F.col("n"), approximate).alias("q"),
            F.sum(F.col("seconds") * F.col("n")).alias("total_seconds"),
            F.max("seconds").alias("max_duration_seconds"),
            F.sum("n").alias("run_count"),
        )
        .select(
            *JOB_KEY,
            F.col("q")[0].alias("median_duration_seconds"),
            F.col("q")[1].alias("p90_duration_seconds"),
            (F.col("total_seconds").cast("double") / F.col("run_count")).alias("avg_duration_seconds"),
            F.col("max_duration_seconds").cast("double").alias("max_duration_seconds"),
            "run_count",
            (F.col("run_count") >= MIN_RUNS_FOR_STATS).alias("has_sufficient_data"),
        )
    )


def percentile_of_counts(histogram: DataFrame, point: float, name: str) -> DataFrame:
    """Continuous percentile per job from the counts of its durations, equal to SQL in the last place."""
    per_job = Window.partitionBy(*JOB_KEY)
    so_far = per_job.orderBy("seconds").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seconds = F.col("seconds").cast("double")
    around = (
        histogram.withColumn("up_to", F.sum("n").over(so_far))
        .withColumn("run_count", F.sum("n").over(per_job))
        .withColumn("place", (F.col("run_count") - 1) * F.lit(point))
        .groupBy(*JOB_KEY, "run_count", "place")
        .agg(
            F.min(F.when(F.col("up_to") > F.floor("place"), seconds)).alias("low"),
            F.min(F.when(F.col("up_to") > F.ceil("place"), seconds)).alias("high"),
        )
        .withColumn("d", F.col("place") - F.floor("place"))
    )
    return around.select(*JOB_KEY, "run_count", interpolated(F.col("low"), F.col("high"), F.col("d")).alias(name))


def suggested_sla(runs: DataFrame, jobs: DataFrame, as_of: date) -> DataFrame:
    """p90 duration in minutes, rounded up, for current jobs that have no SLA tag."""
    durations = duration_histogram(runs, as_of, 30, effective=True)
    stats = percentile_of_counts(durations, 0.9, "p90_duration_seconds").filter(F.col("run_count") >= MIN_RUNS_FOR_STATS)
    without_sla = job_tags(jobs).filter("NOT has_sla").select(*JOB_KEY)
    return stats.join(without_sla, JOB_KEY, "left_semi").select(
        *JOB_KEY, F.ceil(F.col("p90_duration_seconds") / 60).cast("int").alias("suggested_p90_minutes")
    )


def duration_anomalies(runs: DataFrame, as_of: date, days: int = 30, factor: float = 2.0) -> DataFrame:
    """Runs longer than ``factor`` times the median of their job.

    The histogram carries the medians to the anomalous durations, so the run table itself
    is joined only against the few (job, seconds) pairs that exceed the limit.
    """
    stats = duration_stats(runs, as_of, days, effective=True).select(
        *JOB_KEY, F.col("median_duration_seconds").alias("baseline_median_seconds")
    )
    limits = (
        duration_histogram(runs, as_of, days, effective=True)
        .join(stats, JOB_KEY)
        .filter((F.col("baseline_median_seconds") > 0) & (F.col("seconds") > factor * F.col("baseline_median_seconds")))
        .select(*JOB_KEY, F.col("seconds").alias("duration_seconds"), "baseline_median_seconds")
    )
    return (
        runs.filter(
            trailing("period_start_time", as_of, days) & is_finished() & F.col("period_end_time").isNotNull()
        )
        .select(*JOB_KEY, "run_id", "period_start_time", effective_seconds().alias("duration_seconds"))
        .join(limits, [*JOB_KEY, "duration_seconds"])
    )


def failure_reasons(runs: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """Distinct termination codes of the failed runs of every job, sorted.

    Codes are a closed vocabulary, so the array per job is small; duplicates are removed
    in a (job, code) aggregate before anything is collected.
    """
    return (
        runs.filter(trailing("period_start_time", as_of, days) & is_failed() & F.col("termination_code").isNotNull())
        .groupBy(*JOB_KEY, "termination_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*JOB_KEY)
        .agg(F.sort_array(F.collect_list("termination_code")).alias("failure_reasons"))
    )


def sla_breach_history(runs: DataFrame, jobs: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Per job with an SLA and day: finished runs, how many ran longer than it, and whether any did.

    Works on the daily duration histogram, so a hot job contributes its distinct durations only.
    """
    targets = job_tags(jobs).filter("has_sla").select(*JOB_KEY, "sla_minutes")
    over = F.col("seconds") > F.col("sla_minutes") * 60
    return (
        duration_histogram(runs, as_of, days, effective=True, by_day=True)
        .join(targets, JOB_KEY)
        .groupBy(*JOB_KEY, "run_date", "sla_minutes")
        .agg(
            F.sum("n").alias("measured_runs"),
            F.sum(F.when(over, F.col("n")).otherwise(0)).alias("breach_count"),
        )
        .withColumn("breached", F.col("breach_count") > 0)
    )
