"""Period-over-period series: the window against the same number of days before it."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY, in_workspace
from ..functions.numbers import rounded
from ..functions.states import is_failed, is_finished, is_success
from ..sources.readers import job_usage
from .jobs import jobs_of_team


def granularity(days: int) -> str:
    if days <= 7:
        return "hourly"
    return "daily" if days <= 30 else "weekly"


def granularity_between(start: date, end: date) -> str:
    return granularity((end - start).days)


def _check(days: int) -> None:
    if not 1 <= days <= 90:
        raise ValueError("days must be between 1 and 90")


def _both_periods(column: str, as_of: date, days: int) -> Column:
    first = F.lit(as_of - timedelta(days=2 * days))
    return (F.col(column) >= first) & (F.col(column) < F.lit(as_of + timedelta(days=1)))


def _is_current(column: str, as_of: date, days: int) -> Column:
    return F.col(column) >= F.lit(as_of - timedelta(days=days))


def _bucket(day: Column, as_of: date, days: int) -> Column:
    """Day of the current window a row belongs to, previous rows shifted forward.

    Weeks are counted from the start of the window, so both periods align for any length.
    """
    if granularity(days) != "weekly":
        return day
    start = F.lit(as_of - timedelta(days=days))
    weeks = F.floor(F.date_diff(day, start) / 7).cast("int")
    return F.date_add(start, weeks * 7)


def _chosen_jobs(df: DataFrame, jobs: DataFrame | None, team: str | None) -> DataFrame:
    """Team filter on per-job partial sums, so no row-level join is needed."""
    if team is None:
        return df
    if jobs is None:
        raise ValueError("a team filter needs the jobs table")
    return df.join(jobs_of_team(jobs, team), JOB_KEY, "left_semi")


def _one_job(df: DataFrame, job_id: int | None) -> DataFrame:
    return df if job_id is None else df.filter(F.col("job_id") == F.lit(job_id).cast("long"))


def trend_cost(
    usage: DataFrame,
    as_of: date,
    days: int = 7,
    jobs: DataFrame | None = None,
    team: str | None = None,
    job_id: int | None = None,
    workspace_id: str | int | None = None,
) -> DataFrame:
    """Net usage per bucket. Usage is daily, so a day is the finest bucket."""
    _check(days)
    rows = _one_job(job_usage(in_workspace(usage, workspace_id).filter(_both_periods("usage_date", as_of, days))), job_id)
    current = _is_current("usage_date", as_of, days)
    day = F.when(current, F.col("usage_date")).otherwise(F.date_add("usage_date", days))
    partial = (
        rows.groupBy(*JOB_KEY, _bucket(day, as_of, days).alias("period"), current.alias("is_current"))
        .agg(F.sum("usage_quantity").alias("dbus"))
    )
    zero = F.lit(0).cast("decimal(28,5)")
    sums = _chosen_jobs(partial, jobs, team).groupBy("period").agg(
        F.sum(F.when(F.col("is_current"), F.col("dbus")).otherwise(zero)).alias("current"),
        F.sum(F.when(~F.col("is_current"), F.col("dbus")).otherwise(zero)).alias("previous"),
    )
    return sums.select(
        "period", F.col("current").cast("double").alias("current"), F.col("previous").cast("double").alias("previous")
    ).orderBy("period")


def _run_buckets(
    runs: DataFrame,
    as_of: date,
    days: int,
    jobs: DataFrame | None,
    team: str | None,
    job_id: int | None,
    workspace_id: str | int | None,
) -> DataFrame:
    """Finished, successful and failed runs per bucket and period."""
    _check(days)
    column = "period_start_time"
    kind = runs.schema[column].dataType
    rows = _one_job(in_workspace(runs, workspace_id), job_id).filter(_both_periods(column, as_of, days) & is_finished())
    current = _is_current(column, as_of, days)
    if granularity(days) == "hourly":
        shifted = F.when(current, F.col(column)).otherwise(F.col(column) + F.make_dt_interval(F.lit(days)))
        period = F.date_trunc("hour", shifted).cast(kind)
    else:
        start = F.to_date(column)
        day = F.when(current, start).otherwise(F.date_add(start, days))
        period = _bucket(day, as_of, days).cast(kind)
    counts = [
        F.count(F.lit(1)).alias("runs"),
        F.count_if(is_success()).alias("successes"),
        F.count_if(is_failed()).alias("failures"),
    ]
    keys = [period.alias("period"), current.alias("is_current")]
    if team is not None:
        keys = [*JOB_KEY, *keys]
    return _chosen_jobs(rows.groupBy(*keys).agg(*counts), jobs, team)


def trend_success(
    runs: DataFrame,
    as_of: date,
    days: int = 7,
    jobs: DataFrame | None = None,
    team: str | None = None,
    job_id: int | None = None,
    workspace_id: str | int | None = None,
) -> DataFrame:
    """Success rate per bucket; NULL where a period has no finished run."""
    now = F.col("is_current")

    def rate(mine: Column) -> Column:
        total = F.sum(F.when(mine, F.col("runs")).otherwise(0))
        good = F.sum(F.when(mine, F.col("successes")).otherwise(0))
        return good.cast("double") * 100.0 / F.nullif(total.cast("double"), F.lit(0.0))

    buckets = _run_buckets(runs, as_of, days, jobs, team, job_id, workspace_id)
    return buckets.groupBy("period").agg(rate(now).alias("current"), rate(~now).alias("previous")).orderBy("period")


def trend_failures(
    runs: DataFrame,
    as_of: date,
    days: int = 7,
    jobs: DataFrame | None = None,
    team: str | None = None,
    job_id: int | None = None,
    workspace_id: str | int | None = None,
) -> DataFrame:
    """Failed runs per bucket; buckets without any are left out."""
    now = F.col("is_current")
    buckets = _run_buckets(runs, as_of, days, jobs, team, job_id, workspace_id)
    return (
        buckets.groupBy("period")
        .agg(
            F.sum(F.when(now, F.col("failures")).otherwise(0)).alias("current"),
            F.sum(F.when(~now, F.col("failures")).otherwise(0)).alias("previous"),
        )
        .filter((F.col("current") > 0) | (F.col("previous") > 0))
        .orderBy("period")
    )


def trend_headline(series: DataFrame, days: int, kind: str = "sum") -> DataFrame:
    """One row per series: totals and relative change, or for ``kind='rate'`` the mean of the
    buckets that have runs and the difference in points."""
    if kind == "rate":
        totals = series.agg(
            rounded(F.coalesce(F.avg("current"), F.lit(0.0)), 1).alias("current_total"),
            rounded(F.coalesce(F.avg("previous"), F.lit(0.0)), 1).alias("previous_total"),
            rounded(F.coalesce(F.avg("current"), F.lit(0.0)) - F.coalesce(F.avg("previous"), F.lit(0.0)), 1).alias(
                "change_percent"
            ),
        )
    else:
        exact = [F.coalesce(F.sum(F.col(c).cast("decimal(28,5)")).cast("double"), F.lit(0.0)) for c in ("current", "previous")]
        change = (F.col("current_total") - F.col("previous_total")) / F.col("previous_total") * 100
        totals = series.agg(exact[0].alias("current_total"), exact[1].alias("previous_total")).withColumn(
            "change_percent", rounded(F.when(F.col("previous_total") > 0, change).otherwise(0.0), 1)
        )
    return totals.withColumn("granularity", F.lit(granularity(days)))
