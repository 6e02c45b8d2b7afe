"""Usage and cost per job, product and team. Quantities stay decimal until a result is final."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY, join_jobs, together
from ..functions.naming import sku_category
from ..functions.numbers import percentile_of, rounded, trend_percent
from ..functions.timing import trailing
from ..sources.readers import job_usage
from .jobs import UNTAGGED, with_job_names

MIN_BASELINE_DAYS = 5
BASELINE_DAYS = 30
# The current week holds the check day too.
WEEK_DATES = 8
SPIKE_FACTOR = 2
ZOMBIE_MIN_DBUS = 10
ZOMBIE_DBUS_PER_RUN = 5


def usage_daily(usage: DataFrame, as_of: date, days: int = 30, limit: int | None = None) -> DataFrame:
    """Net usage per day, job, cluster and product; fully retracted groups drop out."""
    if not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")
    result = (
        usage.filter(trailing("usage_date", as_of, days))
        .groupBy(
            "workspace_id",
            "usage_date",
            F.col("usage_metadata.job_id").alias("job_id"),
            F.col("usage_metadata.cluster_id").alias("cluster_id"),
            "sku_name",
        )
        .agg(F.sum("usage_quantity").alias("total_dbus"))
        .filter("total_dbus <> 0")
        .withColumn("total_dbus", F.col("total_dbus").cast("double"))
        .orderBy(
            F.col("usage_date").desc(),
            F.col("total_dbus").desc(),
            "workspace_id",
            F.col("job_id").asc_nulls_last(),
            "cluster_id",
            "sku_name",
        )
    )
    return result if limit is None else result.limit(limit)


def usage_by_job(usage: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Net usage and days with usage per job and product."""
    return (
        daily_job_sku(usage, as_of, days)
        .groupBy(*JOB_KEY, "sku_name")
        .agg(F.sum("dbus").alias("total_dbus"), F.count(F.lit(1)).alias("usage_days"))
        .filter("total_dbus <> 0")
        .withColumn("total_dbus", F.col("total_dbus").cast("double"))
    )


def daily_job_sku(usage: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Net usage per (job, product, day): the one pass over usage the cost table starts from.

    A hot job is reduced to days x products here, then its rows are brought together, so the
    results built on it need no further shuffle.
    """
    return together(
        job_usage(usage.filter(trailing("usage_date", as_of, days)))
        .groupBy(*JOB_KEY, "sku_name", "usage_date")
        .agg(F.sum("usage_quantity").alias("dbus"))
    )


def daily_job(usage: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Net usage per (job, day): the one pass all usage-based alerts start from."""
    return together(
        job_usage(usage.filter(trailing("usage_date", as_of, days)))
        .groupBy(*JOB_KEY, "usage_date")
        .agg(F.sum("usage_quantity").alias("dbus"))
    )


def spiking(week: Column, baseline: Column, factor: float = SPIKE_FACTOR) -> Column:
    """The one spike rule: a positive week above ``factor`` times a positive baseline day."""
    return F.coalesce((week > 0) & (baseline > 0) & (week > factor * baseline), F.lit(False))


def since(as_of: date, days: int) -> Column:
    return F.col("usage_date") >= F.lit(as_of - timedelta(days=days))


def in_current_week(as_of: date) -> Column:
    """The check day and the seven days before it."""
    return since(as_of, 7)


def in_previous_week(as_of: date) -> Column:
    return since(as_of, 14) & ~in_current_week(as_of)


def cost_job_sku(usage: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Net usage per job and product: whole window, current week, previous week.

    Weeks and baselines look back as far as they need, however short the window is, so one pass
    over ``max(days, 30)`` days serves them all; only the totals are cut to the window.
    """
    zero = F.lit(0).cast("decimal(18,5)")

    def total_when(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("dbus")).otherwise(zero)).alias(name)

    return (
        daily_job_sku(usage, as_of, max(days, BASELINE_DAYS))
        .groupBy(*JOB_KEY, "sku_name")
        .agg(
            total_when(since(as_of, days), "total_dbus"),
            total_when(in_current_week(as_of), "current_7d"),
            total_when(in_previous_week(as_of), "prev_7d"),
        )
        .filter("total_dbus <> 0")
    )


def cost_job(usage: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Totals per job with the products behind them as ``name:quantity`` text, sorted by name."""
    return (
        cost_job_sku(usage, as_of, days)
        .groupBy(*JOB_KEY)
        .agg(
            F.sum("total_dbus").alias("total_dbus_30d"),
            F.sum("current_7d").alias("current_7d_dbus"),
            F.sum("prev_7d").alias("prev_7d_dbus"),
            F.array_join(
                F.sort_array(
                    F.collect_list(
                        F.concat_ws(":", "sku_name", F.col("total_dbus").cast("decimal(28,5)").cast("string"))
                    )
                ),
                ",",
            ).alias("sku_breakdown"),
        )
    )


def cost_trend(usage: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Current week against the week before, per job."""
    return cost_job(usage, as_of, days).select(
        *JOB_KEY,
        F.col("current_7d_dbus").cast("double").alias("current_7d_dbus"),
        F.col("prev_7d_dbus").cast("double").alias("prev_7d_dbus"),
        trend_percent(F.col("current_7d_dbus"), F.col("prev_7d_dbus")).alias("trend_7d_percent"),
    )


def cost_baseline(usage: DataFrame, as_of: date, days: int = 30, positive_only: bool = False) -> DataFrame:
    """p90 of the daily net usage of every job with at least five usage days.

    Days that net to zero do not count; ``positive_only`` also leaves out negative days.
    """
    return baseline_of(daily_job(usage, as_of, days), positive_only)


def baseline_of(daily: DataFrame, positive_only: bool = False) -> DataFrame:
    per_job = (
        daily.filter("dbus > 0" if positive_only else "dbus <> 0")
        .groupBy(*JOB_KEY)
        .agg(
            F.sort_array(F.collect_list(F.col("dbus").cast("double"))).alias("days_used"),
            F.count(F.lit(1)).alias("usage_days"),
        )
        .filter(F.col("usage_days") >= MIN_BASELINE_DAYS)
    )
    found = percentile_of(per_job, "days_used", 0.9, "baseline_p90_dbus")
    return found.select(*JOB_KEY, "baseline_p90_dbus", "usage_days")


def cost_by_sku(usage: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Share of each product category in the total of its job, for jobs with a positive total."""
    by_category = (
        cost_job_sku(usage, as_of, days)
        .groupBy(*JOB_KEY, sku_category(F.col("sku_name")).alias("sku_category"))
        .agg(F.sum("total_dbus").alias("category_dbus"))
    )
    totals = by_category.groupBy(*JOB_KEY).agg(F.sum("category_dbus").alias("job_dbus")).filter("job_dbus > 0")
    share = F.col("category_dbus").cast("double") / F.col("job_dbus").cast("double") * 100
    return join_jobs(by_category, totals).select(
        *JOB_KEY,
        "sku_category",
        F.col("category_dbus").cast("double").alias("total_dbus"),
        rounded(share, 1).alias("percentage"),
    )


def parse_sku_breakdown(costs: DataFrame) -> DataFrame:
    """``name:quantity,...`` text back to rows; parts without a usable quantity are skipped."""
    part = F.col("part")
    return (
        costs.select(*JOB_KEY, F.explode(F.split("sku_breakdown", ",")).alias("part"))
        .filter(part.contains(":"))
        .select(
            *JOB_KEY,
            F.substring_index(part, ":", 1).alias("sku_name"),
            F.expr("substr(part, instr(part, ':') + 1)").try_cast("double").alias("dbus"),
        )
        .filter("dbus IS NOT NULL")
        .withColumn("sku_category", sku_category(F.col("sku_name")))
    )


def job_costs(usage: DataFrame, jobs: DataFrame, as_of: date, days: int = 30, dbu_rate: float = 0.0) -> DataFrame:
    """The cost table: totals, trend, baseline, spike flag, team and dollars per job.

    Trends always look back 14 days and baselines 30, however short or long ``days`` is.
    """
    totals = cost_job(usage, as_of, days)
    current = F.col("current_7d_dbus").cast("double")
    total = F.col("total_dbus_30d").cast("double")
    dollars = total * dbu_rate if dbu_rate > 0 else F.lit(None).cast("double")
    by_sku = daily_job_sku(usage, as_of, max(days, BASELINE_DAYS)).filter(since(as_of, BASELINE_DAYS))
    by_day = by_sku.groupBy(*JOB_KEY, "usage_date").agg(F.sum("dbus").alias("dbus"))
    joined = join_jobs(totals, baseline_of(by_day), "left")
    return with_job_names(joined, jobs, team=True).select(
        *JOB_KEY,
        "job_name",
        "team",
        total.alias("total_dbus_30d"),
        current.alias("current_7d_dbus"),
        F.col("prev_7d_dbus").cast("double").alias("prev_7d_dbus"),
        trend_percent(F.col("current_7d_dbus"), F.col("prev_7d_dbus")).alias("trend_7d_percent"),
        "sku_breakdown",
        "baseline_p90_dbus",
        spiking(current, F.col("baseline_p90_dbus")).alias("is_anomaly"),
        dollars.alias("total_cost_dollars"),
    )


def top_cost_jobs(costs: DataFrame, limit: int = 500) -> DataFrame:
    return costs.orderBy(F.col("total_dbus_30d").desc(), *JOB_KEY).limit(limit)


def team_costs(costs: DataFrame, dbu_rate: float = 0.0) -> DataFrame:
    """Totals per team; the team trend weights every job's trend by its total.

    Jobs without a trend do not weigh in. The weights are decimal, so the sums do not depend
    on the order in which rows arrive.
    """
    weight = F.col("total_dbus_30d").cast("decimal(28,5)")
    trend = F.col("trend_7d_percent").cast("decimal(18,1)")
    moving = F.col("trend_7d_percent") != 0
    zero = F.lit(0)
    sums = costs.groupBy(F.coalesce("team", F.lit(UNTAGGED)).alias("team")).agg(
        F.sum(weight).alias("total"),
        F.count(F.lit(1)).alias("job_count"),
        F.sum(F.when(moving, weight * trend).otherwise(zero)).alias("weighted"),
        F.sum(F.when(moving, weight).otherwise(zero)).alias("base"),
    )
    total = F.col("total").cast("double")
    change = F.col("weighted").cast("double") / F.col("base").cast("double")
    return sums.select(
        "team",
        total.alias("total_dbus_30d"),
        "job_count",
        rounded(F.when(F.col("base") > 0, change).otherwise(0.0), 1).alias("trend_7d_percent"),
        (total * dbu_rate if dbu_rate > 0 else F.lit(None).cast("double")).alias("total_cost_dollars"),
    )


def team_and_total_costs(costs: DataFrame, dbu_rate: float = 0.0) -> DataFrame:
    """``team_costs`` and the grand total from one pass: grouping sets, where ``is_total`` tells the total from a team."""
    weight = F.col("total_dbus_30d").cast("decimal(28,5)")
    trend = F.col("trend_7d_percent").cast("decimal(18,1)")
    moving = F.col("trend_7d_percent") != 0
    named = costs.withColumn("team", F.coalesce("team", F.lit(UNTAGGED)))
    sums = named.rollup("team").agg(
        F.grouping_id().alias("level"),
        F.sum(weight).alias("total"),
        F.count(F.lit(1)).alias("job_count"),
        F.sum(F.when(moving, weight * trend).otherwise(F.lit(0))).alias("weighted"),
        F.sum(F.when(moving, weight).otherwise(F.lit(0))).alias("base"),
    )
    total = F.coalesce(F.col("total").cast("double"), F.lit(0.0))
    change = F.col("weighted").cast("double") / F.col("base").cast("double")
    return sums.select(
        "team",
        (F.col("level") == 1).alias("is_total"),
        total.alias("total_dbus_30d"),
        "job_count",
        rounded(F.when(F.col("base") > 0, change).otherwise(0.0), 1).alias("trend_7d_percent"),
        (total * dbu_rate if dbu_rate > 0 else F.lit(None).cast("double")).alias("total_cost_dollars"),
    )


def cost_totals(costs: DataFrame, dbu_rate: float = 0.0) -> DataFrame:
    total = F.coalesce(F.sum(F.col("total_dbus_30d").cast("decimal(28,5)")).cast("double"), F.lit(0.0))
    return costs.agg(total.alias("total_dbus_30d"), F.count(F.lit(1)).alias("total_jobs_count")).select(
        "total_dbus_30d",
        "total_jobs_count",
        (F.col("total_dbus_30d") * dbu_rate if dbu_rate > 0 else F.lit(None).cast("double")).alias(
            "total_cost_dollars"
        ),
    )


def month_usage(usage: DataFrame, as_of: date) -> DataFrame:
    """Net usage since the first of the month, where positive.

    The month to date never starts before the 30-day window, so it is summed from the same
    daily totals the other cost results use.
    """
    in_month = F.col("usage_date") >= F.lit(as_of.replace(day=1))
    month = F.when(in_month, F.col("dbus")).otherwise(F.lit(0).cast("decimal(18,5)"))
    return (
        daily_job(usage, as_of, 30).groupBy(*JOB_KEY).agg(F.sum(month).alias("month_dbus")).filter("month_dbus > 0")
    )


def cost_spikes(
    usage: DataFrame,
    jobs: DataFrame | None,
    as_of: date,
    factor: float = SPIKE_FACTOR,
    unit: str = "week_sum",
    limit: int | None = None,
) -> DataFrame:
    """Jobs whose current week exceeds ``factor`` times their p90 day, worst first.

    ``unit='daily_mean'`` compares the mean day of the week instead of its sum. Without
    ``jobs`` the result carries no names.
    """
    if unit not in ("week_sum", "daily_mean"):
        raise ValueError(f"unknown unit {unit!r}")
    day = F.when(F.col("dbus") > 0, F.col("dbus").cast("double"))
    weekly = F.when(in_current_week(as_of), F.col("dbus")).otherwise(F.lit(0).cast("decimal(18,5)"))
    per_job = (
        daily_job(usage, as_of, 30)
        .groupBy(*JOB_KEY)
        .agg(
            F.sum(weekly).alias("week"),
            F.sort_array(F.collect_list(day)).alias("days_used"),
            F.count(day).alias("usage_days"),
        )
        .filter((F.col("week") > 0) & (F.col("usage_days") >= MIN_BASELINE_DAYS))
    )
    per_job = percentile_of(per_job, "days_used", 0.9, "baseline_p90_dbus")
    measure = F.col("week").cast("double")
    measure = measure / WEEK_DATES if unit == "daily_mean" else measure
    spikes = (
        per_job.withColumn("current_dbus", measure)
        .filter(spiking(F.col("current_dbus"), F.col("baseline_p90_dbus"), factor))
        .withColumn("multiplier", F.col("current_dbus") / F.nullif(F.col("baseline_p90_dbus"), F.lit(0.0)))
    )
    if limit is not None:
        spikes = spikes.orderBy(rounded(F.col("multiplier"), 9).desc(), *JOB_KEY).limit(limit)
    columns = [*JOB_KEY, "current_dbus", "baseline_p90_dbus", "multiplier"]
    if jobs is None:
        return spikes.select(*columns)
    return with_job_names(spikes, jobs).select(*columns[:2], "job_name", *columns[2:])


def zombie_jobs(
    usage: DataFrame, runs: DataFrame, jobs: DataFrame, as_of: date, days: int = 30, limit: int | None = None
) -> DataFrame:
    """Jobs above 10 DBU with no successful run, or above 5 DBU per run."""
    from .health import run_stats

    costs = (
        daily_job(usage, as_of, days)
        .groupBy(*JOB_KEY)
        .agg(F.sum("dbus").alias("total"))
        .filter(F.col("total") > ZOMBIE_MIN_DBUS)
    )
    output = run_stats(runs, as_of, days).select(
        *JOB_KEY, F.col("total_runs").alias("run_count"), "success_count"
    )
    zero = F.lit(0).cast("long")
    joined = (
        join_jobs(costs, output, "left")
        .withColumn("run_count", F.coalesce("run_count", zero))
        .withColumn("success_count", F.coalesce("success_count", zero))
        .withColumn("total_dbus", F.col("total").cast("double"))
    )
    found = joined.filter(little_output(F.col("total_dbus")))
    if limit is not None:
        found = found.orderBy(F.col("total_dbus").desc(), *JOB_KEY).limit(limit)
    return with_job_names(found, jobs).select(*JOB_KEY, "job_name", "total_dbus", "run_count", "success_count")


def little_output(total: Column) -> Column:
    """More than 10 DBU, and no successful run or more than 5 DBU per run."""
    per_run = total / F.nullif(F.col("run_count").cast("double"), F.lit(0.0))
    return (total > ZOMBIE_MIN_DBUS) & (
        (F.col("success_count") == 0) | F.coalesce(per_run > ZOMBIE_DBUS_PER_RUN, F.lit(False))
    )
