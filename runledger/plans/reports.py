"""Data of the periodic reports, over all jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import (
    delta_text,
    dollars_text,
    duration_text,
    multiple_text,
    trend_text,
    usage_text,
)
from ..functions.keys import JOB_KEY
from ..functions.numbers import rounded, trend_percent
from ..operators.alerts import alert_counts
from ..operators.cost import cost_totals
from ..operators.ordering import alert_order
from .health import mean_rate

# Rate used for savings where none is set, and the shares taken as savings.
FALLBACK_DBU_RATE = 0.07
SAVINGS_SHARE = 0.10
RIGHT_SIZING_SHARE = 0.05
ZOMBIE_SHARE = 0.03


def report_daily(health: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: jobs per status, mean success rate, unacknowledged P1 and P2 alerts."""
    status = F.col("status")
    jobs = health.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(status == "green").alias("healthy_count"),
        F.count_if(status == "yellow").alias("warning_count"),
        F.count_if(status == "red").alias("critical_count"),
        rounded(F.coalesce(mean_rate(), F.lit(0.0)), 1).alias("overall_success_rate"),
    )
    open_alerts = alerts.filter("NOT acknowledged").agg(
        F.count_if(F.col("severity") == "P1").alias("open_p1_alerts"),
        F.count_if(F.col("severity") == "P2").alias("open_p2_alerts"),
    )
    return one_row(jobs, open_alerts)


def report_daily_alerts(alerts: DataFrame) -> DataFrame:
    """The unacknowledged P1 and P2 alerts named in the daily report."""
    return alerts.filter("NOT acknowledged AND severity IN ('P1', 'P2')").select(
        "severity", "job_name", "title", "remediation", "condition_key"
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Several global aggregates as one row: their rows are stacked and folded, nothing is joined."""
    stacked = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def report_weekly_teams(teams: DataFrame) -> DataFrame:
    """Every team with its share of all usage; the total is a scalar subquery."""
    total = teams.agg(F.sum(F.col("total_dbus_30d").cast("decimal(28,5)")).cast("double").alias("total")).scalar()
    share = F.col("total_dbus_30d") / F.nullif(F.col("total"), F.lit(0.0)) * 100
    return teams.withColumn("total", total).select(
        "team",
        "total_dbus_30d",
        "job_count",
        rounded(F.coalesce(share, F.lit(0.0)), 2).alias("percent_of_total"),
        "trend_7d_percent",
    )


def report_weekly(costs: DataFrame, anomalies: DataFrame, limit: int = 10) -> DataFrame:
    """Rows of the weekly report by section: spikes with their factor, zombies, top jobs."""
    section = F.when(F.col("anomaly_type") == "cost_spike", "spike").otherwise(F.col("anomaly_type"))
    found = anomalies.select(
        section.alias("section"), *JOB_KEY, "job_name", F.col("current_dbus").alias("dbus"), F.col("multiplier").alias("factor")
    )
    top = (
        costs.orderBy(F.col("total_dbus_30d").desc(), *JOB_KEY)
        .limit(limit)
        .select(
            F.lit("top").alias("section"), *JOB_KEY, "job_name", F.col("total_dbus_30d").alias("dbus"),
            F.lit(None).cast("double").alias("factor"),
        )
    )
    return found.unionByName(top)


def report_monthly(health: DataFrame, costs: DataFrame, dbu_rate: float = 0.0) -> DataFrame:
    """One row: runs, jobs, usage, reliability, and savings estimates in money."""
    rate = dbu_rate or FALLBACK_DBU_RATE
    runs = health.agg(
        F.coalesce(F.sum("total_runs"), F.lit(0).cast("long")).alias("total_runs"),
        F.count(F.lit(1)).alias("total_jobs"),
        rounded(F.coalesce(mean_rate(), F.lit(0.0)), 2).alias("reliability_percent"),
    )
    usage = cost_totals(costs).select("total_dbus_30d")
    return one_row(runs, usage).select(
        "total_runs",
        "total_jobs",
        "reliability_percent",
        F.col("total_dbus_30d").alias("total_dbus"),
        rounded(F.col("total_dbus_30d") * (SAVINGS_SHARE * rate), 2).alias("potential_savings"),
        rounded(F.col("total_dbus_30d") * (RIGHT_SIZING_SHARE * rate), 0).alias("right_sizing_savings"),
        rounded(F.col("total_dbus_30d") * (ZOMBIE_SHARE * rate), 0).alias("zombie_savings"),
    )


def report_monthly_teams(teams: DataFrame, limit: int = 5) -> DataFrame:
    """The largest teams with their share of all usage."""
    return report_weekly_teams(teams).orderBy(F.col("total_dbus_30d").desc(), "team").limit(limit)


def dashboard(health: DataFrame, alerts: DataFrame, costs: DataFrame) -> DataFrame:
    """Headline numbers in one row, and the keys of the five most urgent alerts."""
    jobs = health.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("priority") == "P1").alias("critical_jobs"),
        rounded(F.coalesce(mean_rate(), F.lit(0.0)), 1).alias("avg_success_rate"),
    )
    counts = alert_counts(alerts).select(
        F.col("total").alias("total_alerts"), F.col("p1_count").alias("critical_alerts")
    )
    first = (
        alerts.orderBy(*alert_order())
        .limit(5)
        .agg(F.array_join(F.sort_array(F.collect_list("condition_key")), ",").alias("recent_alerts"))
    )
    spent = cost_totals(costs).select(F.col("total_dbus_30d").alias("total_cost"))
    return one_row(jobs, counts, spent, first)


def formatted_report(costs: DataFrame, durations: DataFrame, dbu_rate: float) -> DataFrame:
    """Cost table with display text for usage, money, trend and typical duration."""
    joined = costs.join(
        durations.select(*JOB_KEY, "median_duration_seconds", "max_duration_seconds"), JOB_KEY, "left"
    )
    dollars = F.col("total_dbus_30d") * dbu_rate
    change = trend_percent(F.col("current_7d_dbus"), F.col("prev_7d_dbus"))
    return joined.select(
        *JOB_KEY,
        usage_text(F.col("total_dbus_30d")).alias("usage"),
        dollars_text(dollars).alias("cost"),
        trend_text(change).alias("trend"),
        delta_text(change).alias("delta"),
        duration_text(F.col("median_duration_seconds")).alias("median_duration"),
        multiple_text(F.col("max_duration_seconds"), F.col("median_duration_seconds")).alias("slowest"),
    )
