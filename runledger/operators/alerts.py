"""The five alert generators. All return the same columns, one row per alert."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wording
from ..functions.asof import last_change
from ..functions.keys import JOB_KEY, condition_key
from ..functions.load import worker_utilization
from ..functions.numbers import fixed_text, rounded, whole_text
from ..functions.states import PRIORITY_ORDER, rank_of
from ..functions.timing import elapsed_seconds, moment_like, stamp_text
from ..functions.wording import fill
from .cost import cost_spikes, month_usage
from .health import run_stats_with_last
from .jobs import BUDGET_TAG, SLA_TAG, latest_jobs, tag_int, tag_number, with_job_names
from .utilization import run_dbu_rate

ALERT_COLUMNS = [
    "alert_id",
    *JOB_KEY,
    "job_name",
    "category",
    "severity",
    "title",
    "description",
    "remediation",
    "condition_key",
]
CATEGORIES = ["failure", "sla", "cost", "cluster"]
ACK_HOURS = 24


def _alert(
    df: DataFrame,
    jobs: DataFrame | None,
    category: str,
    severity: Column,
    title: Column,
    description: Column,
    remediation: Column,
    condition: Column,
    identity: Column | None = None,
) -> DataFrame:
    """Alert columns of ``df``; names are left out where the caller adds them to a whole union."""
    suffix = F.lower(severity) if identity is None else identity
    unnamed = df.select(
        condition_key(category, suffix).alias("alert_id"),
        *JOB_KEY,
        F.lit(category).alias("category"),
        severity.alias("severity"),
        title.alias("title"),
        description.alias("description"),
        remediation.alias("remediation"),
        condition_key(category, condition).alias("condition_key"),
    )
    return unnamed if jobs is None else named(unnamed, jobs)


def named(alerts: DataFrame, jobs: DataFrame) -> DataFrame:
    return with_job_names(alerts, jobs).select(*ALERT_COLUMNS)


def failure_alerts(runs: DataFrame, jobs: DataFrame | None, as_of: date, days: int = 7) -> DataFrame:
    """Two failures in a row, a failed last run, or a success rate of 70 to 89.9 percent."""
    last, previous, rate = F.col("last_failed"), F.col("previous_failed"), F.col("success_rate")
    hits = run_stats_with_last(runs, as_of, days, reasons=True).filter(last | rate.between(70, 89.9))
    percent_text = fixed_text(rate, 1)
    when = stamp_text(F.col("last_run_time"))
    both = last & previous
    severity = F.when(both, "P1").when(last, "P2").otherwise("P3")
    title = (
        F.when(both, "2+ consecutive failures")
        .when(last, "Recent failure")
        .otherwise(fill("Success rate at {rate}%", rate=percent_text))
    )
    description = (
        F.when(both, fill("Job has failed 2+ times in a row. Most recent failure at {when}.", when=when))
        .when(last, fill("Job failed at {when}. Success rate: {rate}%.", when=when, rate=percent_text))
        .otherwise("Job is in yellow zone (70-89% success rate). May need attention.")
    )
    condition = F.when(both, "consecutive").when(last, "single").otherwise("yellow")
    advice = wording.failure_remediation(F.col("failure_reasons"))
    return _alert(hits, jobs, "failure", severity, title, description, advice, condition)


def sla_alerts(active: DataFrame, jobs: DataFrame, as_of_ts: datetime, names: bool = True) -> DataFrame:
    """Running jobs at 80 percent of their SLA or beyond.

    One alert per run; the feed later keeps one per condition.
    """
    targets = (
        latest_jobs(jobs).select(*JOB_KEY, tag_int(SLA_TAG).alias("sla_minutes")).filter("sla_minutes > 0")
    )
    seconds = elapsed_seconds(F.col("start_time"), moment_like(active, "start_time", as_of_ts))
    late = (
        active.filter(F.col("start_time").isNotNull())
        .select(*JOB_KEY, "run_id", seconds.alias("elapsed"))
        .join(targets, JOB_KEY)
        .withColumn("pct", F.col("elapsed") * 100.0 / (F.col("sla_minutes") * 60))
        .filter("pct >= 80")
    )
    breached = F.col("pct") >= 100
    target = F.col("sla_minutes").cast("string")
    left = whole_text((F.col("sla_minutes") * 60 - F.col("elapsed")) / 60)
    severity = F.when(breached, "P1").otherwise("P2")
    title = F.when(breached, fill("SLA breached ({m}m target)", m=target)).otherwise(
        fill("SLA breach risk ({pct}% of window)", pct=whole_text(F.col("pct")))
    )
    description = F.when(
        breached,
        fill(
            "Job has been running for {min} minutes, exceeding {m} minute SLA.",
            min=whole_text(F.col("elapsed") / 60),
            m=target,
        ),
    ).otherwise(
        fill(
            "Job at {pct}% of SLA window ({m}m). ~{left} minutes remaining.",
            pct=whole_text(F.col("pct")),
            m=target,
            left=left,
        )
    )
    advice = wording.sla_remediation(F.col("pct"), F.col("sla_minutes"))
    condition = F.when(breached, "breach").otherwise("risk")
    return _alert(late, jobs if names else None, "sla", severity, title, description, advice, condition)


def spike_alerts(
    usage: DataFrame, jobs: DataFrame | None, as_of: date, limit: int | None = None
) -> DataFrame:
    spikes = cost_spikes(usage, None, as_of, limit=limit)
    times, base = fixed_text(F.col("multiplier"), 1), fixed_text(F.col("baseline_p90_dbus"), 1)
    return _alert(
        spikes,
        jobs,
        "cost",
        F.lit("P2"),
        fill("Cost spike ({x}x baseline)", x=times),
        fill(
            "Current 7-day cost ({now} DBUs) is {x}x higher than p90 baseline ({base} DBUs).",
            now=fixed_text(F.col("current_dbus"), 1),
            x=times,
            base=base,
        ),
        wording.spike_remediation(F.col("multiplier"), F.col("baseline_p90_dbus")),
        F.lit("spike"),
        F.lit("spike"),
    )


def budget_alerts(usage: DataFrame, jobs: DataFrame, as_of: date, names: bool = True) -> DataFrame:
    """Current jobs with a budget tag at 80 percent of it or beyond in this month."""
    budgets = latest_jobs(jobs).select(*JOB_KEY, tag_number(BUDGET_TAG).alias("budget")).filter("budget > 0")
    spent = (
        budgets.join(month_usage(usage, as_of), JOB_KEY, "left")
        .withColumn("used", F.coalesce(F.col("month_dbus").cast("double"), F.lit(0.0)))
        .withColumn("pct", F.col("used") / F.col("budget") * 100)
        .filter("pct >= 80")
    )
    over = F.col("pct") >= 100
    pct = fixed_text(F.col("pct"), 0)
    used, budget = fixed_text(F.col("used"), 1), fixed_text(F.col("budget"), 1)
    return _alert(
        spent,
        jobs if names else None,
        "cost",
        F.when(over, "P1").otherwise("P2"),
        F.when(over, fill("Budget exceeded ({p}%)", p=pct)).otherwise(fill("Approaching budget ({p}%)", p=pct)),
        F.when(
            over, fill("Monthly usage ({u} DBUs) exceeds budget ({b} DBUs).", u=used, b=budget)
        ).otherwise(fill("Monthly usage ({u} DBUs) at {p}% of budget ({b} DBUs).", u=used, p=pct, b=budget)),
        wording.budget_remediation(F.col("pct")),
        F.when(over, "budget_exceeded").otherwise("budget_approaching"),
        F.lit("budget"),
    )


def overprovision_alerts(
    runs: DataFrame,
    usage: DataFrame,
    jobs: DataFrame | None,
    as_of: date,
    threshold: float = 1.0,
    limit: int | None = None,
) -> DataFrame:
    """Jobs below ``threshold`` DBU per hour over at least three runs."""
    rates = run_dbu_rate(runs, usage, as_of).filter(F.col("avg_dbus_per_hour") < threshold)
    if limit is not None:
        rates = rates.orderBy(rounded(F.col("avg_dbus_per_hour"), 9).asc(), *JOB_KEY).limit(limit)
    estimate = F.coalesce(worker_utilization(F.col("avg_dbus_per_hour")), F.lit(20.0))
    low = rates.withColumn("utilization", estimate)
    pct, analyzed = fixed_text(F.col("utilization"), 0), F.col("runs_analyzed").cast("string")
    return _alert(
        low,
        jobs,
        "cluster",
        F.lit("P3"),
        fill("Over-provisioned (~{p}% utilization)", p=pct),
        fill(
            "Cluster running at ~{p}% utilization across {n} recent runs. Resources may be underutilized.",
            p=pct,
            n=analyzed,
        ),
        wording.cluster_remediation(F.col("utilization"), F.col("runs_analyzed")),
        F.lit("overprov"),
        F.lit("overprov"),
    )


def severity_rank(column: str = "severity") -> Column:
    return rank_of(F.col(column), PRIORITY_ORDER)


def dedupe_alerts(alerts: DataFrame) -> DataFrame:
    """One alert per condition, the most severe; texts decide between equals.

    ``min`` over a struct combines on the map side, so a condition with a third of all
    rows reaches its final task as one row per map task.
    """
    rest = [c for c in alerts.columns if c not in ("condition_key", "severity")]
    best = F.min(F.struct(severity_rank().alias("rank"), "severity", *rest))
    return (
        alerts.groupBy("condition_key").agg(best.alias("best")).select("best.*", "condition_key").select(*alerts.columns)
    )


def acknowledge(alerts: DataFrame, acks: DataFrame, as_of_ts: datetime) -> DataFrame:
    """Marks alerts whose condition was acknowledged within the last 24 hours.

    An acknowledgement exactly 24 hours old still counts.
    """
    now = moment_like(acks, "acknowledged_at", as_of_ts)
    valid = (
        acks.filter(F.col("acknowledged_at") >= now - F.make_dt_interval(hours=F.lit(ACK_HOURS)))
        .groupBy("condition_key")
        .agg(F.max("acknowledged_at").alias("acknowledged_at"))
    )
    return alerts.join(valid, "condition_key", "left").withColumn("acknowledged", F.col("acknowledged_at").isNotNull())


def acknowledge_history(alerts: DataFrame, acks: DataFrame, parts: int = 1) -> DataFrame:
    """Marks alerts, each at its own ``raised_at``, whose condition had an acknowledgement in force at that time.

    In force is the newest acknowledgement at or before the alert if it is 24 hours old at most.
    A condition may have any number of alerts and acknowledgements; those of a hot one are
    spread by day, and over ``parts`` tasks each.
    """
    found = last_change(alerts, acks, ["condition_key"], "raised_at", "acknowledged_at", [], parts=parts)
    at = F.col("in_force.acknowledged_at")
    valid = at >= F.col("raised_at").cast("timestamp") - F.make_dt_interval(hours=F.lit(ACK_HOURS))
    return found.withColumn("acknowledged_at", F.when(valid, at)).withColumn("acknowledged", F.col("acknowledged_at").isNotNull()).drop("in_force")


def filter_alerts(
    alerts: DataFrame,
    severity: list[str] | None = None,
    category: list[str] | None = None,
    acknowledged: bool | None = None,
    workspace_id: int | None = None,
    job_id: int | None = None,
) -> DataFrame:
    if severity:
        alerts = alerts.filter(F.col("severity").isin([s.upper() for s in severity]))
    if category:
        alerts = alerts.filter(F.col("category").isin([c.lower() for c in category]))
    if acknowledged is not None:
        alerts = alerts.filter(F.col("acknowledged") == F.lit(acknowledged))
    if workspace_id is not None:
        alerts = alerts.filter(F.col("workspace_id") == F.lit(workspace_id).cast("long"))
    if job_id is not None:
        alerts = alerts.filter(F.col("job_id") == F.lit(job_id).cast("long"))
    return alerts


def search_alerts(alerts: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of name, title, description or category."""
    if not text.strip():
        return alerts
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for column in ("job_name", "title", "description", "category"):
        hit = hit | F.lower(column).contains(needle)
    return alerts.filter(hit)


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == level).alias(f"{level.lower()}_count") for level in PRIORITY_ORDER],
    )


def unacknowledged_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(~F.col("acknowledged")).alias("unacknowledged"))


def highest_severity(alerts: DataFrame) -> DataFrame:
    """Most severe level and number of alerts per job."""
    return alerts.groupBy(*JOB_KEY).agg(
        F.min("severity").alias("highest_severity"), F.count(F.lit(1)).alias("alert_count")
    )
