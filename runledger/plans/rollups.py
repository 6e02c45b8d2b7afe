"""Rollup tables: writing, schema evolution, reading, freshness."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY, in_workspace
from ..functions.states import PRIORITY_ORDER, rank_of
from ..operators.alerts import failure_alerts, named, spike_alerts
from ..operators.cost import job_costs
from ..operators.ordering import health_order
from .health import health_rollup

STALE_AFTER = timedelta(hours=1)
HEALTH, COST, ALERTS = "job_health", "cost", "alerts"


def _moment(value: datetime) -> Column:
    """Wall-clock time of the session's zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp")


def with_refresh_time(df: DataFrame, refreshed_at: datetime) -> DataFrame:
    return df.withColumn("refreshed_at", _moment(refreshed_at))


def alerts_rollup(runs: DataFrame, usage: DataFrame, jobs: DataFrame, as_of: date) -> DataFrame:
    """Failure and spike alerts, whole; the remaining categories depend on live state."""
    return named(failure_alerts(runs, None, as_of).unionByName(spike_alerts(usage, None, as_of)), jobs)


def build(runs: DataFrame, usage: DataFrame, jobs: DataFrame, as_of: date, refreshed_at: datetime) -> dict[str, DataFrame]:
    tables = {
        HEALTH: health_rollup(runs, jobs, as_of),
        COST: job_costs(usage, jobs, as_of).drop("team", "total_cost_dollars"),
        ALERTS: alerts_rollup(runs, usage, jobs, as_of),
    }
    return {name: with_refresh_time(df, refreshed_at) for name, df in tables.items()}


def ensure_namespace(spark: SparkSession, namespace: str, location: str | None = None) -> None:
    """``location`` keeps its tables out of the warehouse folder."""
    place = "" if location is None else f" LOCATION '{location}'"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {namespace}{place}")


def refresh(tables: dict[str, DataFrame], base_path: str) -> dict[str, int]:
    """Full overwrite of each rollup; rows are counted while writing, not by a second job."""
    counts = {}
    for name, df in tables.items():
        seen = Observation(f"rollup_{name}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{base_path}/{name}")
        counts[name] = seen.get["rows"]
    return counts


def refresh_tables(
    spark: SparkSession, tables: dict[str, DataFrame], namespace: str, fmt: str = "parquet", location: str | None = None, buckets: int | None = None
) -> dict[str, int]:
    """The same into catalog tables, creating the namespace first.

    With ``buckets`` tables with a job key are hashed and sorted by it, so that joins and aggregates by
    job over one or several of them need no shuffle.
    """
    ensure_namespace(spark, namespace, location)
    counts = {}
    for name, df in tables.items():
        seen = Observation(f"table_{name}")
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        if buckets and set(JOB_KEY) <= set(df.columns):
            writer = observed.repartition(buckets, *JOB_KEY).write.bucketBy(buckets, *JOB_KEY).sortBy(*JOB_KEY)
        else:
            writer = observed.write
        writer.format(fmt).mode("overwrite").option("overwriteSchema", "true").saveAsTable(f"{namespace}.{name}")
        counts[name] = seen.get["rows"]
    return counts


def read_rollup(spark: SparkSession, base_path: str, name: str) -> DataFrame:
    """Reads a rollup whose files may have been written under different schemas."""
    return spark.read.option("mergeSchema", "true").parquet(f"{base_path}/{name}")


def evolve(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of old and new layout; columns missing on one side become NULL."""
    return existing.unionByName(incoming, allowMissingColumns=True)


def read_health(rollup: DataFrame, days: int = 7) -> DataFrame:
    """Columns of one window for jobs that ran in it, worst first."""
    if days not in (7, 30):
        raise ValueError("the rollup holds windows of 7 and 30 days")
    chosen = rollup.filter(F.col(f"total_runs_{days}d") > 0).select(
        *JOB_KEY,
        "job_name",
        F.col(f"total_runs_{days}d").alias("total_runs"),
        F.col(f"success_count_{days}d").alias("success_count"),
        F.col(f"success_rate_{days}d").alias("success_rate"),
        "last_run_time",
        "last_duration_seconds",
        "priority",
        "retry_count",
        "median_duration_seconds",
        "p90_duration_seconds",
        "avg_duration_seconds",
        "max_duration_seconds",
    )
    return chosen.orderBy(*health_order())


def read_cost(rollup: DataFrame, limit: int | None = None) -> DataFrame:
    result = rollup.orderBy(F.col("total_dbus_30d").desc(), *JOB_KEY)
    return result if limit is None else result.limit(limit)


def read_alerts(rollup: DataFrame, workspace_id: str | int | None = None) -> DataFrame:
    return in_workspace(rollup, workspace_id).orderBy(rank_of(F.col("severity"), PRIORITY_ORDER), "condition_key")


def read_durations(rollup: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    chosen = rollup.select(
        *JOB_KEY,
        "median_duration_seconds",
        "p90_duration_seconds",
        "avg_duration_seconds",
        "max_duration_seconds",
        F.col("total_runs_30d").alias("run_count"),
    )
    return chosen if ids is None else chosen.join(ids.select(*JOB_KEY), JOB_KEY, "left_semi")


def freshness(rollup: DataFrame, now: datetime, stale_after: timedelta = STALE_AFTER) -> DataFrame:
    """Latest refresh and whether it is younger than ``stale_after``."""
    limit = _moment(now - stale_after)
    return rollup.agg(F.max("refreshed_at").alias("refreshed_at")).withColumn(
        "is_fresh", F.coalesce(F.col("refreshed_at") > limit, F.lit(False))
    )
