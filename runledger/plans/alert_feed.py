"""The alert feed: generators, union, one alert per condition, acknowledgements."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.timing import moment_like
from ..operators import alerts as A


def all_alerts(
    runs: DataFrame,
    usage: DataFrame,
    jobs: DataFrame,
    active: DataFrame,
    as_of: date,
    as_of_ts: datetime,
    categories: list[str] | None = None,
) -> DataFrame:
    """Union of the requested generators; the others are not even planned.

    Names are joined to the union once. All usage-based generators start from the same daily
    totals, whose shuffle is planned once and reused.
    """
    wanted = {c.lower() for c in categories} if categories else set(A.CATEGORIES)
    unknown = wanted - set(A.CATEGORIES)
    if unknown:
        raise ValueError(f"unknown categories {sorted(unknown)}")
    parts: list[DataFrame] = []
    if "failure" in wanted:
        parts.append(A.failure_alerts(runs, None, as_of))
    if "sla" in wanted:
        parts.append(A.sla_alerts(active, jobs, as_of_ts, names=False))
    if "cost" in wanted:
        parts.append(A.spike_alerts(usage, None, as_of))
        parts.append(A.budget_alerts(usage, jobs, as_of, names=False))
    if "cluster" in wanted:
        parts.append(A.overprovision_alerts(runs, usage, None, as_of))
    return A.named(reduce(DataFrame.unionByName, parts), jobs)


def alert_feed(
    runs: DataFrame,
    usage: DataFrame,
    jobs: DataFrame,
    active: DataFrame,
    acks: DataFrame,
    as_of: date,
    as_of_ts: datetime,
    categories: list[str] | None = None,
    severity: list[str] | None = None,
    acknowledged: bool | None = None,
    workspace_id: int | None = None,
) -> DataFrame:
    """Current alerts with their acknowledgement, filtered; order and page with ``ordering``."""
    generated = all_alerts(runs, usage, jobs, active, as_of, as_of_ts, categories)
    marked = A.acknowledge(A.dedupe_alerts(generated), acks, as_of_ts)
    marked = marked.withColumn("created_at", moment_like(acks, "acknowledged_at", as_of_ts))
    return A.filter_alerts(marked, severity=severity, acknowledged=acknowledged, workspace_id=workspace_id)
