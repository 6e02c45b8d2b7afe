"""Total orders of the result tables, top-k and pages. Ids break every tie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY
from ..functions.states import PRIORITY_ORDER, rank_of

# Rank of states of active runs and of priorities, higher comes last.
STATE_RANK = {"RUNNING": 3, "PENDING": 2, "QUEUED": 2, "TERMINATING": 1}
PRIORITY_RANK = {"P1": 3, "P2": 2, "P3": 1}
# Jobs without a team sort after every real team name.
NO_TEAM = "zzz"


def _ranked(column: str, ranks: dict[str, int]) -> Column:
    expr = F.lit(0)
    for value, rank in ranks.items():
        expr = F.when(F.col(column) == value, rank).otherwise(expr)
    return expr


def _name(column: str) -> Column:
    return F.lower(F.col(column))


JOB_SORTS = {
    "job_name": lambda: _name("job_name"),
    "success_rate": lambda: F.col("success_rate"),
    "priority": lambda: _ranked("priority", PRIORITY_RANK),
    "sla_minutes": lambda: F.coalesce("sla_minutes", F.lit(0)),
    "last_run_time": lambda: F.col("last_run_time"),
    "retry_count": lambda: F.col("retry_count"),
}
ALERT_SORTS = {
    "severity": lambda: _ranked("severity", PRIORITY_RANK),
    "job_name": lambda: _name("job_name"),
    "category": lambda: F.col("category"),
    "created_at": lambda: F.col("created_at"),
    "title": lambda: _name("title"),
}
COST_SORTS = {
    "job_name": lambda: _name("job_name"),
    "team": lambda: F.coalesce(_name("team"), F.lit(NO_TEAM)),
    "total_dbus_30d": lambda: F.col("total_dbus_30d"),
    "trend_7d_percent": lambda: F.col("trend_7d_percent"),
}
TEAM_SORTS = {
    "team": lambda: _name("team"),
    "total_dbus_30d": lambda: F.col("total_dbus_30d"),
    "job_count": lambda: F.col("job_count"),
    "trend_7d_percent": lambda: F.col("trend_7d_percent"),
}
ACTIVE_SORTS = {
    "job_name": lambda: _name("job_name"),
    "state": lambda: _ranked("state", STATE_RANK),
    "start_time": lambda: F.col("start_time"),
    # A run that started later has run for a shorter time.
    "duration": lambda: -F.unix_micros(F.col("start_time").cast("timestamp")),
}


def sort_by(df: DataFrame, sorts: dict, column: str, direction: str, ties: list[str]) -> DataFrame:
    """Orders by one of the named sort keys, kept in the result as ``sort_key``."""
    if column not in sorts:
        raise ValueError(f"cannot sort by {column!r}; choose from {sorted(sorts)}")
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be 'asc' or 'desc'")
    keyed = df.withColumn("sort_key", sorts[column]())
    key = F.col("sort_key")
    return keyed.orderBy(key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last(), *ties)


def sort_jobs(jobs: DataFrame, column: str = "retry_count", direction: str = "desc") -> DataFrame:
    return sort_by(jobs, JOB_SORTS, column, direction, JOB_KEY)


def sort_alerts(alerts: DataFrame, column: str = "severity", direction: str = "desc") -> DataFrame:
    return sort_by(alerts, ALERT_SORTS, column, direction, ["condition_key"])


def sort_costs(costs: DataFrame, column: str = "total_dbus_30d", direction: str = "desc") -> DataFrame:
    return sort_by(costs, COST_SORTS, column, direction, JOB_KEY)


def sort_teams(teams: DataFrame, column: str = "total_dbus_30d", direction: str = "desc") -> DataFrame:
    return sort_by(teams, TEAM_SORTS, column, direction, ["team"])


def sort_active(active: DataFrame, column: str = "state", direction: str = "desc") -> DataFrame:
    return sort_by(active, ACTIVE_SORTS, column, direction, [*JOB_KEY, "run_id"])


def health_order(rate: str = "success_rate") -> list[Column]:
    """Worst first: P1, P2, P3, the rest, then by rising success rate."""
    return [
        rank_of(F.col("priority"), PRIORITY_ORDER).asc(),
        F.col(rate).asc_nulls_last(),
        *[F.col(k).asc() for k in JOB_KEY],
    ]


def alert_order() -> list[Column]:
    return [rank_of(F.col("severity"), PRIORITY_ORDER).asc(), F.col("condition_key").asc()]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of a total order, as a top-k followed by an offset.

    Every task keeps only its first ``number * size`` rows and no full sort takes place. Meant
    for first pages; ``page_after`` goes on from any row at the cost of a first page.
    """
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def health_keys() -> list[Column]:
    """What ``health_order`` sorts by, ascending; none of it is NULL in a health table."""
    return [rank_of(F.col("priority"), PRIORITY_ORDER), F.col("success_rate"), *[F.col(k) for k in JOB_KEY]]


def page_after(df: DataFrame, keys: list[Column], last: list, size: int) -> DataFrame:
    """The ``size`` rows that follow the one with the key values ``last`` in ascending order.

    However deep the page, tasks drop what lies before it and keep ``size`` rows each.
    """
    if size < 1 or len(keys) != len(last):
        raise ValueError("a page needs a size of at least 1 and one value per key")
    after, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, last, strict=True):
        after = after | (same & (key > F.lit(value)))
        same = same & (key == F.lit(value))
    return df.filter(after).orderBy(*keys).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """Total rows, and whether anything follows the page."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(number).alias("page"),
        F.lit(size).alias("page_size"),
        (F.col("total") > number * size).alias("has_more"),
    )
