"""Windows relative to an explicit ``as_of`` day, and durations."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trailing(column: str, as_of: date, days: int) -> Column:
    """Last ``days`` days up to and including ``as_of``.

    The bounds are DATE literals, so the predicate compares the bare column and is
    pushed into the scan whether the column is a DATE or either timestamp type.
    """
    start = as_of - timedelta(days=days)
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(as_of + timedelta(days=1)))


def between_days(column: str, start: date, end: date) -> Column:
    """Half-open custom range ``[start, end)``."""
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))


def since(column: str, start: date) -> Column:
    return F.col(column) >= F.lit(start)


def moment_like(df: DataFrame, column: str, moment: datetime) -> Column:
    """``moment`` as a literal of the column's own timestamp type (with or without zone)."""
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(df.schema[column].dataType)


def effective_seconds(
    duration: str = "run_duration_seconds", start: str = "period_start_time", end: str = "period_end_time"
) -> Column:
    """Recorded duration, or the whole seconds between start and end where it is 0 or NULL."""
    recorded = F.col(duration).cast("long")
    return F.when(
        recorded.isNull() | (recorded == 0), F.timestamp_diff("SECOND", F.col(start), F.col(end))
    ).otherwise(recorded)


def elapsed_seconds(start: Column, moment: Column) -> Column:
    return F.timestamp_diff("SECOND", start, moment)


def stamp_text(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
