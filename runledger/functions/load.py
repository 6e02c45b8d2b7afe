"""Utilisation estimated from usage units per hour of run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import rounded


def _estimate(rate: Column) -> Column:
    high = F.least(F.lit(80.0) + (rate - 4) * 2, F.lit(95.0))
    return (
        F.when(rate < 1, F.lit(20.0))
        .when(rate < 2, F.lit(40.0))
        .when(rate < 4, F.lit(60.0))
        .otherwise(high)
    )


def worker_utilization(rate: Column) -> Column:
    """Step function of DBU per hour; NULL where there is no consumption."""
    return F.when(rate > 0, rounded(_estimate(rate), 1))


def driver_utilization(rate: Column) -> Column:
    """Drivers are taken to run at 85 % of the worker estimate."""
    return F.when(rate > 0, rounded(_estimate(rate) * 0.85, 1))


def utilization_label(percentage: Column) -> Column:
    return (
        F.when(percentage.isNull(), "No data")
        .when(percentage >= 60, "Efficient")
        .when(percentage >= 40, "Fair")
        .otherwise("Low")
    )


def right_sizing(percentage: Column) -> Column:
    return (
        F.when(percentage < 20, "Consider reducing workers by 50% or using smaller node types")
        .when(percentage < 30, "Consider reducing to fewer workers")
        .when(percentage < 40, "Consider using smaller node types")
    )
