"""Run states reduced to one vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Both spellings of each state occur in run tables.
SUCCESS_STATES = ["SUCCESS", "SUCCEEDED"]
FAILED_STATES = ["FAILED", "FAILURE"]


def is_finished(state: str = "result_state") -> Column:
    return F.col(state).isNotNull()


def is_success(state: str = "result_state") -> Column:
    """False, never NULL, for an open run."""
    return F.coalesce(F.upper(F.col(state)).isin(SUCCESS_STATES), F.lit(False))


def is_failed(state: str = "result_state") -> Column:
    return F.coalesce(F.upper(F.col(state)).isin(FAILED_STATES), F.lit(False))


def outcome(state: str = "result_state") -> Column:
    return (
        F.when(~is_finished(state), "open")
        .when(is_success(state), "success")
        .when(is_failed(state), "failed")
        .otherwise("other")
    )


def priority(last_failed: Column, previous_failed: Column, success_rate: Column) -> Column:
    """P1 two failures in a row, P2 the last run failed, P3 rate in the 70-89.9 band, else NULL."""
    return (
        F.when(last_failed & previous_failed, "P1")
        .when(last_failed, "P2")
        .when(success_rate.between(70, 89.9), "P3")
    )


def traffic_light(success_rate: Column) -> Column:
    return F.when(success_rate >= 90, "green").when(success_rate >= 70, "yellow").otherwise("red")


def rank_of(column: Column, order: list[str], missing: int | None = None) -> Column:
    """1-based position of a value in ``order``; unknown and NULL values rank last."""
    last = len(order) + 1 if missing is None else missing
    expr = F.lit(last)
    for position, value in reversed(list(enumerate(order, start=1))):
        expr = F.when(column == value, position).otherwise(expr)
    return expr


PRIORITY_ORDER = ["P1", "P2", "P3"]
