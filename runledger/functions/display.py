"""Report columns rendered as short text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import fixed_text, rounded


def duration_text(seconds: Column) -> Column:
    """``2h 15m``, ``3h``, ``45m``, ``30s``; ``--`` for unknown or negative input."""
    whole = F.floor(seconds).cast("long")
    hours, minutes = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60)
    hour_part = F.concat(hours.cast("string"), F.lit("h"))
    minute_part = F.concat(minutes.cast("string"), F.lit("m"))
    return (
        F.when(seconds.isNull() | (seconds < 0), "--")
        .when((hours > 0) & (minutes > 0), F.concat_ws(" ", hour_part, minute_part))
        .when(hours > 0, hour_part)
        .when(minutes > 0, minute_part)
        .otherwise(F.concat(F.pmod(whole, F.lit(60)).cast("string"), F.lit("s")))
    )


def usage_text(dbus: Column) -> Column:
    whole = F.format_number(rounded(dbus.cast("double"), 0).cast("decimal(28,0)"), 0)
    return (
        F.when(dbus < 0.01, "<0.01")
        .when(dbus < 1, fixed_text(dbus, 2))
        .when(dbus < 10, fixed_text(dbus, 1))
        .otherwise(whole)
    )


def dollars_text(dollars: Column) -> Column:
    whole = F.format_number(rounded(dollars.cast("double"), 0).cast("decimal(28,0)"), 0)
    return F.concat(F.lit("$"), F.when(dollars < 1, fixed_text(dollars, 2)).otherwise(whole))


def trend_text(change: Column) -> Column:
    """Signed whole percent, without a sign for zero."""
    return F.concat(F.when(change > 0, "+").otherwise(""), fixed_text(change, 0), F.lit("%"))


def delta_text(change: Column) -> Column:
    return F.concat(F.when(change >= 0, "+").otherwise(""), fixed_text(change, 1), F.lit("%"))


def count_text(count: Column) -> Column:
    """1234 -> 1.2K, and so on for M and B."""
    text = count.cast("string")
    for size, unit in [(1_000, "K"), (1_000_000, "M"), (1_000_000_000, "B")]:
        scaled = F.concat(fixed_text(count.cast("double") / size, 1), F.lit(unit))
        text = F.when(count >= size, scaled).otherwise(text)
    return text


def multiple_text(value: Column, baseline: Column) -> Column:
    """``2.3x baseline``."""
    text = F.concat(fixed_text(value.cast("double") / baseline, 1), F.lit("x baseline"))
    return F.when(F.coalesce(baseline, F.lit(0.0)) <= 0, "no baseline").otherwise(text)
