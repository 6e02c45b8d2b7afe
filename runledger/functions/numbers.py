"""Rates, trends and fixed-point text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """Double division, NULL for a zero denominator."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def rounded(value: Column, places: int) -> Column:
    """A double rounded half away from zero after scaling, as databases do.

    ``F.round`` rounds the shortest decimal text of the double instead, so 0.285 would become 0.29
    and not 0.28 (0.285 * 100 is 28.499999999999996).
    """
    scale = F.lit(float(10**places))
    return F.round(value.cast("double") * scale, 0) / scale


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    whole = F.nullif(whole.cast("double"), F.lit(0.0))
    return rounded(F.lit(100.0) * part.cast("double") / whole, places)


def trend_percent(current: Column, previous: Column) -> Column:
    """Relative change in percent; with nothing before it is 100 or 0."""
    cur, prev = current.cast("double"), previous.cast("double")
    change = (
        F.when(prev > 0, (cur - prev) / prev * 100)
        .when(cur > 0, F.lit(100.0))
        .otherwise(F.lit(0.0))
    )
    return rounded(change, 1)


def fixed_text(value: Column, places: int) -> Column:
    """Rounded value as text with exactly ``places`` decimals."""
    return rounded(value, places).cast(f"decimal(28,{places})").cast("string")


def whole_text(value: Column) -> Column:
    """Integer part as text."""
    return F.floor(value).cast("string")


def _halves(value: Column) -> tuple[Column, Column]:
    """A double as the sum of two with half its digits, so that their products are exact."""
    wide = value * F.lit(134217729.0)
    upper = wide - (wide - value)
    return upper, value - upper


def interpolated(low: Column, high: Column, d: Column) -> Column:
    """``low * (1 - d) + high * d`` with the first product not rounded before it is added.

    That is how SQL engines that fuse multiplication and addition interpolate percentiles. The last place
    of the result decides what is rounded up. ``F.percentile`` rounds both products, and returns ``low``
    itself where it equals ``high``. Takes plain columns: each occurs many times in the formula.
    """
    share, other = F.lit(1.0) - d, high * d
    (a, b), (x, y) = _halves(low), _halves(share)
    product = low * share
    left_over = a * x - product + a * y + b * x + b * y
    total = product + other
    added = total - product
    return total + (product - (total - added) + (other - added) + left_over)


def percentile_of(df: DataFrame, values: str, point: float, name: str) -> DataFrame:
    """Replaces a short sorted list of doubles by its continuous percentile, NULL for an empty one."""
    place = (F.size(values) - 1) * F.lit(point)
    cut = df.withColumns(
        {
            "_low": F.get(values, F.floor(place).cast("int")),
            "_high": F.get(values, F.ceil(place).cast("int")),
            "_d": place - F.floor(place),
        }
    )
    found = interpolated(F.col("_low"), F.col("_high"), F.col("_d"))
    return cut.withColumn(name, found).drop(values, "_low", "_high", "_d")
