"""Classes derived from product and job names, and table name parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Product name fragment -> category, first hit wins.
SKU_CATEGORIES = [
    ("ALL_PURPOSE", "All-Purpose"),
    ("JOBS", "Jobs Compute"),
    ("SQL", "SQL Warehouse"),
    ("SERVERLESS", "Serverless"),
]
OTHER_CATEGORY = "Other"

# Name fragments that mark a continuously running job.
STREAMING_FRAGMENTS = [
    "stream",
    r"\bcdc\b",
    "continuous",
    "real.?time",
    "kafka",
    "kinesis",
    "event.?hub",
    "ingest",
    "pipeline",
]


def sku_category(sku_name: Column) -> Column:
    upper = F.upper(sku_name)
    category = F.lit(OTHER_CATEGORY)
    for fragment, label in reversed(SKU_CATEGORIES):
        category = F.when(upper.contains(fragment), label).otherwise(category)
    return category


def is_streaming_name(name: Column) -> Column:
    return F.coalesce(name.rlike("(?i)" + "|".join(STREAMING_FRAGMENTS)), F.lit(False))


def table_parts(table: Column) -> dict[str, Column]:
    """catalog / schema / table of a dotted name; missing leading parts are NULL.

    Names with more than three parts are not resolvable and keep only their first piece.
    """
    pieces = F.split(table, r"\.")
    n = F.size(pieces)
    return {
        "catalog": F.when(n == 3, pieces[0]),
        "schema": F.when(n == 3, F.get(pieces, F.lit(1))).when(n == 2, pieces[0]),
        "table": F.when(n == 3, F.get(pieces, F.lit(2))).when(n == 2, F.get(pieces, F.lit(1))).otherwise(pieces[0]),
    }
