"""Output tables of jobs, row-count deltas and schema drift."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY
from ..functions.naming import table_parts
from ..functions.numbers import rounded
from ..functions.timing import trailing
from .jobs import OUTPUT_TABLES_TAG, latest_jobs, tag_text

ROW_COUNT_ANOMALY_PERCENT = 20
TREND_POINTS = 5


def job_output_tables(lineage: DataFrame, as_of: date, days: int = 30, limit: int | None = None) -> DataFrame:
    """Distinct tables written by every job, or the first ``limit`` of each by name.

    Duplicates go in a map-side combined aggregate; the rank then sees distinct tables only.
    """
    written = (
        lineage.filter(
            (F.col("entity_type") == "JOB")
            & F.col("target_table_full_name").isNotNull()
            & trailing("event_time", as_of, days)
        )
        .select(
            "workspace_id",
            F.col("entity_metadata.job_info.job_id").try_cast("bigint").alias("job_id"),
            F.col("target_table_full_name").alias("table_name"),
        )
        .filter(F.col("job_id").isNotNull())
        .distinct()
    )
    if limit is None:
        return written
    by_name = Window.partitionBy(*JOB_KEY).orderBy("table_name")
    return written.withColumn("rn", F.row_number().over(by_name)).filter(F.col("rn") <= limit).drop("rn")


def tagged_output_tables(jobs: DataFrame) -> DataFrame:
    """Tables named in the comma list tag of current jobs."""
    return (
        latest_jobs(jobs)
        .select(*JOB_KEY, F.explode(F.split(tag_text(OUTPUT_TABLES_TAG), ",")).alias("table_name"))
        .withColumn("table_name", F.trim("table_name"))
        .filter("table_name <> ''")
    )


def job_output_tables_with_fallback(lineage: DataFrame, jobs: DataFrame, as_of: date) -> DataFrame:
    """Tables from lineage, or from the tag for jobs that have none there."""
    from_lineage = job_output_tables(lineage, as_of)
    covered = from_lineage.select(*JOB_KEY).distinct()
    fallback = tagged_output_tables(jobs).join(covered, JOB_KEY, "left_anti")
    return from_lineage.withColumn("origin", F.lit("lineage")).unionByName(
        fallback.withColumn("origin", F.lit("tag"))
    )


def table_name_parts(tables: DataFrame, column: str = "table_name") -> DataFrame:
    """Adds catalog, schema and table parts; names without a schema are dropped."""
    parts = [part.alias(f"{name}_part") for name, part in table_parts(F.col(column)).items()]
    resolved = tables.select("*", *parts)
    return resolved.filter("schema_part IS NOT NULL AND schema_part <> '' AND table_part <> ''")


def row_count_delta(snapshots: DataFrame, history: int = 10) -> DataFrame:
    """Latest row count of every table against the mean of up to ``history`` snapshots before it.

    Only the newest ``history + 1`` snapshots of a table pass the rank, so a table with a very
    long history costs no more than any other.
    """
    newest = Window.partitionBy("table_name").orderBy(F.col("snapshot_date").desc())
    ranked = (
        snapshots.withColumn("row_count", F.coalesce(F.col("row_count").cast("long"), F.lit(0).cast("long")))
        .withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= history + 1)
    )
    latest, before = F.col("rn") == 1, F.col("rn") > 1
    per_table = ranked.groupBy("table_name").agg(
        F.max(F.when(latest, F.col("snapshot_date"))).alias("snapshot_date"),
        F.max(F.when(latest, F.col("row_count"))).alias("current_row_count"),
        F.avg(F.when(before, F.col("row_count"))).alias("mean_before"),
        F.sort_array(
            F.collect_list(
                F.when(F.col("rn") <= TREND_POINTS, F.struct("rn", "snapshot_date", "row_count"))
            )
        ).alias("trend"),
    )
    current = F.col("current_row_count")
    baseline = F.coalesce("mean_before", current.cast("double"))
    delta = F.when(
        F.col("baseline_row_count") > 0, (current - F.col("baseline_row_count")) / F.col("baseline_row_count") * 100
    ).otherwise(F.when(current == 0, 0.0).otherwise(100.0))
    return (
        per_table.withColumn("baseline_row_count", baseline)
        .withColumn("exact_delta", delta)
        .select(
            "table_name",
            "snapshot_date",
            "current_row_count",
            "baseline_row_count",
            rounded(F.col("exact_delta"), 2).alias("delta_percent"),
            (rounded(F.abs("exact_delta"), 9) > ROW_COUNT_ANOMALY_PERCENT).alias("is_anomaly"),
            "trend",
        )
    )


def schema_changes(snapshots: DataFrame) -> DataFrame:
    """Column changes between the two newest schema snapshots of every table.

    Both versions of a column meet in one aggregate on (table, column), which replaces the
    full outer join of a table with itself. A table with a single snapshot has no changes.
    """
    version_rank = Window.partitionBy("table_name").orderBy(F.col("snapshot_version").desc())
    versions = (
        snapshots.select("table_name", "snapshot_version")
        .distinct()
        .withColumn("age", F.row_number().over(version_rank))
        .filter("age <= 2")
    )
    new, old = F.col("age") == 1, F.col("age") == 2
    columns = (
        snapshots.join(versions, ["table_name", "snapshot_version"])
        .groupBy("table_name", "column_name")
        .agg(
            F.max(F.when(old, F.col("data_type"))).alias("old_type"),
            F.max(F.when(new, F.col("data_type"))).alias("new_type"),
            F.max(new).alias("in_new"),
            F.max(old).alias("in_old"),
        )
    )
    compared = versions.groupBy("table_name").agg((F.max("age") == 2).alias("has_previous"))
    change = (
        F.when(~F.col("in_old"), "added")
        .when(~F.col("in_new"), "removed")
        .when(~F.col("old_type").eqNullSafe(F.col("new_type")), "type_changed")
    )
    return columns.join(compared, "table_name").select(
        "table_name",
        "column_name",
        F.when(F.col("has_previous"), change).alias("change_type"),
        "old_type",
        "new_type",
    )


def schema_drift(snapshots: DataFrame) -> DataFrame:
    """One row per table with its added, removed and retyped columns, each list sorted."""
    kind = F.col("change_type")

    def names(which: str) -> Column:
        return F.sort_array(F.collect_list(F.when(kind == which, F.col("column_name"))))

    retyped = F.when(kind == "type_changed", F.struct("column_name", "old_type", "new_type"))
    return (
        schema_changes(snapshots)
        .groupBy("table_name")
        .agg(
            (F.count("change_type") > 0).alias("has_drift"),
            names("added").alias("added_columns"),
            names("removed").alias("removed_columns"),
            F.sort_array(F.collect_list(retyped)).alias("type_changes"),
        )
    )


def schema_history(snapshots: DataFrame) -> DataFrame:
    """One row per table and version with the columns added, removed and retyped since the version before it.

    The versions of a table are numbered without gaps. A column that is missing in between makes a gap in the
    numbers of its own versions: it is removed where its run ends and added where the next one begins. So no version is
    joined with another; what meets in one task is one column of one table. The first version has no changes.
    """
    versions = snapshots.select("table_name", "snapshot_version").distinct()
    number = F.row_number().over(Window.partitionBy("table_name").orderBy("snapshot_version"))
    numbered = versions.withColumn("v", number)
    seen = snapshots.select("table_name", "snapshot_version", "column_name", "data_type").dropDuplicates(["table_name", "snapshot_version", "column_name"])
    of_column = Window.partitionBy("table_name", "column_name").orderBy("v")
    placed = seen.join(numbered, ["table_name", "snapshot_version"]).select(
        "table_name",
        "column_name",
        "v",
        "data_type",
        F.lag("v").over(of_column).alias("before"),
        F.lead("v").over(of_column).alias("after"),
        F.lag("data_type").over(of_column).alias("old_type"),
    )
    goes_on = F.coalesce(F.col("before") == F.col("v") - 1, F.lit(False))
    ends = F.col("after").isNull() | (F.col("after") > F.col("v") + 1)
    changes = placed.select(
        "table_name",
        F.explode(
            F.array(
                F.when((F.col("v") > 1) & ~goes_on, F.struct("v", F.lit("added").alias("kind"), "column_name", F.lit(None).cast("string").alias("old_type"), F.col("data_type").alias("new_type"))),
                F.when(ends, F.struct((F.col("v") + 1).alias("v"), F.lit("removed").alias("kind"), "column_name", F.col("data_type").alias("old_type"), F.lit(None).cast("string").alias("new_type"))),
                F.when(goes_on & ~F.col("old_type").eqNullSafe(F.col("data_type")), F.struct("v", F.lit("type_changed").alias("kind"), "column_name", "old_type", F.col("data_type").alias("new_type"))),
            )
        ).alias("x"),
    ).filter("x IS NOT NULL")
    kind = F.col("x.kind")

    def names(which: str) -> Column:
        return F.sort_array(F.collect_list(F.when(kind == which, F.col("x.column_name"))))

    retyped = F.when(kind == "type_changed", F.struct("x.column_name", "x.old_type", "x.new_type"))
    lists = changes.groupBy("table_name", F.col("x.v").alias("v")).agg(
        names("added").alias("added_columns"), names("removed").alias("removed_columns"), F.sort_array(F.collect_list(retyped)).alias("type_changes")
    )
    empty = F.array().cast("array<string>")
    found = numbered.join(lists, ["table_name", "v"], "left")
    return found.select(
        "table_name",
        "snapshot_version",
        F.col("added_columns").isNotNull().alias("has_drift"),
        F.coalesce("added_columns", empty).alias("added_columns"),
        F.coalesce("removed_columns", empty).alias("removed_columns"),
        F.coalesce("type_changes", F.array().cast("array<struct<column_name:string,old_type:string,new_type:string>>")).alias("type_changes"),
    )


#: Days of a stretch of history that one task works on.
STRETCH_DAYS = 128


def row_count_history(snapshots: DataFrame, history: int = 10, stretch: int = STRETCH_DAYS) -> DataFrame:
    """Row count of every snapshot of a table against the mean of up to ``history`` snapshots before it.

    A table's history is cut into stretches of ``stretch`` days. Each takes along the last snapshots before it, which
    are found from the last ``history`` and the first of each stretch. So the frame over rows runs in
    one stretch at a time, and a table with a very long history is spread over tasks. Of rows of one table and day the one with
    the most rows counts.
    """
    counted = snapshots.groupBy("table_name", "snapshot_date").agg(F.max(F.coalesce(F.col("row_count").cast("long"), F.lit(0).cast("long"))).alias("row_count"))
    cut = counted.withColumn("stretch", F.floor(F.unix_date("snapshot_date") / stretch))
    inside = Window.partitionBy("table_name", "stretch")
    ends = cut.select(
        "*",
        F.row_number().over(inside.orderBy(F.col("snapshot_date").desc())).alias("from_end"),
        F.row_number().over(inside.orderBy("snapshot_date")).alias("from_start"),
    ).filter((F.col("from_end") <= history) | (F.col("from_start") == 1))
    earlier = Window.partitionBy("table_name").orderBy("snapshot_date").rowsBetween(-history, -1)
    taken = ends.withColumn("taken", F.collect_list(F.struct("snapshot_date", "row_count")).over(earlier)).filter("from_start = 1")
    along = taken.select("table_name", "stretch", F.explode("taken").alias("x"), F.lit(False).alias("own")).select("table_name", "x.snapshot_date", "x.row_count", "stretch", "own")
    rows = cut.withColumn("own", F.lit(True)).unionByName(along)
    before = inside.orderBy("snapshot_date").rowsBetween(-history, -1)
    current = F.col("row_count")
    based = rows.withColumn("baseline_row_count", F.coalesce(F.avg("row_count").over(before), current.cast("double"))).filter("own")
    baseline = F.col("baseline_row_count")
    delta = F.when(baseline > 0, (current - baseline) / baseline * 100).otherwise(F.when(current == 0, 0.0).otherwise(100.0))
    return based.select(
        "table_name",
        "snapshot_date",
        "row_count",
        "baseline_row_count",
        rounded(delta, 2).alias("delta_percent"),
        (rounded(F.abs(delta), 9) > ROW_COUNT_ANOMALY_PERCENT).alias("is_anomaly"),
    )
