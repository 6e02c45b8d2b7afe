"""Job versions: the current one, its tags and its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import last_change
from ..functions.keys import JOB_KEY, join_spread
from ..functions.wildcards import matches_any

# Tag names.
SLA_TAG = "sla_minutes"
TEAM_TAG = "team"
OWNER_TAG = "owner"
BUDGET_TAG = "budget_monthly_dbus"
OUTPUT_TABLES_TAG = "output_tables"
UNTAGGED = "Untagged"


def latest_jobs(jobs: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Current version of every job.

    Versions are ranked before deleted jobs are dropped, so a deleted job does not come
    back through an older version. ``row_number() = 1`` alone in its window becomes a
    group limit on the map side: a job with millions of versions ships one row per task.
    The key columns are required here so that every use has the same scan and shuffle.
    """
    newest = Window.partitionBy(*JOB_KEY).orderBy(
        F.col("change_time").desc_nulls_last(),
        F.col("delete_time").desc_nulls_last(),
        F.col("name").asc_nulls_last(),
    )
    keyed = jobs.filter("workspace_id IS NOT NULL AND job_id IS NOT NULL")
    current = keyed.withColumn("rn", F.row_number().over(newest)).filter("rn = 1").drop("rn")
    return current if include_deleted else current.filter(F.col("delete_time").isNull())


def list_jobs(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    result = latest_jobs(jobs).orderBy(F.col("name").asc_nulls_last(), *JOB_KEY)
    return result if limit is None else result.limit(limit)


def tag_text(key: str) -> Column:
    return F.element_at(F.col("tags"), F.lit(key))


def tag_int(key: str) -> Column:
    """NULL for text that is no whole number."""
    return F.trim(tag_text(key)).try_cast("int")


def tag_number(key: str) -> Column:
    return F.trim(tag_text(key)).try_cast("double")


def job_tags(jobs: DataFrame) -> DataFrame:
    """Typed tags of every current job."""
    sla, team = tag_int(SLA_TAG), tag_text(TEAM_TAG)
    return latest_jobs(jobs).select(
        *JOB_KEY,
        sla.alias("sla_minutes"),
        team.alias("team"),
        tag_text(OWNER_TAG).alias("owner"),
        tag_number(BUDGET_TAG).alias("budget_monthly_dbus"),
        sla.isNotNull().alias("has_sla"),
        team.isNotNull().alias("has_team"),
    )


def with_job_names(df: DataFrame, jobs: DataFrame, team: bool = False, spread_by: str | None = None) -> DataFrame:
    """Adds ``job_name``, ``job-<id>`` where the job is unknown or deleted, and its team if asked.

    No broadcast hint: the size of the job list decides. For tables with many rows per job name a
    column in ``spread_by`` that tells them apart, so that a hot job does not meet in one task.
    """
    columns = [F.col("name").alias("job_name")]
    if team:
        columns.append(tag_text(TEAM_TAG).alias("team"))
    fallback = F.concat(F.lit("job-"), F.col("job_id").cast("string"))
    names = latest_jobs(jobs).select(*JOB_KEY, *columns)
    joined = df.join(names, JOB_KEY, "left") if spread_by is None else join_spread(df, names, spread_by)
    return joined.withColumn("job_name", F.coalesce(F.col("job_name"), fallback))


def with_names_then(df: DataFrame, jobs: DataFrame, at: str = "period_start_time", parts: int = 1) -> DataFrame:
    """Adds ``job_name`` as it was at the time of each row, ``job-<id>`` where the job was unknown or deleted then.

    A version is in force from its change until the next one; a deleted one until its deletion. Of
    versions of one moment the one counts that ``latest_jobs`` would pick.
    """
    order = [F.col("delete_time").desc_nulls_last(), F.col("name").asc_nulls_last()]
    first = F.row_number().over(Window.partitionBy(*JOB_KEY, "change_time").orderBy(*order))
    versions = jobs.select(*JOB_KEY, "change_time", "delete_time", "name").withColumn("rn", first).filter("rn = 1")
    found = last_change(df, versions, JOB_KEY, at, "change_time", ["delete_time", "name"], parts=parts)
    gone = F.col("in_force.delete_time").cast("timestamp") <= F.col(at).cast("timestamp")
    name = F.when(~F.coalesce(gone, F.lit(False)), F.col("in_force.name"))
    return found.withColumn("job_name", F.coalesce(name, F.concat(F.lit("job-"), F.col("job_id").cast("string")))).drop("in_force")


def jobs_of_team(jobs: DataFrame, team: str) -> DataFrame:
    return latest_jobs(jobs).filter(tag_text(TEAM_TAG) == team).select(*JOB_KEY)


def jobs_matching(jobs: DataFrame, patterns: list[str]) -> DataFrame:
    """Current jobs whose name matches any wildcard pattern."""
    return (
        latest_jobs(jobs)
        .select(*JOB_KEY, F.col("name").alias("job_name"))
        .filter(matches_any(F.col("job_name"), patterns))
    )
