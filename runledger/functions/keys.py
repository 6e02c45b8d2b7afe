"""Grouping keys and argument checks used by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A job id is unique only inside its workspace.
JOB_KEY = ["workspace_id", "job_id"]


def workspace_predicate(workspace_id: str | int | None) -> Column | None:
    """None or 'all' selects every workspace; anything else must be digits."""
    if workspace_id is None or workspace_id == "all":
        return None
    if not str(workspace_id).isdigit():
        raise ValueError(f"workspace_id must be numeric, got {workspace_id!r}")
    return F.col("workspace_id") == F.lit(int(workspace_id)).cast("long")


def in_workspace(df: DataFrame, workspace_id: str | int | None = None) -> DataFrame:
    predicate = workspace_predicate(workspace_id)
    return df if predicate is None else df.filter(predicate)


def together(df: DataFrame) -> DataFrame:
    """One shuffle that brings the rows of a job together.

    Only for rows that an aggregate has already reduced to a bounded number per job (days,
    products, distinct durations): every later aggregate and join per job is then local, where
    each would otherwise shuffle the same rows again.
    """
    return df.repartition(*JOB_KEY)


def join_jobs(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join of two sides whose rows already lie together by job.

    The merge hint keeps it local: turning one side into a broadcast at run time would save no
    shuffle and cost a round trip through the driver.
    """
    return left.join(right.hint("merge"), JOB_KEY, how)


# Tasks over which the rows of one job are spread in joins of whole run tables.
SPREAD = 16


def join_spread(left: DataFrame, per_job: DataFrame, by: str, how: str = "left", parts: int = SPREAD) -> DataFrame:
    """Join of many rows per job with one row per job, the rows of a job spread over ``parts`` tasks.

    The adaptive skew rule does not split a join whose other side comes from a rank over its own
    shuffle. So rows are dealt by ``by`` within a job, and the row of the job goes to each part.
    """
    part = "_part"
    dealt = left.withColumn(part, F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    copied = per_job.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copied, [*JOB_KEY, part], how).drop(part)


def condition_key(category: str, suffix: str | Column) -> Column:
    """Stable identity of an alert condition, e.g. ``failure_1000_17_single``."""
    tail = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat_ws(
        "_", F.lit(category), F.col("workspace_id").cast("string"), F.col("job_id").cast("string"), tail
    )
