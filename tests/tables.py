"""Hand-made input tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

AS_OF = date(2024, 1, 31)
NOW = datetime(2024, 1, 31)
RUN_SCHEMA = (
    "workspace_id long, job_id long, run_id long, period_start_time timestamp_ntz, period_end_time timestamp_ntz, "
    "run_duration_seconds int, result_state string, termination_code string"
)
JOB_SCHEMA = (
    "workspace_id long, job_id long, name string, tags map<string,string>, creator_user_name string, "
    "change_time timestamp_ntz, delete_time timestamp_ntz"
)
USAGE_SCHEMA = (
    "workspace_id long, usage_date date, sku_name string, usage_quantity decimal(18,5), "
    "usage_metadata struct<job_id string, cluster_id string>"
)
ACTIVE_SCHEMA = "workspace_id long, job_id long, run_id long, state string, start_time timestamp_ntz"


def run(job, run_id, state, *, ws=1, day=30, hour=1, minute=0, seconds=600, recorded="same", code=None):
    start = datetime(2024, 1, day, hour, minute)
    end = None if state is None else start + timedelta(seconds=seconds)
    duration = (None if state is None else seconds) if recorded == "same" else recorded
    return (ws, job, run_id, start, end, duration, state, code)


def runs(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, RUN_SCHEMA)


def job(job_id, name, *, ws=1, changed=1, deleted=None, **tags):
    stamp = datetime(2023, 1, changed)
    gone = None if deleted is None else datetime(2023, 1, deleted)
    return (ws, job_id, name, {k: str(v) for k, v in tags.items()}, "user@example.com", stamp, gone)


def jobs(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, JOB_SCHEMA)


def used(job_id, day, quantity, *, ws=1, sku="JOBS_COMPUTE", month=1):
    return (ws, date(2024, month, day), sku, Decimal(str(quantity)), (None if job_id is None else str(job_id), "c1"))


def usage(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, USAGE_SCHEMA)


def active(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, ACTIVE_SCHEMA)


def by_job(df: DataFrame, *columns: str) -> dict:
    """job id -> value, or tuple of values."""
    picked = {r.job_id: tuple(r[c] for c in columns) for r in df.collect()}
    return {k: v[0] if len(columns) == 1 else v for k, v in picked.items()}
