"""Readers with declared schemas: no inference pass, and only the named columns are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas


def read_table(spark: SparkSession, location: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """``location`` is a path, or a table name for ``fmt='table'``."""
    if fmt == "table":
        return spark.read.table(location).select(*schema.fieldNames())
    return spark.read.schema(schema).format(fmt).load(location)


def read_runs(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, location, schemas.RUNS, fmt)


def read_jobs(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, location, schemas.JOBS, fmt)


def read_usage(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, location, schemas.USAGE, fmt)


def read_lineage(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, location, schemas.LINEAGE, fmt)


def read_presets(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, location, schemas.PRESETS, fmt)


def job_usage(usage: DataFrame) -> DataFrame:
    """Flat usage rows of jobs. The BIGINT/STRING mismatch of job ids is settled here, once.
    Ids that are no numbers belong to no job; ``unreadable_job_ids`` reports them.

    The key columns are required explicitly. Joins above would demand the same and push it
    down, which would make otherwise equal scans differ and keep their shuffles from being reused.
    """
    flat = usage.select(
        "workspace_id",
        F.col("usage_metadata.job_id").try_cast("bigint").alias("job_id"),
        "usage_date",
        "sku_name",
        "usage_quantity",
    )
    return flat.filter("workspace_id IS NOT NULL AND job_id IS NOT NULL AND usage_date IS NOT NULL")


def unreadable_job_ids(usage: DataFrame) -> DataFrame:
    """Job ids of usage rows that are no numbers, with how many rows they have."""
    text = F.col("usage_metadata.job_id")
    broken = usage.filter(text.isNotNull() & text.try_cast("bigint").isNull())
    return broken.groupBy("workspace_id", text.alias("job_id_text")).agg(F.count(F.lit(1)).alias("usage_rows"))


def live_runs(feed: DataFrame, unknown_state: str = "UNKNOWN") -> DataFrame:
    """Live run feed with epoch milliseconds turned into timestamps; 0 means not set."""
    return feed.select(
        "workspace_id",
        "job_id",
        "run_id",
        "run_name",
        F.coalesce("state", F.lit(unknown_state)).alias("state"),
        "result_state",
        epoch_ms("start_ms").alias("start_time"),
        epoch_ms("end_ms").alias("end_time"),
    )


def epoch_ms(column: str):
    return F.timestamp_millis(F.when(F.col(column) != 0, F.col(column)))
