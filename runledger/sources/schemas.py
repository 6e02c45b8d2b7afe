"""Schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T

RUNS = T.StructType(
    [
        T.StructField("workspace_id", T.LongType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("period_start_time", T.TimestampType()),
        T.StructField("period_end_time", T.TimestampType()),
        T.StructField("run_duration_seconds", T.IntegerType()),
        T.StructField("result_state", T.StringType()),
        T.StructField("termination_code", T.StringType()),
        T.StructField("run_type", T.StringType()),
    ]
)

JOBS = T.StructType(
    [
        T.StructField("workspace_id", T.LongType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("creator_user_name", T.StringType()),
        T.StructField("run_as_user_name", T.StringType()),
        T.StructField("change_time", T.TimestampType()),
        T.StructField("delete_time", T.TimestampType()),
    ]
)

# Quantities are decimal: corrections arrive as negative rows and must cancel exactly.
USAGE = T.StructType(
    [
        T.StructField("workspace_id", T.LongType()),
        T.StructField("usage_date", T.DateType()),
        T.StructField("sku_name", T.StringType()),
        T.StructField("usage_quantity", T.DecimalType(18, 5)),
        T.StructField(
            "usage_metadata",
            T.StructType(
                [
                    T.StructField("job_id", T.StringType()),
                    T.StructField("cluster_id", T.StringType()),
                    T.StructField("notebook_id", T.StringType()),
                ]
            ),
        ),
    ]
)

LINEAGE = T.StructType(
    [
        T.StructField("workspace_id", T.LongType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField(
            "entity_metadata",
            T.StructType(
                [T.StructField("job_info", T.StructType([T.StructField("job_id", T.StringType())]))]
            ),
        ),
        T.StructField("target_table_full_name", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
    ]
)

PRESETS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("team", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("job_name_patterns", T.StringType()),
        T.StructField("time_range", T.StringType()),
        T.StructField("start_date", T.StringType()),
        T.StructField("end_date", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("is_shared", T.BooleanType()),
    ]
)

# Live run feed: state and times as the job service reports them.
LIVE_RUNS = T.StructType(
    [
        T.StructField("workspace_id", T.LongType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("result_state", T.StringType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
    ]
)
