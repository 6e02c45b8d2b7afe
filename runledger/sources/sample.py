"""Adapter from the sample star-schema tables to the engine's inputs.

Each view is one SQL text that runs unchanged in Spark and in the checking database.
Operators know nothing of this module.
"""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2024, 1, 31)
AS_OF_TS = datetime(2024, 1, 31)

# The second source holds several years and has rows on its check day.
LONG_AS_OF = date(2001, 6, 30)

_WORKSPACE = "CAST(1000 + user_id % 3 AS BIGINT)"
_JOB = "CAST(FLOOR(user_id / 3) AS BIGINT)"
_PROP = "CAST(regexp_extract(props,'([0-9]+)',1) AS INT)"
_ORDERED = "o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 24 * 3600 AS INT)"
_LASTED = "CAST(600 + o_orderkey % 7200 AS INT)"
_SECONDS = "CAST(FLOOR(value * 60) + 600 AS INT)"


def _usage_rows(sign: str, where: str) -> str:
    return f"""
SELECT {_WORKSPACE} AS workspace_id, CAST(ts AS DATE) AS usage_date,
  CASE event_type WHEN 'click' THEN 'JOBS_COMPUTE' WHEN 'view' THEN 'SERVERLESS_SQL'
    WHEN 'error' THEN 'ALL_PURPOSE_COMPUTE' WHEN 'signup' THEN 'SERVERLESS' ELSE 'MODEL_SERVING' END AS sku_name,
  CAST({sign}(CAST(value AS DECIMAL(12,2)) * CAST(CASE
    WHEN user_id % 13 = 0 AND ts >= TIMESTAMP '2024-01-29 00:00:00' THEN 2.0
    WHEN user_id % 9 = 0 THEN 0.005 ELSE 0.1 END AS DECIMAL(5,3))) AS DECIMAL(18,5)) AS usage_quantity,
  CASE WHEN event_type = 'error' AND user_id % 4 = 0 THEN NULL WHEN event_id % 97 = 0 THEN CONCAT('adhoc-', CAST(user_id % 5 AS VARCHAR(20)))
    ELSE CAST({_JOB} AS VARCHAR(20)) END AS job_id,
  CONCAT('c-', regexp_extract(props,'([0-9]+)',1)) AS cluster_id
FROM events{where}"""


# Every 50th run is open, every 17th has duration 0; four finished states.
VIEWS: dict[str, str] = {
    "runs": f"""
SELECT {_WORKSPACE} AS workspace_id, {_JOB} AS job_id, event_id AS run_id, ts AS period_start_time,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts + INTERVAL '1' SECOND * {_SECONDS} END AS period_end_time,
  CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 0 ELSE {_SECONDS} END AS run_duration_seconds,
  CASE WHEN event_id % 50 = 0 THEN NULL
    WHEN event_type = 'error' AND user_id % 3 = 0 AND event_id % 4 <> 0 THEN 'SUCCESS'
    WHEN event_type = 'error' THEN 'FAILED'
    WHEN event_type = 'purchase' AND user_id % 7 = 0 THEN 'FAILED'
    WHEN event_type = 'signup' THEN 'SUCCEEDED'
    WHEN event_type = 'click' AND event_id % 40 = 1 THEN 'CANCELED'
    ELSE 'SUCCESS' END AS result_state,
  CASE WHEN event_type IN ('error', 'purchase') THEN CASE {_PROP} % 5
    WHEN 0 THEN 'DRIVER_OUT_OF_MEMORY' WHEN 1 THEN 'RUN_TIMEOUT' WHEN 2 THEN 'SCHEMA_MISMATCH'
    WHEN 3 THEN 'PERMISSION_DENIED' ELSE 'CLUSTER_ERROR' END END AS termination_code
FROM events""",
    # Spikes in the last two days for every 13th user; every 20th row has an exact retraction.
    "usage": _usage_rows("", "") + "\nUNION ALL" + _usage_rows("-", " WHERE event_id % 20 = 0"),
    # One to three versions, every 11th job deleted.
    "job_versions": """
SELECT c_custkey, c_mktsegment, 1 AS v FROM customer
UNION ALL SELECT c_custkey, c_mktsegment, 2 FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_mktsegment, 3 FROM customer WHERE c_custkey % 11 = 0""",
    # Some unusable budget texts.
    "jobs": """
SELECT CAST(1000 + c_custkey % 3 AS BIGINT) AS workspace_id, CAST(FLOOR(c_custkey / 3) AS BIGINT) AS job_id,
  CONCAT(CASE c_custkey % 6 WHEN 0 THEN 'etl-stream-' WHEN 1 THEN 'prod-cdc-' WHEN 2 THEN 'dq-' WHEN 3 THEN 'ETL-'
    WHEN 4 THEN 'kafka_ingest-' ELSE 'report-' END, LOWER(c_mktsegment), CASE WHEN v = 2 THEN '-daily' ELSE '' END) AS name,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE LOWER(c_mktsegment) END AS team,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(5 + c_custkey % 40 AS VARCHAR(20)) END AS sla_minutes,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(100 + (c_custkey % 30) * 20 AS VARCHAR(20))
    WHEN c_custkey % 10 = 1 THEN 'n/a' END AS budget_monthly_dbus,
  CASE WHEN c_custkey % 8 = 0 THEN CONCAT('main.ops.t', CAST(c_custkey % 9 AS VARCHAR(2)), ', ops.t1,plain') END AS output_tables,
  CONCAT('user', CAST(c_custkey % 20 AS VARCHAR(4)), '@example.com') AS creator_user_name,
  CASE v WHEN 1 THEN TIMESTAMP '2023-06-01 00:00:00' WHEN 2 THEN TIMESTAMP '2023-12-01 00:00:00'
    ELSE TIMESTAMP '2024-01-10 00:00:00' END AS change_time,
  CASE WHEN v = 3 THEN TIMESTAMP '2024-01-10 00:00:00' END AS delete_time
FROM job_versions""",
    "lineage": f"""
SELECT {_WORKSPACE} AS workspace_id, 'JOB' AS entity_type, {_JOB} AS job_id,
  CASE WHEN {_PROP} % 10 = 9 THEN NULL
    ELSE CONCAT('main.', event_type, '.t', CAST({_PROP} % 10 AS VARCHAR(2))) END AS target_table_full_name,
  ts AS event_time
FROM events WHERE event_type IN ('purchase', 'view')""",
    "table_snapshots": f"""
SELECT CONCAT('main.', event_type, '.u', CAST(user_id AS VARCHAR(20)), '_t', CAST({_PROP} % 3 AS VARCHAR(2))) AS table_name,
  CAST(ts AS DATE) AS snapshot_date, COUNT(*) AS row_count
FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2""",
    # Two versions per table: columns added, removed and retyped.
    "column_positions": "\nUNION ALL ".join(f"SELECT c_custkey, {pos} AS pos, {ver} AS ver FROM customer" for ver in (1, 2) for pos in range(6)),
    "column_snapshots": """
SELECT CONCAT('main.sales.t', CAST(c_custkey AS VARCHAR(20))) AS table_name, ver AS snapshot_version,
  CONCAT('c', CAST(pos AS VARCHAR(2))) AS column_name,
  CASE WHEN ver = 2 AND c_custkey % 3 = 0 AND pos = (c_custkey + 1) % 5 THEN 'BIGINT' ELSE 'STRING' END AS data_type,
  pos AS ordinal_position
FROM column_positions
WHERE (ver = 1 AND pos < 5 AND c_custkey % 10 <> 7)
  OR (ver = 2 AND ((pos < 5 AND NOT (c_custkey % 4 = 1 AND pos = c_custkey % 5)) OR (pos = 5 AND c_custkey % 2 = 0)))""",
    # Seven versions per table: columns that go and come back, change their type, or stay.
    "column_versions": "\nUNION ALL ".join(f"SELECT c_custkey, {pos} AS pos, {ver} AS ver FROM customer" for ver in (1, 2, 3, 5, 8, 13, 21) for pos in range(6)),
    "column_history": """
SELECT CONCAT('main.sales.h', CAST(c_custkey AS VARCHAR(20))) AS table_name, ver AS snapshot_version,
  CONCAT('c', CAST(pos AS VARCHAR(2))) AS column_name,
  CASE WHEN (c_custkey + pos + ver) % 5 = 0 THEN 'BIGINT' ELSE 'STRING' END AS data_type, pos AS ordinal_position
FROM column_versions WHERE pos = 0 OR (c_custkey * 7 + pos * 3 + ver * (1 + c_custkey % 4)) % 6 <> 0""",
    # Acknowledgements around the time of the alerts, several per condition.
    "ack_history": f"""
SELECT CONCAT('failure_', CAST({_WORKSPACE} AS VARCHAR(20)), '_', CAST({_JOB} AS VARCHAR(20)), '_single') AS condition_key,
  ts + INTERVAL '1' SECOND * CAST(event_id % 5 * 3600 AS INT) AS acknowledged_at
FROM events WHERE event_id % 3 = 0""",
    # Several years of runs; every tenth run has an earlier period that ended without a state.
    "long_runs": f"""
SELECT CAST(1000 + o_custkey % 120 % 3 AS BIGINT) AS workspace_id, CAST(FLOOR(o_custkey % 120 / 3) AS BIGINT) AS job_id,
  o_orderkey AS run_id, {_ORDERED} AS period_start_time,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE {_ORDERED} + INTERVAL '1' SECOND * {_LASTED} END AS period_end_time,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE {_LASTED} END AS run_duration_seconds,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS result_state,
  CASE WHEN o_orderstatus = 'F' THEN 'RUN_TIMEOUT' END AS termination_code
FROM orders
UNION ALL
SELECT CAST(1000 + o_custkey % 120 % 3 AS BIGINT), CAST(FLOOR(o_custkey % 120 / 3) AS BIGINT), o_orderkey,
  {_ORDERED} - INTERVAL '1' SECOND * 600, {_ORDERED}, CAST(NULL AS INT), CAST(NULL AS VARCHAR(10)), CAST(NULL AS VARCHAR(20))
FROM orders WHERE o_orderkey % 10 = 3""",
    # Products come and go, some rows are taken back, and every 6th key spikes on one day.
    "long_usage": """
SELECT CAST(1000 + l_suppkey % 24 % 3 AS BIGINT) AS workspace_id, CAST(l_shipdate AS DATE) AS usage_date,
  CASE l_linenumber % 3 WHEN 0 THEN 'JOBS_COMPUTE' WHEN 1 THEN 'SERVERLESS_SQL' ELSE 'ALL_PURPOSE_COMPUTE' END AS sku_name,
  CAST(CAST(l_quantity AS DECIMAL(12,2)) * CAST(CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN -0.1
    WHEN l_suppkey % 6 = 5 AND l_shipdate = TIMESTAMP '2001-06-29 00:00:00' THEN 90.0 ELSE 0.1 END AS DECIMAL(5,3)) AS DECIMAL(18,5)) AS usage_quantity,
  CASE WHEN l_orderkey % 97 = 0 THEN 'adhoc' ELSE CAST(CAST(FLOOR(l_suppkey % 24 / 3) AS BIGINT) AS VARCHAR(20)) END AS job_id,
  'c-1' AS cluster_id
FROM lineitem""",
    # Two periods for every tenth run.
    "run_periods": """
SELECT workspace_id, job_id, run_id, period_start_time, period_end_time, result_state FROM runs
UNION ALL
SELECT workspace_id, job_id, run_id, period_end_time, period_end_time + INTERVAL '1' SECOND * 600, result_state
FROM runs WHERE run_id % 10 = 3 AND period_end_time IS NOT NULL""",
    # Elapsed 0 to 490 minutes before the check time.
    "active_runs": f"""
SELECT {_WORKSPACE} AS workspace_id, {_JOB} AS job_id, event_id AS run_id,
  CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'QUEUED' WHEN 'purchase' THEN 'TERMINATING'
    ELSE 'RUNNING' END AS state,
  TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' SECOND * CAST(FLOOR(value * 60) AS INT) AS start_time
FROM events WHERE event_id % 50 = 0""",
    # Acknowledgements 0 to 47 hours old.
    "acks": f"""
SELECT CONCAT('failure_', CAST({_WORKSPACE} AS VARCHAR(20)), '_', CAST({_JOB} AS VARCHAR(20)),
    CASE WHEN user_id % 2 = 0 THEN '_single' ELSE '_yellow' END) AS condition_key,
  TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR * CAST(user_id % 48 AS INT) AS acknowledged_at
FROM (SELECT DISTINCT user_id FROM events) u""",
    # Valid, multiple, empty and invalid patterns; four kinds of time range.
    "presets": """
SELECT CAST(s_suppkey AS VARCHAR(20)) AS id, s_name AS name,
  CASE s_suppkey % 4 WHEN 0 THEN 'building' WHEN 2 THEN 'machinery' END AS team,
  CASE WHEN s_suppkey % 7 = 3 THEN CAST(s_suppkey AS VARCHAR(20)) END AS job_id,
  CASE s_suppkey % 6 WHEN 0 THEN 'etl-*' WHEN 1 THEN '*-daily,report-*' WHEN 2 THEN '*kafka?ingest*' WHEN 3 THEN ''
    WHEN 4 THEN '*CDC*' ELSE 'a|b' END AS job_name_patterns,
  CASE s_suppkey % 4 WHEN 0 THEN '7d' WHEN 1 THEN '30d' WHEN 2 THEN '90d' ELSE 'custom' END AS time_range,
  CASE WHEN s_suppkey % 4 = 3 THEN '2024-01-05' END AS start_date,
  CASE WHEN s_suppkey % 4 = 3 THEN '2024-01-20' END AS end_date,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(s_suppkey AS INT) AS created_at,
  s_suppkey % 7 <> 0 AS is_shared
FROM supplier""",
}

# Columns the views read. Declared, so that no footer has to be opened to plan a query.
RAW_TABLES = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "customer": "c_custkey long, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz",
}


def with_views(*names: str) -> str:
    """``WITH`` clause holding the named views and whatever they read."""
    needed: list[str] = []

    def visit(name: str) -> None:
        for dependency in [d for d in VIEWS if d != name and re.search(rf"FROM {d}\b", VIEWS[name])]:
            visit(dependency)
        if name not in needed:
            needed.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed) + "\n"


class SampleTables:
    """Engine inputs over one sample directory."""

    as_of = AS_OF
    as_of_ts = AS_OF_TS
    long_as_of = LONG_AS_OF

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.schema(RAW_TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def view(self, name: str) -> DataFrame:
        if name in self._views:
            return self._views[name]
        text = VIEWS[name]
        inputs: dict[str, DataFrame] = {}
        for table in [*RAW_TABLES, *VIEWS]:
            if re.search(rf"FROM {table}\b", text):
                text = re.sub(rf"FROM {table}\b", f"FROM {{{table}}}", text)
                inputs[table] = self.raw(table) if table in RAW_TABLES else self.view(table)
        self._views[name] = self.spark.sql(text, **inputs)
        return self._views[name]

    @property
    def runs(self) -> DataFrame:
        return self.view("runs")

    @property
    def run_periods(self) -> DataFrame:
        return self.view("run_periods")

    @property
    def active_runs(self) -> DataFrame:
        return self.view("active_runs")

    @property
    def jobs(self) -> DataFrame:
        """Job versions with their tags as a map; absent tags have no entry."""
        flat = self.view("jobs")
        tags = F.map_filter(
            F.create_map(
                *[
                    part
                    for key, column in [
                        ("team", "team"),
                        ("sla_minutes", "sla_minutes"),
                        ("budget_monthly_dbus", "budget_monthly_dbus"),
                        ("owner", "creator_user_name"),
                        ("output_tables", "output_tables"),
                    ]
                    for part in (F.lit(key), F.col(column))
                ]
            ),
            lambda _, value: value.isNotNull(),
        )
        return flat.select(
            "workspace_id", "job_id", "name", tags.alias("tags"), "creator_user_name", "change_time", "delete_time"
        )

    @property
    def usage(self) -> DataFrame:
        """Usage rows with the nested metadata record."""
        return self._nested_usage("usage")

    @property
    def long_usage(self) -> DataFrame:
        return self._nested_usage("long_usage")

    @property
    def long_runs(self) -> DataFrame:
        return self.view("long_runs")

    def _nested_usage(self, view: str) -> DataFrame:
        return self.view(view).select(
            "workspace_id",
            "usage_date",
            "sku_name",
            "usage_quantity",
            F.struct("job_id", "cluster_id").alias("usage_metadata"),
        )

    @property
    def lineage(self) -> DataFrame:
        flat = self.view("lineage")
        return flat.select(
            "workspace_id",
            "entity_type",
            F.struct(F.struct(F.col("job_id").cast("string").alias("job_id")).alias("job_info")).alias(
                "entity_metadata"
            ),
            "target_table_full_name",
            "event_time",
        )

    @property
    def acks(self) -> DataFrame:
        return self.view("acks")

    @property
    def presets(self) -> DataFrame:
        return self.view("presets")

    @property
    def table_snapshots(self) -> DataFrame:
        return self.view("table_snapshots")

    @property
    def column_snapshots(self) -> DataFrame:
        return self.view("column_snapshots")

    @property
    def column_history(self) -> DataFrame:
        return self.view("column_history")

    @property
    def ack_history(self) -> DataFrame:
        return self.view("ack_history")
