"""Every operator as a named query over the sample tables.

Results are flat: lists become text, decimals become doubles, doubles are rounded to six
places, so that another engine can be compared with them value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import display, naming, wording
from .functions.keys import JOB_KEY, in_workspace
from .functions.load import driver_utilization, utilization_label, worker_utilization
from .functions.numbers import rounded
from .functions.states import PRIORITY_ORDER, rank_of, traffic_light
from .functions.timing import between_days, elapsed_seconds, moment_like, trailing
from .operators import alerts as A
from .operators import cost as C
from .operators import filters as FL
from .operators import health as H
from .operators import integrity as I
from .operators import jobs as J
from .operators import ordering as O
from .operators import runs as R
from .operators import sketches as SK
from .operators import trends as TR
from .operators import utilization as U
from .plans import health as PH
from .plans import reports as RP
from .plans import rollups as RU
from .plans.alert_feed import alert_feed, all_alerts
from .plans.costs import cost_anomalies
from .session import shared_folder
from .sources import readers
from .sources.sample import VIEWS, SampleTables
from .streaming import failures as SF
from .streaming import rollup as SR
from .streaming import run_counts, runner, suppress

Query = Callable[[SparkSession, str], DataFrame]

DBU_RATE = 0.5
TEAM = "building"
PATTERNS = ["etl-*", "*-daily", "kafka?ingest-*"]


def tidy(df: DataFrame) -> DataFrame:
    """Comparable column types."""
    columns = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DoubleType):
            column = rounded(column, 6)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def list_text(array: Column, item: Callable[[Column], Column], separator: str = ";") -> Column:
    return F.array_join(F.transform(array, item), separator)


# --- inputs shared by several queries ---------------------------------------------------


def health(t: SampleTables, days: int = 7) -> DataFrame:
    return PH.job_health(t.runs, t.jobs, t.as_of, days)


def costs(t: SampleTables) -> DataFrame:
    return C.job_costs(t.usage, t.jobs, t.as_of, dbu_rate=DBU_RATE)


def feed(t: SampleTables, **options) -> DataFrame:
    return alert_feed(t.runs, t.usage, t.jobs, t.active_runs, t.acks, t.as_of, t.as_of_ts, **options)


def anomalies(t: SampleTables) -> DataFrame:
    return cost_anomalies(t.usage, t.runs, t.jobs, t.as_of)


def output_tables(t: SampleTables) -> DataFrame:
    return I.job_output_tables_with_fallback(t.lineage, t.jobs, t.as_of)


def live_feed(t: SampleTables) -> DataFrame:
    """The run table in the layout of the live feed: epoch milliseconds, 0 for no end."""
    millis = [F.unix_millis(F.col(c).cast("timestamp")) for c in ("period_start_time", "period_end_time")]
    return t.runs.select(
        *JOB_KEY,
        "run_id",
        F.lit(None).cast("string").alias("run_name"),
        F.when(F.col("period_end_time").isNull(), "RUNNING").otherwise("TERMINATED").alias("state"),
        "result_state",
        millis[0].alias("start_ms"),
        F.coalesce(millis[1], F.lit(0).cast("long")).alias("end_ms"),
    )


def stored(t: SampleTables, name: str, table: DataFrame) -> DataFrame:
    """Writes one rollup to the shared folder and reads it back."""
    path = shared_folder(t.spark)
    RU.refresh({name: table}, path)
    return RU.read_rollup(t.spark, path, name)


def stream_of_runs(t: SampleTables) -> DataFrame:
    """The run view over a stream of the event files.

    The path is written as a glob because the file source takes a plain path for a folder.
    """
    events = t.raw("events")
    stream = t.spark.readStream.schema(events.schema).parquet(f"{t.sf_dir}/{{events}}.parquet")
    return t.spark.sql(VIEWS["runs"].replace("FROM events", "FROM {events}"), events=stream)


# --- queries with more than one step ----------------------------------------------------


def job_output_lists(t: SampleTables) -> DataFrame:
    return I.table_name_parts(output_tables(t)).select(
        *JOB_KEY, "table_name", "catalog_part", "schema_part", "table_part"
    )


def preset_changes(t: SampleTables) -> DataFrame:
    """90-day presets are shortened to 30 days, presets that are not shared are deleted."""
    upserts = t.presets.filter("time_range = '90d' AND is_shared").withColumn("time_range", F.lit("30d"))
    deleted = t.presets.filter("NOT is_shared").select("id")
    return FL.apply_preset_changes(t.presets, upserts.withColumn("created_by", F.lit("batch")), deleted)


def status_of_jobs(t: SampleTables) -> DataFrame:
    stats = H.run_stats(t.runs, t.as_of)
    return stats.select(*JOB_KEY, "success_rate", traffic_light(F.col("success_rate")).alias("status"))


def sku_categories(t: SampleTables) -> DataFrame:
    return (
        t.usage.groupBy("sku_name")
        .agg(F.count(F.lit(1)).alias("usage_rows"))
        .withColumn("sku_category", naming.sku_category(F.col("sku_name")))
    )


def streaming_jobs(t: SampleTables) -> DataFrame:
    name = F.col("name")
    return J.latest_jobs(t.jobs).select(*JOB_KEY, "name", naming.is_streaming_name(name).alias("is_streaming"))


def utilization_labels(t: SampleTables) -> DataFrame:
    used = U.cluster_utilization(t.runs, t.usage, t.as_of)
    return used.select(
        *JOB_KEY, "worker_cpu_percent", utilization_label(F.col("worker_cpu_percent")).alias("label")
    )


def rates_to_utilization(t: SampleTables) -> DataFrame:
    rate = rounded(F.col("avg_dbus_per_hour"), 6)
    return U.run_dbu_rate(t.runs, t.usage, t.as_of).select(
        *JOB_KEY, worker_utilization(rate).alias("worker_percent"), driver_utilization(rate).alias("driver_percent")
    )


def headlines(t: SampleTables) -> DataFrame:
    cost = TR.trend_headline(TR.trend_cost(t.usage, t.as_of, 14), 14)
    success = TR.trend_headline(TR.trend_success(t.runs, t.as_of, 7), 7, "rate")
    failures = TR.trend_headline(TR.trend_failures(t.runs, t.as_of, 14), 14)
    named = [("cost", cost), ("success", success), ("failures", failures)]
    parts = [df.withColumn("series", F.lit(name)) for name, df in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def recent_lists(t: SampleTables) -> DataFrame:
    ids = t.jobs.select(*JOB_KEY)
    lists = R.recent_runs_by_job(t.run_periods, ids, t.as_of)
    text = list_text(
        F.col("recent_runs"),
        lambda r: F.concat_ws(":", r.run_id.cast("string"), r.result_state, r.duration_seconds.cast("string")),
    )
    return lists.select(*JOB_KEY, text.alias("recent_runs"))


def active_history(t: SampleTables) -> DataFrame:
    text = list_text(F.col("recent_runs"), lambda r: F.concat_ws(":", r.run_id.cast("string"), r.result_state))
    return R.active_with_history(t.active_runs, t.runs, as_of=t.as_of, days=30).select(
        *JOB_KEY, "run_id", "state", "start_time", text.alias("recent_runs")
    )


def joined_reasons(t: SampleTables) -> DataFrame:
    return H.failure_reasons(t.runs, t.as_of).withColumn("failure_reasons", F.array_join("failure_reasons", ","))


def reason_advice(t: SampleTables) -> DataFrame:
    reasons = H.failure_reasons(t.runs, t.as_of, 30)
    return reasons.select(
        *JOB_KEY,
        F.array_join("failure_reasons", ",").alias("failure_reasons"),
        wording.failure_remediation(F.col("failure_reasons")).alias("remediation"),
    )


def alert_advice(t: SampleTables) -> DataFrame:
    """SLA, spike, budget and cluster advice for every active run, measured against 300 minutes."""
    minutes = F.lit(300)
    seconds = elapsed_seconds(F.col("start_time"), moment_like(t.active_runs, "start_time", t.as_of_ts))
    pct = F.col("elapsed") * 100.0 / (minutes * 60)
    return t.active_runs.select(*JOB_KEY, "run_id", seconds.alias("elapsed")).select(
        *JOB_KEY,
        "run_id",
        wording.sla_remediation(pct, minutes).alias("sla"),
        wording.spike_remediation(rounded(pct / 10, 2), F.lit(2.5)).alias("spike"),
        wording.budget_remediation(pct).alias("budget"),
        wording.cluster_remediation(rounded(pct, 2), F.lit(5)).alias("cluster"),
    )


def row_counts(t: SampleTables) -> DataFrame:
    text = list_text(
        F.col("trend"), lambda p: F.concat_ws("=", p.snapshot_date.cast("string"), p.row_count.cast("string"))
    )
    return I.row_count_delta(t.table_snapshots).withColumn("trend", text)


def row_count_report(t: SampleTables) -> DataFrame:
    deltas = I.row_count_delta(t.table_snapshots)
    return deltas.select(
        "table_name",
        display.count_text(F.col("current_row_count") * 1500).alias("rows"),
        display.delta_text(F.col("delta_percent")).alias("delta"),
    )


def drift(t: SampleTables) -> DataFrame:
    changes = list_text(F.col("type_changes"), lambda c: F.concat_ws(":", c.column_name, c.old_type, c.new_type))
    return I.schema_drift(t.column_snapshots).select(
        "table_name",
        "has_drift",
        F.array_join("added_columns", ",").alias("added_columns"),
        F.array_join("removed_columns", ",").alias("removed_columns"),
        changes.alias("type_changes"),
    )


def details(t: SampleTables) -> DataFrame:
    text = list_text(
        F.col("recent_runs"),
        lambda r: F.concat_ws(
            ":",
            r.run_id.cast("string"),
            F.coalesce(r.result_state, F.lit("-")),
            F.coalesce(r.duration_seconds.cast("string"), F.lit("-")),
            r.is_anomaly.cast("string"),
        ),
    )
    return (
        PH.job_details(t.runs, t.jobs, t.as_of)
        .withColumn("recent_runs", text)
        .withColumn("failure_reasons", F.array_join("failure_reasons", ","))
    )


def health_by_priority(t: SampleTables) -> DataFrame:
    ordered = PH.health_ordered(health(t))
    return ordered.select(*JOB_KEY, "priority", "success_rate", rank_of(F.col("priority"), PRIORITY_ORDER).alias("rank"))


def alerts_by_severity(t: SampleTables) -> DataFrame:
    ordered = feed(t).orderBy(*O.alert_order())
    return ordered.select("condition_key", "severity", A.severity_rank().alias("rank"))


def jobs_by_sla(t: SampleTables) -> DataFrame:
    tagged = health(t).join(J.job_tags(t.jobs).select(*JOB_KEY, "sla_minutes"), JOB_KEY, "left")
    return O.sort_jobs(tagged, "sla_minutes", "desc").select(*JOB_KEY, "job_name", "sla_minutes", "sort_key")


def active_names(t: SampleTables) -> DataFrame:
    return R.active_in_state(J.with_job_names(t.active_runs, t.jobs), "all")


def rollup_age(t: SampleTables) -> DataFrame:
    table = health(t).withColumn("refreshed_at", F.col("last_run_time").cast("timestamp"))
    return RU.freshness(stored(t, RU.HEALTH, table), t.as_of_ts, timedelta(hours=1))


def wide_health(t: SampleTables) -> DataFrame:
    return RU.with_refresh_time(PH.health_rollup(t.runs, t.jobs, t.as_of), t.as_of_ts)


def refreshed(t: SampleTables) -> DataFrame:
    """Refreshes all three rollups; rows written per table as counted by the write."""
    tables = RU.build(t.runs, t.usage, t.jobs, t.as_of, t.as_of_ts)
    counts = RU.refresh(tables, shared_folder(t.spark))
    return t.spark.createDataFrame(list(counts.items()), "rollup string, rows_written long")


def stored_costs(t: SampleTables, limit: int | None = None) -> DataFrame:
    return RU.read_cost(stored(t, RU.COST, costs(t)), limit)


def evolved_costs(t: SampleTables) -> DataFrame:
    """Rows of one workspace written before a column existed, the others with it."""
    table = costs(t)
    old = stored(t, RU.COST, table.filter("workspace_id = 1000").drop("trend_7d_percent"))
    return RU.evolve(old, stored(t, RU.COST, table.filter("workspace_id <> 1000"))).select(*table.columns)


def catalog_costs(t: SampleTables) -> DataFrame:
    """The cost rollup by way of a catalog table that is refreshed twice."""
    path = shared_folder(t.spark)
    namespace = f"runledger_{path.rsplit('/', 1)[-1]}"
    for table in (costs(t).limit(0), costs(t)):
        RU.refresh_tables(t.spark, {RU.COST: table}, namespace, location=path)
    return t.spark.read.table(f"{namespace}.{RU.COST}")


def stored_alerts(t: SampleTables) -> DataFrame:
    table = stored(t, RU.ALERTS, RU.alerts_rollup(t.runs, t.usage, t.jobs, t.as_of))
    return RU.read_alerts(table, 1001)


def state_size(t: SampleTables) -> int:
    return t.spark.sparkContext.defaultParallelism


def streamed_counts(t: SampleTables) -> DataFrame:
    path = shared_folder(t.spark)
    runner.drain_append(run_counts.stream_run_counts(stream_of_runs(t)), path, state_size(t))
    return t.spark.read.parquet(f"{path}/rows")


def fed_in_parts(t: SampleTables, path: str, handle: Callable[[DataFrame, int], None], of=lambda runs: runs, **how) -> None:
    """Feeds the runs of four stretches of time one after the other, each as a batch of its own."""
    events, cuts = t.raw("events"), [None, *(t.as_of - timedelta(days=d) for d in (23, 15, 7)), None]
    for since, until in zip(cuts[:-1], cuts[1:], strict=True):
        after = F.lit(True) if since is None else F.col("ts") >= F.lit(since)
        before = F.lit(True) if until is None else F.col("ts") < F.lit(until)
        events.filter(after & before).write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(events.schema).parquet(f"{path}/in")
        runs = t.spark.sql(VIEWS["runs"].replace("FROM events", "FROM {events}"), events=stream)
        runner.drain_batches(of(runs), path, handle, **how)


def streamed_failures(t: SampleTables) -> DataFrame:
    path = shared_folder(t.spark)
    fed_in_parts(t, path, runner.write_batch(path), SF.last_states, mode="update", partitions=state_size(t), store=runner.STORE)
    return SF.latest_per_job(t.spark.read.parquet(f"{path}/rows"))


def streamed_rollup(t: SampleTables) -> DataFrame:
    """The check day is the day after the newest run, so it moves with every batch."""
    path = shared_folder(t.spark)
    fed_in_parts(t, path, SR.refresh_rollup(t.jobs, path, as_of=lambda seen, before: seen + timedelta(days=1) if seen else before, buckets=state_size(t)))
    return SR.health_written(t.spark, path)


def streamed_conditions(t: SampleTables) -> DataFrame:
    path = shared_folder(t.spark)
    fed_in_parts(t, path, suppress.suppress_repeats(path, buckets=state_size(t)), suppress.failure_conditions)
    return t.spark.read.parquet(f"{path}/rows").select("condition_key", "raised_at")


def sketch_table(t: SampleTables) -> DataFrame:
    """The daily sketches, written and read again."""
    path = shared_folder(t.spark)
    SK.refresh_days(SK.daily_sketches(t.runs), path)
    return SK.read_days(t.spark, path)


def merged_windows(t: SampleTables) -> DataFrame:
    """Three windows from one sketch table, with the exact ranks of its quantiles."""
    table, found = sketch_table(t), None
    for days in (7, 30, 90):
        exact = H.duration_histogram(t.runs, t.as_of, days, effective=True)
        one = SK.rank_checked(SK.merged_durations(table, t.as_of, days), exact).withColumn("window_days", F.lit(days))
        found = one if found is None else found.unionByName(one)
    return found


def sketched_rates(t: SampleTables) -> DataFrame:
    exact = U.run_dbu_rate(t.runs, t.usage, t.as_of)
    merged = SK.merged_dbu_rate(sketch_table(t), t.usage, t.as_of).withColumnRenamed("runs_analyzed", "estimate")
    both = exact.select(*JOB_KEY, "runs_analyzed").join(merged, JOB_KEY)
    within = F.abs(F.col("estimate") - F.col("runs_analyzed")) <= F.col("runs_analyzed") * SK.COUNT_ERROR
    return both.select(*JOB_KEY, "avg_dbus_per_hour", "runs_analyzed", within.alias("within_bound"))


def drift_history(t: SampleTables) -> DataFrame:
    changes = F.transform("type_changes", lambda c: F.concat_ws(":", c.column_name, c.old_type, c.new_type))
    return I.schema_history(t.column_history).select(
        "table_name",
        "snapshot_version",
        "has_drift",
        F.array_join("added_columns", ",").alias("added_columns"),
        F.array_join("removed_columns", ",").alias("removed_columns"),
        F.array_join(changes, ";").alias("type_changes"),
    )


# --- the catalogue ----------------------------------------------------------------------

CATALOGUE: dict[str, Callable[[SampleTables], DataFrame]] = {
    # sources and sinks
    "list_runs": lambda t: R.list_runs(t.runs, t.as_of),
    "newest_runs": lambda t: R.list_runs(t.runs, t.as_of, limit=1000),
    "list_jobs": lambda t: J.list_jobs(t.jobs).select(*JOB_KEY, "name", "creator_user_name"),
    "first_jobs": lambda t: J.list_jobs(t.jobs, 1000).select(*JOB_KEY, "name", "creator_user_name"),
    "usage_daily": lambda t: C.usage_daily(t.usage, t.as_of),
    "usage_daily_top": lambda t: C.usage_daily(t.usage, t.as_of, limit=1000),
    "unreadable_job_ids": lambda t: readers.unreadable_job_ids(t.usage),
    "job_output_tables": lambda t: I.job_output_tables(t.lineage, t.as_of),
    "job_output_tables_first": lambda t: I.job_output_tables(t.lineage, t.as_of, limit=5),
    "job_output_tables_fallback": output_tables,
    "table_name_parts": job_output_lists,
    "active_runs": lambda t: R.open_runs(t.runs),
    "job_tags": lambda t: J.job_tags(t.jobs),
    "epoch_ms_to_ts": lambda t: readers.live_runs(live_feed(t)).drop("run_name"),
    "refresh_rollups": refreshed,
    "read_health_rollup": lambda t: RU.read_health(stored(t, RU.HEALTH, wide_health(t)), 7),
    "read_health_rollup_30d": lambda t: RU.read_health(stored(t, RU.HEALTH, wide_health(t)), 30),
    "read_cost_rollup": stored_costs,
    "read_cost_rollup_top": lambda t: stored_costs(t, 500),
    "rollup_schema_evolution": evolved_costs,
    "catalog_refresh": catalog_costs,
    "read_alerts_rollup": stored_alerts,
    "read_duration_rollup": lambda t: RU.read_durations(
        stored(t, RU.HEALTH, wide_health(t)), J.jobs_of_team(t.jobs, TEAM)
    ),
    "rollup_freshness": rollup_age,
    "list_presets": lambda t: FL.list_presets(t.presets),
    "apply_preset_changes": preset_changes,
    # projections, filters, predicates
    "window_filter": lambda t: t.runs.filter(trailing("period_start_time", t.as_of, 7)).select(*JOB_KEY, "run_id"),
    "custom_window_filter": lambda t: t.runs.filter(
        between_days("period_start_time", t.as_of - timedelta(days=20), t.as_of - timedelta(days=10))
    ).select(*JOB_KEY, "run_id"),
    "workspace_filter": lambda t: in_workspace(t.runs, "1001").select(*JOB_KEY, "run_id"),
    "run_outcomes": lambda t: R.run_outcomes(t.runs),
    "effective_duration": lambda t: R.effective_durations(t.runs),
    "name_patterns": lambda t: J.jobs_matching(t.jobs, PATTERNS),
    "validate_patterns": lambda t: FL.validate_patterns(t.presets),
    "recent_jobs": lambda t: FL.recent_jobs(health(t), t.as_of_ts, 6).select(*JOB_KEY, "job_name", "last_run_time"),
    "search_jobs": lambda t: FL.search_jobs(health(t), "ETL").select(*JOB_KEY, "job_name"),
    "search_alerts": lambda t: A.search_alerts(feed(t), "Budget").select("condition_key", "title"),
    "filter_alerts": lambda t: A.filter_alerts(feed(t), ["p1", "P2"], ["failure", "cost"], False).select(
        "condition_key", "severity", "category"
    ),
    "filter_active_state": lambda t: R.active_in_state(t.active_runs, "PENDING"),
    "job_status": status_of_jobs,
    "job_priority": lambda t: H.job_priorities(t.runs, t.as_of),
    "sku_category": sku_categories,
    "streaming_jobs": streaming_jobs,
    "long_running": lambda t: R.long_running(t.active_runs, t.jobs, t.as_of_ts),
    "runs_for_jobs": lambda t: R.runs_for_jobs(t.runs, J.jobs_of_team(t.jobs, TEAM), t.as_of, 30).select(*JOB_KEY, "run_id"),
    "duration_anomalies": lambda t: H.duration_anomalies(t.runs, t.as_of),
    "apply_presets": lambda t: FL.apply_presets(t.presets, t.jobs, t.as_of),
    "apply_chosen_presets": lambda t: FL.apply_presets(t.presets, t.jobs, t.as_of, ["1", "2", "4", "10"]),
    "utilization_label": utilization_labels,
    # joins
    "run_names": lambda t: J.with_job_names(t.runs.select(*JOB_KEY, "run_id"), t.jobs, spread_by="run_id"),
    "cost_spikes": lambda t: C.cost_spikes(t.usage, t.jobs, t.as_of),
    "top_cost_spikes": lambda t: C.cost_spikes(t.usage, t.jobs, t.as_of, limit=50),
    "cost_spikes_daily_mean": lambda t: C.cost_spikes(t.usage, t.jobs, t.as_of, unit="daily_mean"),
    "cost_spikes_daily_mean_long": lambda t: C.cost_spikes(t.long_usage, t.jobs, t.long_as_of, unit="daily_mean"),
    "run_dbu_rate": lambda t: U.run_dbu_rate(t.runs, t.usage, t.as_of),
    "run_dbu_rate_allocated": lambda t: U.run_dbu_rate(t.runs, t.usage, t.as_of, allocate=True),
    "zombie_jobs": lambda t: C.zombie_jobs(t.usage, t.runs, t.jobs, t.as_of),
    "trend_cost_team": lambda t: TR.trend_cost(t.usage, t.as_of, 14, t.jobs, TEAM),
    "budget_alerts": lambda t: A.budget_alerts(t.usage, t.jobs, t.as_of),
    "ack_alerts": lambda t: A.acknowledge(A.failure_alerts(t.runs, t.jobs, t.as_of), t.acks, t.as_of_ts).select(
        "condition_key", "acknowledged", "acknowledged_at"
    ),
    "cost_anomalies": anomalies,
    "cost_anomalies_90d": lambda t: cost_anomalies(t.long_usage, t.long_runs, t.jobs, t.long_as_of, 90),
    "recent_runs_by_job": recent_lists,
    "active_with_history": active_history,
    # aggregations
    "run_stats": lambda t: H.run_stats_with_last(t.runs, t.as_of).select(
        *JOB_KEY, "total_runs", "success_count", "failed_count", "open_runs", "last_run_time", "last_duration_seconds"
    ),
    "success_rate": lambda t: H.success_rates(t.runs, t.as_of),
    "success_rate_90d": lambda t: H.success_rates(t.long_runs, t.long_as_of, 90),
    "retry_counts_90d": lambda t: H.retry_counts_distinct(t.long_runs, t.long_as_of, 90),
    "retry_counts": lambda t: H.retry_counts(t.runs, t.as_of),
    "retry_counts_distinct": lambda t: H.retry_counts_distinct(t.runs, t.as_of),
    "duration_stats": lambda t: H.duration_stats(t.runs, t.as_of),
    "suggested_sla": lambda t: H.suggested_sla(t.runs, t.jobs, t.as_of),
    "cost_job_sku": lambda t: C.cost_job_sku(t.usage, t.as_of),
    "cost_job": lambda t: C.cost_job(t.usage, t.as_of),
    "cost_trend": lambda t: C.cost_trend(t.usage, t.as_of),
    "cost_baseline": lambda t: C.cost_baseline(t.usage, t.as_of),
    "cost_by_sku": lambda t: C.cost_by_sku(t.usage, t.as_of),
    "team_costs": lambda t: C.team_costs(costs(t), DBU_RATE),
    "cost_totals": lambda t: C.cost_totals(costs(t), DBU_RATE),
    "usage_by_job": lambda t: C.usage_by_job(t.usage, t.as_of),
    "failure_reasons": joined_reasons,
    "month_usage": lambda t: C.month_usage(t.usage, t.as_of),
    "run_spans": lambda t: R.run_spans(t.run_periods, t.as_of),
    "trend_cost": lambda t: TR.trend_cost(t.usage, t.as_of, 14),
    "trend_cost_weekly": lambda t: TR.trend_cost(t.usage, t.as_of, 60),
    "trend_success": lambda t: TR.trend_success(t.runs, t.as_of, 7),
    "trend_success_weekly": lambda t: TR.trend_success(t.runs, t.as_of, 60),
    "trend_cost_weekly_long": lambda t: TR.trend_cost(t.long_usage, t.long_as_of, 60),
    "trend_success_weekly_long": lambda t: TR.trend_success(t.long_runs, t.long_as_of, 60),
    "health_open_long": lambda t: H.run_stats(t.long_runs, t.long_as_of, 30).select(*JOB_KEY, "total_runs", "open_runs"),
    "trend_success_team": lambda t: TR.trend_success(t.runs, t.as_of, 14, t.jobs, TEAM),
    "trend_failures": lambda t: TR.trend_failures(t.runs, t.as_of, 14),
    "trend_headline": headlines,
    "health_counts": lambda t: PH.health_counts(health(t)),
    "health_summary": lambda t: PH.health_summary(t.runs, t.as_of),
    "alert_counts": lambda t: A.alert_counts(feed(t)),
    "unacked_count": lambda t: A.unacknowledged_count(feed(t)),
    "highest_severity": lambda t: A.highest_severity(feed(t)),
    "active_summary": lambda t: R.active_summary(t.active_runs),
    "sla_breach_history": lambda t: H.sla_breach_history(t.runs, t.jobs, t.as_of),
    "row_count_delta": row_counts,
    "dashboard": lambda t: RP.dashboard(health(t), feed(t), costs(t)),
    # ranking
    "latest_jobs": lambda t: J.latest_jobs(t.jobs).select(*JOB_KEY, "name", "creator_user_name", "change_time"),
    "consecutive_failures": lambda t: R.consecutive_failures(t.runs, t.as_of),
    "recent_runs_30d": lambda t: R.recent_runs(t.long_runs, 3, as_of=t.long_as_of, days=30).select(
        *JOB_KEY, "run_id", "period_start_time", "rn"
    ),
    "recent_runs": lambda t: R.recent_runs(t.runs, 10).select(*JOB_KEY, "run_id", "period_start_time", "result_state", "rn"),
    # order, top-k, pages
    "health_ordered": health_by_priority,
    "alerts_ordered": alerts_by_severity,
    "sort_jobs": jobs_by_sla,
    "sort_alerts": lambda t: O.sort_alerts(feed(t), "title", "asc").select("condition_key", "title", "sort_key"),
    "sort_costs": lambda t: O.sort_costs(costs(t), "team", "asc").select(*JOB_KEY, "team", "sort_key"),
    "sort_teams": lambda t: O.sort_teams(C.team_costs(costs(t)), "job_count").select("team", "job_count", "sort_key"),
    "sort_active": lambda t: O.sort_active(active_names(t)).select(*JOB_KEY, "run_id", "state", "sort_key"),
    "top_cost_jobs": lambda t: C.top_cost_jobs(costs(t), 100).select(*JOB_KEY, "job_name", "total_dbus_30d"),
    "page_jobs": lambda t: O.page(health(t), O.health_order(), 2, 50).select(*JOB_KEY, "priority", "success_rate"),
    "page_jobs_after": lambda t: O.page_after(health(t), O.health_keys(), [3, 80.0, 1000, 0], 50).select(
        *JOB_KEY, "priority", "success_rate"
    ),
    "page_alerts": lambda t: O.page(feed(t), O.alert_order(), 1, 50).select("condition_key", "severity"),
    "page_info": lambda t: O.page_info(health(t), 2, 50),
    # set operations
    "all_alerts": lambda t: all_alerts(t.runs, t.usage, t.jobs, t.active_runs, t.as_of, t.as_of_ts),
    "dedupe_alerts": lambda t: A.dedupe_alerts(
        all_alerts(t.runs, t.usage, t.jobs, t.active_runs, t.as_of, t.as_of_ts)
    ),
    "schema_drift": drift,
    # scalar
    "parse_sku_breakdown": lambda t: C.parse_sku_breakdown(C.cost_job(t.usage, t.as_of)),
    "failure_remediation": reason_advice,
    "remediation": alert_advice,
    "dbu_utilization": rates_to_utilization,
    "formatted_report": lambda t: RP.formatted_report(costs(t), H.duration_stats(t.runs, t.as_of), DBU_RATE),
    "formatted_row_counts": row_count_report,
    # composites
    "job_health": lambda t: health(t),
    "job_health_30d": lambda t: health(t, 30),
    "job_details": details,
    "job_costs": costs,
    "job_costs_7d": lambda t: C.job_costs(t.long_usage, t.jobs, t.long_as_of, 7, DBU_RATE),
    "job_costs_90d": lambda t: C.job_costs(t.long_usage, t.jobs, t.long_as_of, 90, DBU_RATE),
    "failure_alerts": lambda t: A.failure_alerts(t.runs, t.jobs, t.as_of),
    "sla_alerts": lambda t: A.sla_alerts(t.active_runs, t.jobs, t.as_of_ts),
    "overprovision_alerts": lambda t: A.overprovision_alerts(t.runs, t.usage, t.jobs, t.as_of),
    "cluster_utilization": lambda t: U.cluster_utilization(t.runs, t.usage, t.as_of),
    "alerts": feed,
    "report_daily": lambda t: RP.report_daily(health(t), feed(t)),
    "report_daily_alerts": lambda t: RP.report_daily_alerts(feed(t)),
    "report_weekly": lambda t: RP.report_weekly(costs(t), anomalies(t)),
    "report_weekly_teams": lambda t: RP.report_weekly_teams(C.team_costs(costs(t))),
    "report_monthly": lambda t: RP.report_monthly(health(t, 30), costs(t), DBU_RATE),
    "report_monthly_teams": lambda t: RP.report_monthly_teams(C.team_costs(costs(t))),
    # history and stored parts
    "duration_windows": merged_windows,
    "run_dbu_rate_sketched": sketched_rates,
    "run_names_then": lambda t: J.with_names_then(t.runs.select(*JOB_KEY, "run_id", "period_start_time"), t.jobs, parts=4),
    "ack_history": lambda t: A.acknowledge_history(suppress.failure_conditions(t.runs).distinct(), t.ack_history, parts=2),
    "schema_history": drift_history,
    "row_count_history": lambda t: I.row_count_history(t.table_snapshots, stretch=7),
    "team_and_total_costs": lambda t: C.team_and_total_costs(costs(t), DBU_RATE),
    # streaming
    "stream_run_counts": streamed_counts,
    "stream_consecutive_failures": streamed_failures,
    "stream_refresh_rollup": streamed_rollup,
    "stream_alert_dedupe": streamed_conditions,
}


def query(name: str) -> Query:
    build = CATALOGUE[name]
    return lambda spark, sf_dir: tidy(build(SampleTables(spark, sf_dir)))


def queries() -> dict[str, Query]:
    return {name: query(name) for name in CATALOGUE}
