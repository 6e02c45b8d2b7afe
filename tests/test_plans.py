"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runledger.functions.timing import trailing
from runledger.operators import cost as C
from runledger.operators import health as H
from runledger.operators import jobs as J
from runledger.operators import ordering as O
from runledger.operators import runs as R
from runledger.operators.filters import apply_presets
from runledger.plans.alert_feed import alert_feed
from runledger.plans.health import health_rollup, job_health
from runledger.plans.reports import dashboard
from runledger.sources import readers
from tests.tables import AS_OF, JOB_SCHEMA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(checked, tmp_path_factory):
    """Inputs written as plain tables, as a user has them."""
    root = str(tmp_path_factory.mktemp("stored"))
    spark = checked.spark
    filled = checked.runs.withColumn("run_name", F.lit("n")).withColumn("run_type", F.lit("JOB"))
    for name in ("period_start_time", "period_end_time"):
        filled = filled.withColumn(name, F.col(name).cast("timestamp"))
    filled.write.parquet(f"{root}/runs")
    checked.usage.withColumn("usage_metadata", F.col("usage_metadata").withField("notebook_id", F.lit(""))).write.parquet(f"{root}/usage")
    checked.jobs.withColumn("run_as_user_name", F.lit("")).withColumn("change_time", F.col("change_time").cast("timestamp")).withColumn(
        "delete_time", F.col("delete_time").cast("timestamp")
    ).write.parquet(f"{root}/jobs")
    return {
        "runs": readers.read_runs(spark, f"{root}/runs"),
        "usage": readers.read_usage(spark, f"{root}/usage"),
        "jobs": readers.read_jobs(spark, f"{root}/jobs"),
    }


def test_results_on_stored_tables_are_the_same(stored, checked):
    mine = job_health(stored["runs"], stored["jobs"], checked.as_of).withColumn("last_run_time", F.col("last_run_time").cast("timestamp_ntz"))
    other = job_health(checked.runs, checked.jobs, checked.as_of)
    assert sorted(map(str, mine.collect())) == sorted(map(str, other.collect()))
    one = C.job_costs(stored["usage"], stored["jobs"], checked.as_of)
    two = C.job_costs(checked.usage, checked.jobs, checked.as_of)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_windows_and_columns_reach_the_scan(stored, checked):
    text = plan(H.run_stats(stored["runs"], checked.as_of))
    assert "GreaterThanOrEqual(period_start_time" in text
    assert "termination_code" not in text.split("ReadSchema")[1]
    assert "run_name" not in text.split("ReadSchema")[1]
    usage = plan(C.daily_job(stored["usage"], checked.as_of))
    assert "GreaterThanOrEqual(usage_date" in usage
    assert "cluster_id" not in usage.split("ReadSchema")[1]
    assert "sku_name" not in usage.split("ReadSchema")[1]


def test_ranks_are_limited_before_the_shuffle(stored, checked):
    for df in (J.latest_jobs(stored["jobs"]), R.last_two(stored["runs"], checked.as_of, 7), R.recent_runs(stored["runs"], 5)):
        text = plan(df)
        assert text.count("WindowGroupLimit") == 2
        assert text.index("Exchange") > text.index("Final") and text.index("Partial") > text.index("Exchange")


def test_one_shuffle_for_run_statistics(stored, checked):
    assert plan(H.run_stats(stored["runs"], checked.as_of)).count("Exchange") == 1


def test_health_joins_add_no_shuffle(stored, checked):
    spark = checked.spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(H.run_stats_with_last(stored["runs"], checked.as_of)).count("Exchange hashpartitioning") == 2
        # statistics, newest runs and names: three inputs, three shuffles
        assert plan(job_health(stored["runs"], stored["jobs"], checked.as_of)).count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_usage_is_read_once_by_all_alerts(stored, checked):
    t = checked
    df = alert_feed(stored["runs"], stored["usage"], stored["jobs"], t.active_runs, t.acks, t.as_of, t.as_of_ts)
    text = final_plan(df)
    assert text.count("usage_quantity") > 0
    assert sum("FileScan" in line and "usage_quantity" in line for line in text.splitlines()) == 1
    assert sum("FileScan" in line and "/runs]" in line for line in text.splitlines()) == 4


def test_cost_table_reads_usage_once(stored, checked):
    text = final_plan(C.job_costs(stored["usage"], stored["jobs"], checked.as_of))
    assert sum("FileScan" in line and "usage_quantity" in line for line in text.splitlines()) == 1


def test_rollup_reads_runs_twice(stored, checked):
    text = final_plan(health_rollup(stored["runs"], stored["jobs"], checked.as_of))
    assert sum("FileScan" in line and "/runs]" in line for line in text.splitlines()) == 2


def test_no_cross_joins_and_no_python(stored, checked):
    t = checked
    feed = alert_feed(stored["runs"], stored["usage"], stored["jobs"], t.active_runs, t.acks, t.as_of, t.as_of_ts)
    results = [
        feed,
        dashboard(job_health(stored["runs"], stored["jobs"], t.as_of), feed, C.job_costs(stored["usage"], stored["jobs"], t.as_of)),
        apply_presets(t.presets, stored["jobs"], t.as_of),
    ]
    for df in results:
        text = plan(df)
        assert "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text
        assert "Python" not in text and "Pandas" not in text


def test_pages_are_top_k(checked):
    text = plan(O.page(job_health(checked.runs, checked.jobs, checked.as_of), O.health_order(), 2, 50))
    assert "TakeOrderedAndProject" in text


def test_trailing_window_prunes_date_partitions(spark, tmp_path):
    days = spark.sql("SELECT id, date_add(DATE'2024-01-01', CAST(id AS INT)) AS usage_date FROM range(40)")
    days.write.partitionBy("usage_date").parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p").filter(trailing("usage_date", AS_OF, 7))
    assert "PartitionFilters: [isnotnull(usage_date" in plan(df)
    assert df.count() == 8


def test_a_hot_job_is_spread_in_run_level_joins(spark):
    runs = spark.range(2000).select(
        F.lit(1).cast("long").alias("workspace_id"), F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).cast("long").alias("job_id"),
        F.col("id").alias("run_id"),
    )
    versions = spark.createDataFrame([(1, n, f"n{n}", {}, "u", None, None) for n in range(50)], JOB_SCHEMA)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for found in (J.with_job_names(runs, versions, spread_by="run_id"), R.runs_for_jobs(runs, versions)):
            assert "_part" in plan(found).split("Exchange hashpartitioning", 1)[1]
            sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < 0.6 * sum(sizes)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert J.with_job_names(runs, versions, spread_by="run_id").count() == 2000
    assert R.runs_for_jobs(runs, versions).count() == 1025
