from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from runledger.functions.keys import in_workspace
from runledger.functions.states import traffic_light
from runledger.operators import health as H
from runledger.operators import jobs as J
from runledger.operators import runs as R
from runledger.plans.health import health_rollup, health_summary, job_details, job_health
from tests.tables import AS_OF, by_job, job, jobs, run, runs


def test_priorities_follow_the_last_two_finished_runs(spark):
    table = runs(
        spark,
        [
            run(1, 1, "FAILED", hour=1), run(1, 2, "FAILURE", hour=2),
            run(2, 3, "SUCCESS", hour=1), run(2, 4, "failed", hour=2),
            run(3, 5, "FAILED", hour=1), run(3, 6, "SUCCEEDED", hour=2),
            # an open run in front does not hide the two failures behind it
            run(4, 7, "FAILED", hour=1), run(4, 8, "FAILED", hour=2), run(4, 9, None, hour=3),
            # ERROR is neither success nor failure
            run(5, 10, "FAILED", hour=1), run(5, 11, "ERROR", hour=2),
        ],
    )
    assert by_job(H.job_priorities(table, AS_OF), "priority") == {1: "P1", 2: "P2", 3: None, 4: "P1", 5: None}
    flags = by_job(R.consecutive_failures(table, AS_OF), "last_state", "consecutive_failure")
    assert flags[4] == ("FAILED", True)
    assert flags[2] == ("FAILED", False)


def test_equal_start_times_are_ordered_by_run_id(spark):
    rows = [run(1, 1, "FAILED"), run(1, 2, "SUCCESS")]
    for given in (rows, rows[::-1]):
        assert by_job(R.consecutive_failures(runs(spark, given), AS_OF), "last_state") == {1: "SUCCESS"}


def test_rate_bands(spark):
    rates = spark.createDataFrame([(1, 69.9), (2, 70.0), (3, 89.9), (4, 90.0)], "job_id long, rate double")
    lights = by_job(rates.withColumn("light", traffic_light(F.col("rate"))), "light")
    assert lights == {1: "red", 2: "yellow", 3: "yellow", 4: "green"}


def test_seventy_percent_is_p3(spark):
    rows = [run(1, n, "SUCCESS" if n > 3 else "FAILED", day=28, hour=n) for n in range(1, 11)]
    rows += [run(2, 100 + n, "SUCCESS" if n > 4 else "CANCELED", day=28, hour=n) for n in range(1, 11)]
    result = by_job(job_health(runs(spark, rows), jobs(spark, [job(1, "a")]), AS_OF), "success_rate", "priority", "job_name")
    assert result == {1: (70.0, "P3", "a"), 2: (60.0, None, "job-2")}


def test_same_job_id_in_two_workspaces_stays_apart(spark):
    table = runs(spark, [run(1, 1, "FAILED", ws=1), run(1, 2, "SUCCESS", ws=2)])
    names = jobs(spark, [job(1, "first", ws=1), job(1, "second", ws=2)])
    rows = {(r.workspace_id, r.job_name, r.success_rate) for r in job_health(table, names, AS_OF).collect()}
    assert rows == {(1, "first", 0.0), (2, "second", 100.0)}
    assert job_health(table, names, AS_OF, workspace_id="2").count() == 1
    assert in_workspace(table, "all").count() == 2
    with pytest.raises(ValueError):
        in_workspace(table, "1 OR 1=1")


def test_deleted_job_does_not_return_through_an_older_version(spark):
    versions = jobs(spark, [job(1, "old", changed=1), job(1, "gone", changed=2, deleted=2), job(2, "kept")])
    assert by_job(J.latest_jobs(versions), "name") == {2: "kept"}
    assert by_job(J.latest_jobs(versions, include_deleted=True), "name") == {1: "gone", 2: "kept"}


def test_retries_count_runs_beyond_the_first_of_a_day(spark):
    rows = [run(1, n, "SUCCESS", day=30, hour=n) for n in range(1, 4)] + [run(1, 9, "SUCCESS", day=29)]
    rows += [run(1, 10, None, day=28), run(2, 11, "SUCCESS", day=24), run(2, 12, "SUCCESS", day=23)]
    table = runs(spark, rows)
    assert by_job(H.retry_counts(table, AS_OF), "retry_count") == {1: 2, 2: 0}
    assert by_job(H.retry_counts_distinct(table, AS_OF), "retry_count") == {1: 2, 2: 0}


def test_durations(spark):
    four = [run(1, n, "SUCCESS", hour=n, seconds=60 * n) for n in range(1, 5)]
    five = [run(2, 10 + n, "SUCCESS", hour=n, seconds=60 * n) for n in range(1, 6)]
    stats = H.duration_stats(runs(spark, four + five), AS_OF)
    picked = by_job(stats, "median_duration_seconds", "p90_duration_seconds", "run_count", "has_sufficient_data")
    assert picked[1] == (150.0, pytest.approx(222.0), 4, False)
    assert picked[2] == (180.0, pytest.approx(276.0), 5, True)
    approximate = by_job(H.duration_stats(runs(spark, five), AS_OF, approximate=True), "median_duration_seconds")
    assert approximate == {2: 180.0}


def test_effective_duration_uses_whole_elapsed_seconds(spark):
    table = runs(
        spark,
        [
            run(1, 1, "SUCCESS", seconds=30, recorded=0), run(2, 2, "SUCCESS", seconds=30, recorded=None),
            run(3, 3, "SUCCESS", seconds=30, recorded=7), run(4, 4, "SUCCESS", seconds=0, recorded=0), run(5, 5, None),
        ],
    )
    assert by_job(R.effective_durations(table), "effective_seconds") == {1: 30, 2: 30, 3: 7}


def test_suggested_sla_only_without_tag(spark):
    rows = [run(j, 10 * j + n, "SUCCESS", hour=n, seconds=61) for j in (1, 2) for n in range(1, 6)]
    names = jobs(spark, [job(1, "a"), job(2, "b", sla_minutes=9)])
    assert by_job(H.suggested_sla(runs(spark, rows), names, AS_OF), "suggested_p90_minutes") == {1: 2}


def test_suggested_sla_is_rounded_up_as_sql_rounds_it(spark):
    """The p90 lies at a whole minute, and in doubles beside it; equal neighbours and one run per hour."""
    seconds = {1: [600] * 6 + [750], 2: [684] * 6 + [924], 3: [600] * 7, 4: [61] * 9 + [7200], 5: [120, 60, 60, 60, 60]}
    rows = [run(j, 100 * j + n, "SUCCESS", hour=n, seconds=s) for j, some in seconds.items() for n, s in enumerate(some)]
    names = jobs(spark, [job(j, "a") for j in seconds])
    text = "SELECT CAST(CEIL(quantile_cont(x, 0.9) / 60) AS INTEGER) FROM (SELECT unnest(?::DOUBLE[]) AS x)"
    want = {j: duckdb.execute(text, [some]).fetchone()[0] for j, some in seconds.items()}
    assert by_job(H.suggested_sla(runs(spark, rows), names, AS_OF), "suggested_p90_minutes") == want


def test_unusable_tags_are_null(spark):
    tags = J.job_tags(jobs(spark, [job(1, "a", sla_minutes="x", budget_monthly_dbus="n/a"), job(2, "b", sla_minutes=" 5 ")]))
    assert by_job(tags, "sla_minutes", "budget_monthly_dbus", "has_sla") == {1: (None, None, False), 2: (5, None, True)}


def test_duration_anomaly_needs_more_than_twice_the_median(spark):
    rows = [run(1, n, "SUCCESS", hour=n, seconds=100) for n in range(1, 8)]
    rows += [run(1, 8, "SUCCESS", hour=8, seconds=200), run(1, 9, "SUCCESS", hour=9, seconds=201)]
    found = H.duration_anomalies(runs(spark, rows), AS_OF).collect()
    assert [r.run_id for r in found] == [9]


def test_details_hold_ten_runs_and_all_reasons(spark):
    rows = [run(1, n, "FAILED", day=20, hour=n, code=f"C{n % 3}") for n in range(1, 13)]
    detail = job_details(runs(spark, rows), jobs(spark, []), AS_OF).collect()[0]
    assert [r.run_id for r in detail.recent_runs] == list(range(12, 2, -1))
    assert detail.failure_reasons == ["C0", "C1", "C2"]
    assert detail.retry_count_7d == 0


def test_rollup_agrees_with_the_live_query(checked):
    rollup = health_rollup(checked.runs, checked.jobs, checked.as_of)
    live = job_health(checked.runs, checked.jobs, checked.as_of, 7)
    columns = ["success_rate", "priority", "retry_count", "last_run_time", "job_name"]
    renamed = rollup.filter("total_runs_7d > 0").withColumnRenamed("success_rate_7d", "success_rate")
    key = ["workspace_id", "job_id"]
    assert set(renamed.select(*key, *columns).collect()) == set(live.select(*key, *columns).collect())


def test_counts_add_up_and_input_order_is_irrelevant(checked):
    summary = health_summary(checked.runs, checked.as_of).collect()[0]
    assert summary.p1_count + summary.p2_count + summary.p3_count + summary.healthy_count == summary.total_count
    shuffled = checked.runs.repartition(13, F.rand(7))
    assert health_summary(shuffled, checked.as_of).collect()[0] == summary
    assert (summary.p1_count, summary.p1_count + summary.p2_count) == (3, 30)


def test_empty_input(spark):
    nothing = runs(spark, [])
    assert job_health(nothing, jobs(spark, []), AS_OF).count() == 0
    summary = health_summary(nothing, AS_OF).collect()[0]
    assert (summary.total_count, summary.avg_success_rate) == (0, 0.0)


def test_sla_breaches_per_day(spark):
    rows = [run(1, 1, "SUCCESS", day=29, seconds=300), run(1, 2, "SUCCESS", day=29, hour=2, seconds=301)]
    rows += [run(1, 3, "SUCCESS", day=30, seconds=299), run(2, 4, "SUCCESS", seconds=9999)]
    names = jobs(spark, [job(1, "a", sla_minutes=5), job(2, "b")])
    found = H.sla_breach_history(runs(spark, rows), names, AS_OF).collect()
    assert {(r.run_date.day, r.measured_runs, r.breach_count, r.breached) for r in found} == {
        (29, 2, 1, True), (30, 1, 0, False),
    }


def test_long_and_short_lists_of_recent_runs(spark):
    rows = [run(1, n, "SUCCESS", hour=n) for n in range(1, 9)]
    ids = spark.createDataFrame([(1, 1), (1, 2)], "workspace_id long, job_id long")
    lists = by_job(R.recent_runs_by_job(runs(spark, rows), ids, AS_OF), "recent_runs")
    assert [r.run_id for r in lists[1]] == [8, 7, 6, 5, 4]
    assert lists[2] == []
