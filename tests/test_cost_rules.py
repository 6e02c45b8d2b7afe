from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from runledger.functions.naming import sku_category
from runledger.functions.numbers import trend_percent
from runledger.operators import cost as C
from runledger.operators import trends as T
from runledger.operators import utilization as U
from runledger.plans.costs import cost_anomalies
from runledger.sources import readers
from tests.tables import AS_OF, by_job, job, jobs, run, runs, usage, used


def test_retracted_usage_drops_out(spark):
    table = usage(spark, [used(1, 30, 5), used(1, 30, -5), used(2, 30, 0.1), used(2, 30, 0.2), used(2, 30, -0.3), used(3, 30, 1)])
    assert by_job(C.cost_job(table, AS_OF), "job_id") == {3: 3}
    assert C.usage_daily(table, AS_OF).count() == 1


def test_usage_without_job_counts_for_no_job(spark):
    table = usage(spark, [used(None, 30, 5), used(1, 30, 2)])
    assert by_job(C.usage_by_job(table, AS_OF), "total_dbus", "usage_days") == {1: (2.0, 1)}
    assert C.usage_daily(table, AS_OF).count() == 2


def test_baseline_needs_five_usage_days(spark):
    four = [used(1, day, 1) for day in range(20, 24)]
    five = [used(2, day, day) for day in range(20, 25)] + [used(2, 26, 3), used(2, 26, -3)]
    assert by_job(C.cost_baseline(usage(spark, four + five), AS_OF), "usage_days", "baseline_p90_dbus") == {
        2: (5, pytest.approx(23.6))
    }


def test_trend(spark):
    cases = spark.createDataFrame(
        [(1, 150.0, 100.0), (2, 0.0, 0.0), (3, 5.0, 0.0), (4, 50.0, 100.0)], "job_id long, cur double, prev double"
    )
    assert by_job(cases.withColumn("t", trend_percent(F.col("cur"), F.col("prev"))), "t") == {1: 50.0, 2: 0.0, 3: 100.0, 4: -50.0}


def test_sku_categories(spark):
    names = {
        "ALL_PURPOSE_JOBS": "All-Purpose", "premium_jobs_compute": "Jobs Compute", "SERVERLESS_SQL": "SQL Warehouse",
        "serverless_jobs": "Jobs Compute", "SERVERLESS": "Serverless", "MODEL_SERVING": "Other",
    }
    df = spark.createDataFrame([(n,) for n in names], "sku string").withColumn("c", sku_category(F.col("sku")))
    assert {r.sku: r.c for r in df.collect()} == names


def test_same_category_twice_is_one_row(spark):
    table = usage(spark, [used(1, 30, 3, sku="JOBS_A"), used(1, 30, 1, sku="JOBS_B"), used(1, 30, 4, sku="SQL")])
    shares = {(r.sku_category, r.percentage) for r in C.cost_by_sku(table, AS_OF).collect()}
    assert shares == {("Jobs Compute", 50.0), ("SQL Warehouse", 50.0)}


def test_breakdown_round_trip_and_bad_parts(spark):
    table = usage(spark, [used(1, 30, 3, sku="JOBS_A"), used(1, 30, 4, sku="SQL")])
    costs = C.cost_job(table, AS_OF)
    assert by_job(costs, "sku_breakdown") == {1: "JOBS_A:3.00000,SQL:4.00000"}
    odd = spark.createDataFrame([(1, 1, "A:1.5,broken,B:x,SQL:2")], "workspace_id long, job_id long, sku_breakdown string")
    assert {(r.sku_name, r.dbus) for r in C.parse_sku_breakdown(odd).collect()} == {("A", 1.5), ("SQL", 2.0)}


def test_short_windows_keep_the_previous_week(spark):
    table = usage(spark, [used(1, 28, 30), used(1, 20, 20)])
    row = C.job_costs(table, jobs(spark, []), AS_OF, days=7).collect()[0]
    assert (row.total_dbus_30d, row.prev_7d_dbus, row.trend_7d_percent) == (30.0, 20.0, 50.0)
    assert [(r.current_7d_dbus, r.prev_7d_dbus) for r in C.cost_trend(table, AS_OF, days=7).collect()] == [(30.0, 20.0)]


def test_a_product_that_nets_to_zero_over_two_weeks_keeps_its_weeks(spark):
    table = usage(spark, [used(1, 28, -5), used(1, 20, 5), used(1, 29, 7, sku="SQL")])
    row = C.job_costs(table, jobs(spark, []), AS_OF, days=7).collect()[0]
    assert (row.total_dbus_30d, row.current_7d_dbus, row.prev_7d_dbus) == (2.0, 2.0, 5.0)


def test_the_baseline_has_thirty_days_whatever_the_window(spark):
    old = [used(1, day, 1000, month=12) for day in range(1, 20)]
    old = [(ws, d.replace(year=2023), sku, q, m) for ws, d, sku, q, m in old]
    table = usage(spark, [*old, *(used(1, day, 1) for day in range(5, 31))])
    rows = [C.job_costs(table, jobs(spark, []), AS_OF, days=days).collect()[0] for days in (30, 90)]
    assert {(r.baseline_p90_dbus, r.is_anomaly) for r in rows} == {(1.0, True)}


def test_a_negative_week_is_no_spike(spark):
    table = usage(spark, [used(1, day, -4) for day in range(10, 24)] + [used(1, 28, -1)])
    assert [r.is_anomaly for r in C.job_costs(table, jobs(spark, []), AS_OF).collect()] == [False]


def test_the_check_day_counts_in_the_mean(spark):
    table = usage(spark, [used(1, day, 10) for day in range(24, 32)])
    row = C.cost_spikes(table, None, AS_OF, factor=0.5, unit="daily_mean").collect()[0]
    assert row.current_dbus == 10.0


def test_job_ids_that_are_no_numbers_are_reported(spark):
    table = usage(spark, [used(1, 28, 5), used("adhoc", 28, 5), used("adhoc", 29, 5), used(None, 29, 5)])
    assert [(r.job_id_text, r.usage_rows) for r in readers.unreadable_job_ids(table).collect()] == [("adhoc", 2)]
    assert [r.job_id for r in C.job_costs(table, jobs(spark, []), AS_OF).collect()] == [1]


def test_spike_units(spark):
    table = usage(spark, [used(1, day, 10) for day in range(10, 31)])
    assert by_job(C.cost_spikes(table, jobs(spark, []), AS_OF), "multiplier") == {1: pytest.approx(7.0)}
    assert C.cost_spikes(table, jobs(spark, []), AS_OF, unit="daily_mean").count() == 0
    with pytest.raises(ValueError):
        C.cost_spikes(table, jobs(spark, []), AS_OF, unit="month")


def test_zombies_and_reasons(spark):
    table = usage(spark, [used(j, 5, 60) for j in (1, 2, 3, 4)] + [used(5, 5, 10)])
    history = runs(
        spark,
        [run(1, 1, "FAILED", day=5), run(2, 2, "SUCCESS", day=5)]
        + [run(3, 10 + n, "SUCCESS", day=5, hour=n) for n in range(1, 13)],
    )
    names = jobs(spark, [job(1, "a", team="t")])
    rows = by_job(cost_anomalies(table, history, names, AS_OF), "anomaly_type", "reason", "team")
    assert rows == {
        1: ("zombie", "High cost (60.0 DBUs) with 0 successful runs out of 1 attempts", "t"),
        2: ("zombie", "High cost per run (60.0 DBUs/run) may indicate inefficiency", None),
        4: ("zombie", "High cost (60.0 DBUs) with no detected runs", None),
    }
    assert set(by_job(C.zombie_jobs(table, history, names, AS_OF), "total_dbus")) == {1, 2, 4}


def test_spiking_job_is_not_also_a_zombie(checked):
    rows = cost_anomalies(checked.usage, checked.runs, checked.jobs, checked.as_of)
    assert rows.count() == rows.select("workspace_id", "job_id").distinct().count()


def test_team_totals_equal_the_grand_total(checked):
    costs = C.job_costs(checked.usage, checked.jobs, checked.as_of)
    teams = C.team_costs(costs).agg(F.round(F.sum("total_dbus_30d"), 4)).collect()[0][0]
    assert teams == pytest.approx(C.cost_totals(costs).collect()[0].total_dbus_30d, abs=1e-3)
    assert C.cost_totals(costs).collect()[0].total_cost_dollars is None


def test_rates_per_hour(spark):
    history = runs(spark, [run(1, n, "SUCCESS", hour=n, seconds=3600) for n in range(1, 4)] + [run(2, 9, "SUCCESS")])
    table = usage(spark, [used(1, 30, 6)])
    assert by_job(U.run_dbu_rate(history, table, AS_OF), "avg_dbus_per_hour", "runs_analyzed") == {1: (pytest.approx(6.0), 3)}
    assert by_job(U.run_dbu_rate(history, table, AS_OF, allocate=True), "avg_dbus_per_hour") == {1: pytest.approx(2.0)}


def test_two_periods_of_a_run_are_one_run(spark):
    history = runs(spark, [run(1, 1, "SUCCESS", hour=1), run(1, 1, "SUCCESS", hour=2), run(1, 2, "SUCCESS", hour=3)])
    assert U.run_dbu_rate(history, usage(spark, []), AS_OF).count() == 0


def test_over_provisioned_needs_every_run_low(spark):
    low = [run(1, n, "SUCCESS", day=20 + n, seconds=3600) for n in range(1, 6)]
    mixed = [run(2, 10 + n, "SUCCESS", day=20 + n, seconds=3600) for n in range(1, 6)]
    few = [run(3, 20 + n, "SUCCESS", day=20 + n, seconds=3600) for n in range(1, 5)]
    table = usage(
        spark,
        [used(j, 20 + n, 0.5) for j in (1, 3) for n in range(1, 6)]
        + [used(2, 20 + n, 0.1 if n > 1 else 1.5) for n in range(1, 6)],
    )
    found = by_job(U.cluster_utilization(runs(spark, low + mixed + few), table, AS_OF), "is_over_provisioned", "recommendation")
    assert found == {
        1: (True, "Consider reducing workers by 50% or using smaller node types"), 2: (False, None), 3: (False, None),
    }


def test_granularity():
    assert [T.granularity(d) for d in (1, 7, 8, 30, 31, 90)] == ["hourly", "hourly", "daily", "daily", "weekly", "weekly"]
    assert T.granularity_between(date(2024, 1, 1), date(2024, 1, 9)) == "daily"


def test_cost_trend_aligns_both_periods(spark):
    table = usage(spark, [used(1, 30, 4), used(1, 20, 2), used(1, 21, 7)])
    rows = {r.period.day: (r.current, r.previous) for r in T.trend_cost(table, AS_OF, 10).collect()}
    assert rows == {30: (4.0, 2.0), 21: (7.0, 0.0)}
    headline = T.trend_headline(T.trend_cost(table, AS_OF, 10), 10).collect()[0]
    assert (headline.current_total, headline.previous_total, headline.change_percent) == (11.0, 2.0, 450.0)


def test_weekly_buckets_start_with_the_window(spark):
    # 2024-01-31 minus 35 days is 2023-12-27; the window's second week starts on 2024-01-03
    table = usage(spark, [used(1, 2, 1), used(1, 3, 2), used(1, 9, 4), used(1, 10, 8)])
    rows = {str(r.period): r.current for r in T.trend_cost(table, AS_OF, 35).collect()}
    assert rows == {"2023-12-27": 1.0, "2024-01-03": 6.0, "2024-01-10": 8.0}


def test_success_trend_leaves_empty_periods_out(spark):
    table = runs(spark, [run(1, 1, "SUCCESS", day=30, hour=1), run(1, 2, "FAILED", day=30, hour=1, minute=5), run(1, 3, "SUCCESS", day=22)])
    rows = T.trend_success(table, AS_OF, 7).collect()
    assert [(r.period.day, r.period.hour, r.current, r.previous) for r in rows] == [(29, 1, None, 100.0), (30, 1, 50.0, None)]
    headline = T.trend_headline(T.trend_success(table, AS_OF, 7), 7, "rate").collect()[0]
    assert (headline.current_total, headline.previous_total, headline.change_percent) == (50.0, 100.0, -50.0)


def test_team_filter(spark):
    table = usage(spark, [used(1, 30, 1), used(2, 30, 2)])
    names = jobs(spark, [job(1, "a", team="x"), job(2, "b", team="y")])
    assert [r.current for r in T.trend_cost(table, AS_OF, 7, names, "x").collect()] == [1.0]
    assert [r.current for r in T.trend_cost(table, AS_OF, 7, job_id=2).collect()] == [2.0]
    with pytest.raises(ValueError):
        T.trend_cost(table, AS_OF, 7, team="x")
    with pytest.raises(ValueError):
        T.trend_cost(table, AS_OF, 91)
