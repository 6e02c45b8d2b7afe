from __future__ import annotations

import random
from datetime import timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from runledger.functions import wording
from runledger.functions.numbers import fixed_text, percentile_of, rounded
from runledger.operators import alerts as A
from runledger.operators import ordering as O
from runledger.plans.alert_feed import alert_feed, all_alerts
from tests.tables import AS_OF, NOW, active, by_job, job, jobs, run, runs, usage, used


def feed(t, **options):
    return alert_feed(t.runs, t.usage, t.jobs, t.active_runs, t.acks, t.as_of, t.as_of_ts, **options)


def test_failure_alert_texts(spark):
    table = runs(spark, [run(1, 1, "FAILED", hour=1), run(1, 2, "FAILED", hour=2, code="JAVA_HEAP_SPACE"), run(2, 3, "FAILED", hour=5)])
    rows = {r.job_id: r for r in A.failure_alerts(table, jobs(spark, [job(1, "a")]), AS_OF).collect()}
    assert rows[1].severity == "P1"
    assert rows[1].condition_key == "failure_1_1_consecutive"
    assert rows[1].description == "Job has failed 2+ times in a row. Most recent failure at 2024-01-30 02:00:00."
    assert rows[1].remediation.startswith("Memory issue detected")
    assert rows[2].title == "Recent failure"
    assert rows[2].description == "Job failed at 2024-01-30 05:00:00. Success rate: 0.0%."
    assert rows[2].remediation == wording.NO_REASON


@pytest.mark.parametrize(
    ("codes", "start"),
    [
        (["X_OOM", "TIMEOUT"], "Memory"),
        (["RUN_TIMED OUT"], "Timeout"),
        (["NULL_VALUE"], "Data quality"),
        (["ACCESS_DENIED"], "Permission"),
        (["A", "B", "C", "D"], "Recent failures: A, B, C. Review"),
        ([], "Review recent run logs"),
        (None, "Review recent run logs"),
    ],
)
def test_remediation_topics(spark, codes, start):
    df = spark.createDataFrame([(codes,)], "codes array<string>")
    assert df.select(wording.failure_remediation(F.col("codes"))).collect()[0][0].startswith(start)


def test_cluster_advice_tiers(spark):
    df = spark.createDataFrame([(1, 19.9), (2, 20.0), (3, 30.0)], "job_id long, u double")
    texts = by_job(df.withColumn("t", wording.cluster_remediation(F.col("u"), F.lit(3))), "t")
    assert ["50%" in texts[1], "30-40%" in texts[2], "20-30%" in texts[3]] == [True, True, True]


def test_sla_thresholds(spark):
    rows = [(1, j, j, "RUNNING", NOW - timedelta(seconds=s)) for j, s in [(1, 4740), (2, 4800), (3, 6000), (4, 9000)]]
    names = jobs(spark, [job(j, f"j{j}", sla_minutes=100) for j in (1, 2, 3)] + [job(4, "none")])
    found = by_job(A.sla_alerts(active(spark, rows), names, NOW), "severity", "title")
    assert found == {2: ("P2", "SLA breach risk (80% of window)"), 3: ("P1", "SLA breached (100m target)")}


def test_budget_thresholds(spark):
    table = usage(spark, [used(1, 2, 79.9), used(2, 2, 80), used(3, 2, 100), used(5, 2, 9)])
    names = jobs(
        spark,
        [job(j, f"j{j}", budget_monthly_dbus=100) for j in (1, 2, 3, 4)] + [job(5, "bad", budget_monthly_dbus="n/a")],
    )
    assert by_job(A.budget_alerts(table, names, AS_OF), "severity", "title") == {
        2: ("P2", "Approaching budget (80%)"), 3: ("P1", "Budget exceeded (100%)"),
    }


def test_acknowledgement_lasts_24_hours(spark):
    alerts = spark.createDataFrame([("a",), ("b",), ("c",)], "condition_key string")
    acks = spark.createDataFrame(
        [("a", NOW - timedelta(hours=24)), ("b", NOW - timedelta(hours=24, seconds=1)), ("a", NOW - timedelta(hours=30))],
        "condition_key string, acknowledged_at timestamp_ntz",
    )
    marked = {r.condition_key: r.acknowledged for r in A.acknowledge(alerts, acks, NOW).collect()}
    assert marked == {"a": True, "b": False, "c": False}


def test_dedupe_keeps_the_most_severe(spark):
    rows = [("k", "P2", "x"), ("k", "P1", "y"), ("m", "P3", "z")]
    alerts = spark.createDataFrame(rows, "condition_key string, severity string, title string")
    assert {(r.condition_key, r.severity, r.title) for r in A.dedupe_alerts(alerts).collect()} == {("k", "P1", "y"), ("m", "P3", "z")}


def test_feed_has_one_alert_per_condition(checked):
    rows = feed(checked)
    assert rows.count() == rows.select("condition_key").distinct().count()


def test_category_choice_equals_filter_afterwards(checked):
    t = checked
    for category in A.CATEGORIES:
        some = all_alerts(t.runs, t.usage, t.jobs, t.active_runs, t.as_of, t.as_of_ts, [category])
        every = all_alerts(t.runs, t.usage, t.jobs, t.active_runs, t.as_of, t.as_of_ts)
        assert sorted(map(str, some.collect())) == sorted(map(str, every.filter(F.col("category") == category).collect()))
    with pytest.raises(ValueError):
        all_alerts(t.runs, t.usage, t.jobs, t.active_runs, t.as_of, t.as_of_ts, ["weather"])


def test_pages_make_up_the_whole(checked):
    alerts = feed(checked).select("condition_key", "severity")
    ordered = [r.condition_key for r in alerts.orderBy(*O.alert_order()).collect()]
    size = 70
    pages = [[r.condition_key for r in O.page(alerts, O.alert_order(), n, size).collect()] for n in range(1, 7)]
    assert [key for p in pages for key in p] == ordered
    assert O.page_info(alerts, 1, size).collect()[0].has_more
    assert not O.page_info(alerts, 5, size).collect()[0].has_more


def test_counts_by_severity_add_up(checked):
    row = A.alert_counts(feed(checked)).collect()[0]
    assert row.total == row.p1_count + row.p2_count + row.p3_count


def test_sorting(spark):
    jobs_table = spark.createDataFrame(
        [(1, 1, "b", None, 5), (1, 2, "A", "P1", 1), (1, 3, "c", "P3", 3)],
        "workspace_id long, job_id long, job_name string, priority string, retry_count long",
    )
    order = lambda df: [r.job_id for r in df.collect()]
    assert order(O.sort_jobs(jobs_table)) == [1, 3, 2]
    assert order(O.sort_jobs(jobs_table, "priority", "desc")) == [2, 3, 1]
    assert order(O.sort_jobs(jobs_table, "job_name", "asc")) == [2, 1, 3]
    with pytest.raises(ValueError):
        O.sort_jobs(jobs_table, "color")
    runs_table = spark.createDataFrame(
        [(1, 1, 1, "QUEUED", NOW), (1, 2, 2, "RUNNING", NOW - timedelta(hours=1)), (1, 3, 3, "TERMINATING", NOW)],
        "workspace_id long, job_id long, run_id long, state string, start_time timestamp_ntz",
    )
    assert order(O.sort_active(runs_table)) == [2, 1, 3]
    assert order(O.sort_active(runs_table, "duration", "desc"))[0] == 2
    costs = spark.createDataFrame(
        [(1, 1, "zebra"), (1, 2, None), (1, 3, "Apple")], "workspace_id long, job_id long, team string"
    )
    assert order(O.sort_costs(costs, "team", "asc")) == [3, 1, 2]


def test_numbers_in_texts_are_rounded_as_sql_rounds_them(spark):
    """30.549999999999997 * 10 is 305.5 and 0.285 * 100 is 28.499999999999996 in doubles."""
    values = spark.createDataFrame([(30.549999999999997, 0.285)], "a double, b double")
    row = values.select(fixed_text(F.col("a"), 1).alias("a"), rounded(F.col("b"), 2).alias("b"), wording.spike_remediation(F.col("a"), F.col("b")).alias("text")).collect()[0]
    want = duckdb.sql("SELECT CAST(CAST(ROUND(30.549999999999997::DOUBLE, 1) AS DECIMAL(28,1)) AS VARCHAR), ROUND(0.285::DOUBLE, 2)").fetchall()[0]
    assert (row.a, row.b) == want == ("30.6", 0.28)
    assert row.text.startswith("Cost is 30.6x")


def test_baselines_equal_sql_in_the_last_place(spark):
    draw = random.Random(4)
    rows = [(g, [draw.randint(1, 60000) / 1000 for _ in range(draw.randint(0, 31))]) for g in range(400)]
    table = spark.createDataFrame([(g, sorted(v)) for g, v in rows], "g int, v array<double>")
    got = {r.g: r.p for r in percentile_of(table, "v", 0.9, "p").collect()}
    for g, v in rows:
        assert got[g] == duckdb.execute("SELECT quantile_cont(x, 0.9) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [v]).fetchone()[0]
