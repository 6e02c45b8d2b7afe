from __future__ import annotations

import fnmatch
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from runledger.functions import display
from runledger.functions.naming import is_streaming_name
from runledger.functions.timing import between_days, trailing
from runledger.functions.wildcards import column_like, matches_any, validation_message
from runledger.operators import filters as FL
from runledger.operators import runs as R
from runledger.sources import readers
from tests.tables import AS_OF, NOW, active, by_job, job, jobs, run, runs

PATTERN_CASES = [
    ("ETL-*", "etl-load", True),
    ("ETL-*", "my-etl-load", False),
    ("*-daily", "sales-DAILY", True),
    ("ETL-*-prod", "ETL-x-y-prod", True),
    ("ETL-*-prod", "ETL-prod", False),
    ("job-?", "job-1", True),
    ("job-?", "job-12", False),
    ("job.name[1]", "job.name[1]", True),
    ("job.name[1]", "jobxname1", False),
    ("a+b(c)^$", "A+B(C)^$", True),
    ("a|b", "a", False),
    ("*", "", True),
    ("exact", "Exact", True),
]


def test_wildcards_as_literals_and_as_columns(spark):
    rows = spark.createDataFrame(PATTERN_CASES, "pattern string, name string, expected boolean")
    wrong = rows.filter(F.ilike(F.col("name"), column_like(F.col("pattern"))) != F.col("expected"))
    assert wrong.collect() == []
    for pattern, name, expected in PATTERN_CASES:
        one = spark.createDataFrame([(name,)], "name string")
        assert one.filter(matches_any(F.col("name"), [pattern])).count() == int(expected)
    assert rows.filter(matches_any(F.col("name"), [])).count() == len(PATTERN_CASES)


@pytest.mark.parametrize(
    ("pattern", "message"),
    [
        ("  ", "Pattern cannot be empty"),
        ("x" * 101, "Pattern is too long (max 100 characters)"),
        ("x" * 100, None),
        ("a;b", "Pattern contains invalid characters"),
        ("a`b", "Pattern contains invalid characters"),
        ("a$b", "Pattern contains invalid characters"),
        ("etl-*", None),
    ],
)
def test_pattern_messages(spark, pattern, message):
    df = spark.createDataFrame([(pattern,)], "pattern string")
    assert df.select(validation_message(F.col("pattern"))).collect()[0][0] == message


def test_presets_against_brute_force(checked):
    presets = FL.preset_ranges(checked.presets, AS_OF).collect()
    current = [r for r in checked.spark.sql("SELECT * FROM {j}", j=FL.latest_jobs(checked.jobs)).collect()]
    expected = set()
    for p in presets:
        patterns = [x.strip().lower() for x in (p.job_name_patterns or "").split(",") if x.strip()]
        for j in current:
            if p.team is not None and j.tags.get("team") != p.team:
                continue
            if p.job_id is not None and str(j.job_id) != p.job_id:
                continue
            if patterns and not any(fnmatch.fnmatchcase(j.name.lower(), x) for x in patterns):
                continue
            expected.add((p.id, j.workspace_id, j.job_id, p.range_start, p.range_end))
    rows = FL.apply_presets(checked.presets, checked.jobs, AS_OF).collect()
    actual = [(r.preset_id, r.workspace_id, r.job_id, r.range_start, r.range_end) for r in rows]
    assert len(actual) == len(set(actual))
    assert set(actual) == expected


def test_presets_with_short_and_open_patterns(spark):
    schema = "id string, team string, job_id string, job_name_patterns string, time_range string, start_date string, end_date string"
    presets = spark.createDataFrame(
        [
            ("short", None, None, "a?", "7d", None, None),
            ("all", None, None, "*", "30d", None, None),
            ("none", None, None, None, "90d", None, None),
            ("both", None, None, "ab*, *bc", "custom", "2024-01-02", "2024-01-09"),
            ("team", "red", None, "*", "odd", None, None),
        ],
        schema,
    )
    names = jobs(spark, [job(1, "ab", team="red"), job(2, "abc"), job(3, "x")])
    rows = FL.apply_presets(presets, names, AS_OF).collect()
    found: dict = {}
    for r in rows:
        found.setdefault(r.preset_id, []).append(r.job_id)
    assert {k: sorted(v) for k, v in found.items()} == {
        "short": [1], "all": [1, 2, 3], "none": [1, 2, 3], "both": [1, 2], "team": [1],
    }
    spans = {r.preset_id: (str(r.range_start), str(r.range_end)) for r in rows}
    assert spans["both"] == ("2024-01-02", "2024-01-09")
    assert spans["none"] == ("2023-11-02", "2024-01-31")
    assert spans["team"] == ("2024-01-24", "2024-01-31")


PRESET_SCHEMA = "id string, team string, job_id string, job_name_patterns string, time_range string, start_date string, end_date string"


def test_presets_of_jobs_that_share_a_name(spark):
    """Names of many jobs and of few; presets that come twice, with and without patterns, without an id, and for one job."""
    many = [job(i, "etl-load", team="red" if i % 2 else "blue") for i in range(FL.SHARED_BY + 2)]
    names = jobs(spark, [*many, job(7, "etl-load", ws=2), job(5000, "ETL-one", team="red"), job(5001, "x", team="red"), job(5002, None, team="")])
    week = ("7d", None, None)
    presets = spark.createDataFrame(
        [
            ("two", "red", None, "etl*,*load", *week),
            ("two", "red", None, "*one, *load", *week),
            ("plain", "red", None, "", *week),
            ("plain", "red", None, " , ", *week),
            (None, None, None, "*-one,x", *week),
            ("job", None, "7", "x,*LOAD", *week),
            ("job", "blue", "7", None, *week),
            ("no job", None, "7", "x", *week),
            ("blank", "", None, "job-50*", *week),
            ("bare", None, "etl", None, *week),
        ],
        PRESET_SCHEMA,
    )
    found = Counter((r.preset_id, r.workspace_id, r.job_id) for r in FL.apply_presets(presets, names, AS_OF).collect())
    red = [(1, i) for i in range(FL.SHARED_BY + 2) if i % 2] + [(1, 5000)]
    assert found == Counter(
        [("two", *k) for k in red]
        + [("plain", *k) for k in [*red, (1, 5001)] * 2]
        + [(None, 1, 5000), (None, 1, 5001), ("job", 1, 7), ("job", 2, 7), ("blank", 1, 5002)]
    )


def _rows_out(node) -> list[tuple[str, int]]:
    """Names of a finished plan's operators with the rows that each returned."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _rows_out(node.executedPlan())
    if node.nodeName().endswith("QueryStage"):
        return _rows_out(node.plan())
    metric, children = node.metrics().get("numOutputRows"), node.children()
    own = [(node.nodeName(), metric.get().value())] if metric.isDefined() else []
    return own + [x for i in range(children.size()) for x in _rows_out(children.apply(i))]


def test_pairs_of_presets_and_names_are_only_made_in_the_last_join(spark):
    """400 presets with one list of patterns, and 400 names: their 160,000 pairs are the rows of one operator."""
    names = jobs(spark, [job(i, f"etl-{i}-load") for i in range(400)])
    presets = spark.createDataFrame([(str(i), None, None, "etl*,*load", "7d", None, None) for i in range(400)], PRESET_SCHEMA)
    result = FL.apply_presets(presets, names, AS_OF)
    assert len(result.collect()) == 160_000
    large = [x for x in _rows_out(result._jdf.queryExecution().executedPlan()) if x[1] >= 160_000]
    assert large == [("SortMergeJoin", 160_000)]


def test_preset_changes(spark):
    schema = "id string, name string"
    table = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], schema)
    upserts = spark.createDataFrame([("2", "B", True), ("9", "new", False)], schema + ", is_shared boolean")
    deleted = spark.createDataFrame([("3",)], "id string")
    rows = {(r.id, r.name, r.is_shared) for r in FL.apply_preset_changes(table, upserts, deleted).collect()}
    assert rows == {("1", "a", None), ("2", "B", True), ("9", "new", False)}


def test_window_edges(spark):
    table = runs(spark, [run(1, 1, "SUCCESS", day=24, hour=0), run(2, 2, "SUCCESS", day=23, hour=23, minute=59), run(3, 3, "SUCCESS", day=31)])
    assert set(by_job(table.filter(trailing("period_start_time", AS_OF, 7)), "run_id")) == {1, 3}
    inside = between_days("period_start_time", AS_OF - timedelta(days=8), AS_OF - timedelta(days=7))
    assert set(by_job(table.filter(inside), "run_id")) == {2}
    with pytest.raises(ValueError):
        R.list_runs(table, AS_OF, days=91)


def test_recency_and_search(spark):
    rows = [(1, 1, "ETL x", NOW - timedelta(hours=6)), (1, 21, "other", NOW - timedelta(hours=6, seconds=1))]
    health = spark.createDataFrame(rows, "workspace_id long, job_id long, job_name string, last_run_time timestamp_ntz")
    assert set(by_job(FL.recent_jobs(health, NOW, 6), "job_name")) == {1}
    assert set(by_job(FL.search_jobs(health, "etl"), "job_name")) == {1}
    assert set(by_job(FL.search_jobs(health, "2"), "job_name")) == {21}
    assert FL.search_jobs(health, "  ").count() == 2


def test_streaming_names_and_long_runs(spark):
    names = ["my-stream", "a cdc b", "xcdcx", "real_time", "realtime", "event hub", "nightly", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(is_streaming_name(F.col("name"))).collect()] == [
        True, True, False, True, True, True, False, False,
    ]
    starts = [(1, 1, 1, "RUNNING", NOW - timedelta(hours=4)), (1, 2, 2, "RUNNING", NOW - timedelta(hours=4, seconds=1))]
    starts += [(1, 3, 3, "RUNNING", NOW - timedelta(hours=24)), (1, 4, 4, "RUNNING", NOW - timedelta(hours=24, seconds=1))]
    named = jobs(spark, [job(1, "a"), job(2, "b"), job(3, "kafka"), job(4, "kafka")])
    assert by_job(R.long_running(active(spark, starts), named, NOW), "is_long_running") == {1: False, 2: True, 3: False, 4: True}


def test_active_states(spark):
    table = active(spark, [(1, n, n, s, NOW) for n, s in enumerate(["RUNNING", "PENDING", "QUEUED", "TERMINATING"])])
    assert R.active_in_state(table, "PENDING").count() == 2
    assert R.active_in_state(table).count() == 4
    row = R.active_summary(table).collect()[0]
    assert (row.total_active, row.running_count, row.pending_count, row.queued_count) == (4, 1, 1, 1)


def test_live_feed_times(spark):
    schema = "workspace_id long, job_id long, run_id long, run_name string, state string, result_state string, start_ms long, end_ms long"
    feed = spark.createDataFrame([(1, 1, 1, "r", None, None, 1706659200123, 0)], schema)
    row = readers.live_runs(feed).select("state", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSS"), "end_time").collect()[0]
    assert tuple(row) == ("UNKNOWN", "2024-01-31 00:00:00.123", None)


def test_report_texts(spark):
    seconds = spark.createDataFrame([(8100.0,), (10800.0,), (2700.0,), (30.9,), (-1.0,), (None,)], "v double")
    assert [r[0] for r in seconds.select(display.duration_text(F.col("v"))).collect()] == ["2h 15m", "3h", "45m", "30s", "--", "--"]
    dbus = spark.createDataFrame([(0.001,), (0.5,), (5.0,), (1234.5,)], "v double")
    assert [r[0] for r in dbus.select(display.usage_text(F.col("v"))).collect()] == ["<0.01", "0.50", "5.0", "1,235"]
    trend = spark.createDataFrame([(12.4,), (-3.0,), (0.0,)], "v double")
    assert [r[0] for r in trend.select(display.trend_text(F.col("v"))).collect()] == ["+12%", "-3%", "0%"]
    assert [r[0] for r in trend.select(display.delta_text(F.col("v"))).collect()] == ["+12.4%", "-3.0%", "+0.0%"]
    counts = spark.createDataFrame([(999,), (1000,), (1500000,), (2000000000,)], "v long")
    assert [r[0] for r in counts.select(display.count_text(F.col("v"))).collect()] == ["999", "1.0K", "1.5M", "2.0B"]
