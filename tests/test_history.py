"""States at a moment, histories, and answers from stored parts."""

from __future__ import annotations

import bisect
import pathlib
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runledger.functions.asof import last_change
from runledger.operators import alerts as A
from runledger.operators import cost as C
from runledger.operators import health as H
from runledger.operators import integrity as I
from runledger.operators import jobs as J
from runledger.operators import sketches as SK
from runledger.operators import utilization as U
from runledger.plans import rollups as RU
from tests.tables import AS_OF, JOB_SCHEMA, RUN_SCHEMA, run, usage, used

START = datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("parts", [1, 3])
def test_last_change_against_a_search(spark, parts):
    draw = random.Random(4)
    changes = [(draw.choice(["a", "b", "c"]), START + timedelta(minutes=draw.randint(0, 40_000)), draw.randint(0, 9)) for _ in range(60)]
    events = [(draw.choice(["a", "b", "d"]), START + timedelta(minutes=draw.randint(-2000, 42_000)), n) for n in range(400)]
    events += [("a", changes[0][1], 400), ("a", None, 401), (None, START, 402)]
    got = last_change(
        spark.createDataFrame(events, "k string, at timestamp, n int"), spark.createDataFrame(changes, "k string, since timestamp, v int"),
        ["k"], "at", "since", ["v"], parts=parts,
    )
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    found = {r.n: (r.in_force.since, r.in_force.v) if r.in_force else None for r in got.collect()}
    assert len(found) == len(events)
    for k, at, n in events:
        mine = sorted((since, v) for key, since, v in changes if key == k)
        place = bisect.bisect_right(mine, (at, 99)) if at is not None and k is not None else 0
        assert found[n] == (mine[place - 1] if place else None)


def test_a_hot_key_is_spread_over_time(spark):
    """What one task sees of a key is a bin, a part of its events, and the changes of the bin."""
    events = spark.range(20_000).select(F.lit("hot").alias("k"), F.expr("timestamp_seconds(1704067200 + id * 60)").alias("at"), "id")
    changes = spark.range(2_000).select(F.lit("hot").alias("k"), F.expr("timestamp_seconds(1704067200 + id * 600)").alias("since"), F.col("id").alias("v"))
    got = last_change(events, changes, ["k"], "at", "since", ["v"], parts=2)
    assert "hashpartitioning(k" in plan(got) and "_bin" in plan(got)
    assert got.filter("in_force.v != id DIV 10").count() == 0


def test_names_in_force(spark):
    at = lambda day: datetime(2024, 1, day)
    versions = [
        (1, 1, "first", {}, "u", at(2), None), (1, 1, "second", {}, "u", at(5), at(8)), (1, 1, "back", {}, "u", at(12), None),
        (1, 2, "twice", {}, "u", at(2), None), (1, 2, "gone", {}, "u", at(2), at(2)),
    ]
    runs = [run(j, 10 * j + d, "SUCCESS", day=d, hour=0) for j in (1, 2, 3) for d in (1, 2, 4, 5, 7, 8, 9, 12, 20)]
    named = J.with_names_then(spark.createDataFrame(runs, RUN_SCHEMA), spark.createDataFrame(versions, JOB_SCHEMA), parts=2)
    found = {(r.job_id, r.period_start_time.day): r.job_name for r in named.collect()}
    want = {1: "job-1", 2: "first", 4: "first", 5: "second", 7: "second", 8: "job-1", 9: "job-1", 12: "back", 20: "back"}
    assert {d: n for (j, d), n in found.items() if j == 1} == want
    assert {n for (j, _), n in found.items() if j != 1} == {"job-2", "job-3"}  # of two versions of a moment the deleted one counts


def test_acknowledgements_at_the_time_of_the_alert(spark):
    hour = lambda h: START + timedelta(hours=h)
    alerts = spark.createDataFrame([("a", hour(h)) for h in (0, 1, 25, 26, 49, 50, 100)] + [("b", hour(3))], "condition_key string, raised_at timestamp")
    acks = spark.createDataFrame([("a", hour(1)), ("a", hour(2)), ("a", hour(30)), ("a", hour(49)), ("c", hour(3))], "condition_key string, acknowledged_at timestamp")
    found = A.acknowledge_history(alerts, acks, parts=2).collect()
    hours = {(r.condition_key, int((r.raised_at - START).total_seconds() // 3600)): r.acknowledged_at and int((r.acknowledged_at - START).total_seconds() // 3600) for r in found}
    assert hours == {("a", 0): None, ("a", 1): 1, ("a", 25): 2, ("a", 26): 2, ("a", 49): 49, ("a", 50): 49, ("a", 100): None, ("b", 3): None}
    assert all(r.acknowledged == (r.acknowledged_at is not None) for r in found)


def test_schema_history(spark):
    def of(table, *versions):
        return [(table, v, c, t) for v, columns in versions for c, t in columns.items()]

    rows = of("t", (1, {"a": "int", "b": "int"}), (2, {"a": "int"}), (4, {"a": "long", "b": "text"}), (7, {"b": "text", "c": "int"}), (9, {"b": "text", "c": "int"}))
    rows += of("one", (3, {"x": "int"}))
    rows += rows[:2]  # repeated rows
    found = {(r.table_name, r.snapshot_version): (r.has_drift, r.added_columns, r.removed_columns, [tuple(c) for c in r.type_changes]) for r in I.schema_history(spark.createDataFrame(rows, "table_name string, snapshot_version int, column_name string, data_type string")).collect()}
    assert found == {
        ("t", 1): (False, [], [], []), ("t", 2): (True, [], ["b"], []), ("t", 4): (True, ["b"], [], [("a", "int", "long")]),
        ("t", 7): (True, ["c"], ["a"], []), ("t", 9): (False, [], [], []), ("one", 3): (False, [], [], []),
    }


@pytest.mark.parametrize("stretch", [3, 128])
def test_row_count_history_of_a_hot_table(spark, stretch):
    draw, day, rows = random.Random(9), date(2010, 1, 1), []
    for n in range(2500):
        day += timedelta(days=draw.choice([1, 1, 1, 2, 30, 200]))
        rows.append(("hot", day, draw.choice([None, 0, 5, 100, 130])))
    rows += [("small", date(2024, 1, 1), 7), ("small", date(2024, 1, 3), 9)]
    got = I.row_count_history(spark.createDataFrame(rows, "table_name string, snapshot_date date, row_count long"), stretch=stretch).collect()
    assert len(got) == len(rows)
    found = {(r.table_name, r.snapshot_date): r.baseline_row_count for r in got}
    for n, (name, day, count) in enumerate(rows):
        before = [c or 0 for _, _, c in rows[max(0, n - 10) : n]] if name == "hot" else [7] if n == 2501 else []
        assert found[name, day] == pytest.approx(sum(before) / len(before) if before else float(count or 0))


def test_team_and_total_from_one_pass(spark):
    rows = [(1, 1, "a", 10.0, 10.0), (1, 2, None, 5.0, 0.0), (1, 3, "a", 30.0, -50.0)]
    costs = spark.createDataFrame(rows, "workspace_id long, job_id long, team string, total_dbus_30d double, trend_7d_percent double")
    found = {(r.team, r.is_total): (r.total_dbus_30d, r.job_count, r.trend_7d_percent) for r in C.team_and_total_costs(costs, 2.0).collect()}
    assert found == {("a", False): (40.0, 2, -35.0), ("Untagged", False): (5.0, 1, 0.0), (None, True): (45.0, 3, -35.0)}
    assert C.team_and_total_costs(costs).exceptAll(C.team_and_total_costs(costs)).count() == 0
    assert len([p for p in plan(C.team_and_total_costs(costs)).splitlines() if p.startswith("(") and "Scan" in p]) == 1


@pytest.fixture(scope="module")
def many(spark):
    """40,000 runs of one job over 80 days, some in two rows, beside a small job."""
    seconds = F.pmod(F.xxhash64("id"), F.lit(5000)).cast("int") + 1
    begin = F.expr("CAST(timestamp_seconds(1699920000 + (id % 80) * 86400) AS timestamp_ntz)")
    rows = spark.range(40_000).select(
        F.lit(1).cast("long").alias("workspace_id"), F.when(F.col("id") < 30, 2).otherwise(1).cast("long").alias("job_id"), (F.col("id") - F.when(F.col("id") % 9 == 4, 1).otherwise(0)).alias("run_id"),
        begin.alias("period_start_time"), begin.alias("period_end_time"), seconds.alias("run_duration_seconds"), F.lit("SUCCESS").alias("result_state"), F.lit(None).cast("string").alias("termination_code"),
    )
    return rows


def test_windows_from_daily_sketches(spark, many, tmp_path):
    path = f"{tmp_path}/days"
    SK.refresh_days(SK.daily_sketches(many), path)
    table = SK.read_days(spark, path)
    for days in (7, 30, 90):
        stats = SK.merged_durations(table, AS_OF, days)
        checked = SK.rank_checked(stats, H.duration_histogram(many, AS_OF, days, effective=True)).collect()
        assert checked and all(r.median_within_bound and r.p90_within_bound for r in checked)
        exact = {r.job_id: (r.run_count, r.max_duration_seconds, r.avg_duration_seconds) for r in H.duration_stats(many, AS_OF, days, effective=True).collect()}
        assert {r.job_id: (r.run_count, r.max_duration_seconds, r.avg_duration_seconds) for r in stats.collect()} == exact
        text = plan(stats)
        assert text.count("Location: InMemoryFileIndex") == 1 and "days]" in text and "run_duration_seconds" not in text
        assert "PartitionFilters: [isnotnull(run_date" in text


def test_a_day_is_refreshed_alone(spark, many, tmp_path):
    path = f"{tmp_path}/days"
    SK.refresh_days(SK.daily_sketches(many), path)
    before = {p.parent.name: p.name for p in pathlib.Path(path).rglob("*.parquet")}
    newest = max(before).split("=")[1]
    SK.refresh_days(SK.daily_sketches(many.filter(F.to_date("period_start_time") == newest)), path)
    after = {p.parent.name: p.name for p in pathlib.Path(path).rglob("*.parquet")}
    assert {k for k in before if before[k] != after[k]} == {f"run_date={newest}"}


def test_run_counts_from_daily_sketches(spark, many):
    table = SK.daily_sketches(many)
    exact = {r.job_id: r.n for r in many.groupBy("job_id").agg(F.count_distinct("run_id").alias("n")).collect()}
    for r in SK.merged_run_counts(table, AS_OF, 90).collect():
        assert abs(r.runs_analyzed - exact[r.job_id]) <= SK.COUNT_ERROR * exact[r.job_id]
    spent = usage(spark, [used(1, d, 40 + d) for d in range(1, 29)] + [used(2, 3, 9)])
    rates = {r.job_id: r.avg_dbus_per_hour for r in U.run_dbu_rate(many, spent, AS_OF).collect()}
    merged = {r.job_id: r.avg_dbus_per_hour for r in SK.merged_dbu_rate(table, spent, AS_OF).collect()}
    assert merged == pytest.approx(rates)


def test_bucketed_rollups_join_without_a_shuffle(spark, small, tmp_path):
    tables = RU.build(small.runs, small.usage, small.jobs, small.as_of, datetime(2024, 1, 31))
    kept = {name: tables[name] for name in (RU.HEALTH, RU.COST)}
    RU.refresh_tables(spark, kept, "laid_out", location=str(tmp_path), buckets=4)
    health, cost = (spark.table(f"laid_out.{name}") for name in (RU.HEALTH, RU.COST))
    joined = health.select("workspace_id", "job_id", "priority").join(cost.select("workspace_id", "job_id", "total_dbus_30d").hint("merge"), ["workspace_id", "job_id"])
    text = plan(joined)
    assert "Exchange" not in text
    assert joined.count() == tables[RU.HEALTH].join(tables[RU.COST], ["workspace_id", "job_id"]).count() > 0
    assert "Exchange" not in plan(cost.groupBy("workspace_id", "job_id").agg(F.max("total_dbus_30d")))
