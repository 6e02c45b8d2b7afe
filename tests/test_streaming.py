"""Streams fed file by file must end where the batch operators end."""

from __future__ import annotations

import pathlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runledger.operators.runs import consecutive_failures
from runledger.plans.health import job_health
from runledger.streaming import failures, rollup, run_counts, runner, suppress
from tests.tables import RUN_SCHEMA, run


def split_files(df, path, parts):
    """``parts`` files, each holding an interleaved share of the rows, so runs arrive out of order."""
    for n in range(parts):
        df.filter(F.col("run_id") % parts == n).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def arriving(small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arriving"))
    split_files(small.runs, path, 4)
    return path


STATES = ["workspace_id", "job_id", "last_state", "previous_state", "last_failed", "consecutive_failure"]


def drained(spark, source, path, schema, late=timedelta(days=60), forget=None):
    """Feeds what is new in the source folder to the stateful stream; the query that did it."""
    runs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return runner.drain_batches(
        failures.last_states(runs, late, forget), path, runner.write_batch(path), mode="update", partitions=2, store=runner.STORE
    )


def last_of(spark, path):
    return {(r.workspace_id, r.job_id): tuple(r)[2:] for r in failures.latest_per_job(spark.read.parquet(f"{path}/rows")).collect()}


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_last_states_do_not_depend_on_arrival(small, tmp_path, parts):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    split_files(small.runs, source, parts)
    drained(small.spark, source, path, small.runs.schema)
    batch = consecutive_failures(small.runs, small.as_of, days=60)
    assert last_of(small.spark, path) == {(r.workspace_id, r.job_id): tuple(r)[2:] for r in batch.select(*STATES).collect()}


def test_late_runs_and_repeats(spark, tmp_path):
    """A late run takes its place by start time while it is ahead of the watermark, and is dropped behind it."""
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"

    def arrive(*rows):
        frame = spark.createDataFrame(list(rows), RUN_SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(source)
        return drained(spark, source, path, frame.schema, late=timedelta(days=2))

    arrive(run(1, 10, "FAILED", day=10), run(2, 11, "SUCCESS", day=10))
    arrive(run(1, 12, "FAILED", day=9), run(2, 11, "SUCCESS", day=10))  # a day late; a run that comes twice
    assert last_of(spark, path) == {(1, 1): ("FAILED", "FAILED", True, True), (1, 2): ("SUCCESS", None, False, False)}
    arrive(run(2, 13, "FAILED", day=5))  # behind the watermark
    assert last_of(spark, path)[1, 2] == ("SUCCESS", None, False, False)
    arrive(run(1, 9, "SUCCESS", day=10, hour=0), run(1, 14, None, day=11))  # between both kept runs; an open run does not count
    assert last_of(spark, path)[1, 1] == ("FAILED", "SUCCESS", True, False)


def test_a_batch_writes_the_state_of_its_jobs_only(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    first = spark.createDataFrame([run(j, j, "FAILED", day=10) for j in range(1, 41)], RUN_SCHEMA)
    first.coalesce(1).write.mode("append").parquet(source)
    drained(spark, source, path, first.schema)
    spark.createDataFrame([run(7, 100, "FAILED", day=11)], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    query = drained(spark, source, path, first.schema)
    assert sum(o.numRowsUpdated for p in query.recentProgress for o in p.stateOperators) == 1
    newest = spark.read.parquet(f"{path}/rows").groupBy("written_at_batch").count().collect()
    assert {r.written_at_batch: r["count"] for r in newest} == {0: 40, max(r.written_at_batch for r in newest): 1}


def test_jobs_without_runs_are_forgotten(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    for row in (run(1, 1, "FAILED", day=1), run(2, 2, "SUCCESS", day=20), run(2, 3, "SUCCESS", day=21), run(1, 4, "FAILED", day=22)):
        frame = spark.createDataFrame([row], RUN_SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(source)
        drained(spark, source, path, frame.schema, late=timedelta(days=1), forget=timedelta(days=5))
    assert last_of(spark, path)[1, 1] == ("FAILED", None, True, False)


def test_jobs_share_values_of_the_state(spark, tmp_path):
    """However many jobs there are, a batch makes no more calls than there are buckets, and a job has its own result and end."""
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"

    def arrive(*rows):
        spark.createDataFrame(list(rows), RUN_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        runs = spark.readStream.schema(spark.createDataFrame([], RUN_SCHEMA).schema).parquet(source)
        states = failures.last_states(runs, timedelta(days=1), timedelta(days=5), buckets=3)
        query = runner.drain_batches(states, path, runner.write_batch(path), mode="update", partitions=2, store=runner.STORE)
        return query.recentProgress[-1].stateOperators[0].numRowsTotal

    arrive(*(run(j, 2 * j + n, "FAILED" if j % 2 or n else "SUCCESS", day=1 + j % 2, hour=n) for j in range(1, 41) for n in range(2)))
    want = {(1, j): ("FAILED", "FAILED" if j % 2 else "SUCCESS", True, bool(j % 2)) for j in range(1, 41)}
    assert last_of(spark, path) == want
    assert spark.read.parquet(f"{path}/rows").count() == 40
    # Values and timers (by key and by time) of three buckets at the most.
    assert arrive(run(7, 1000, "SUCCESS", day=20)) <= 9
    assert arrive(run(7, 1001, "SUCCESS", day=21), run(8, 1002, "FAILED", day=21)) <= 9
    want |= {(1, 7): ("SUCCESS", "SUCCESS", False, False), (1, 8): ("FAILED", None, True, False)}
    assert last_of(spark, path) == want


def stored_health(small, path):
    return sorted(map(str, rollup.health_written(small.spark, path).collect()))


def test_rollup_follows_the_stream(small, arriving, tmp_path):
    path = str(tmp_path)
    source = stream(small.spark, arriving, small.runs.schema)
    runner.drain_batches(source, path, rollup.refresh_rollup(small.jobs, path, as_of=lambda seen, before: small.as_of, buckets=4))
    assert stored_health(small, path) == sorted(map(str, job_health(small.runs, small.jobs, small.as_of).collect()))


def test_a_repeated_batch_changes_nothing(small, tmp_path):
    handler = rollup.refresh_rollup(small.jobs, str(tmp_path), as_of=lambda seen, before: small.as_of, buckets=4)
    live = sorted(map(str, job_health(small.runs, small.jobs, small.as_of).collect()))
    for _ in range(2):
        handler(small.runs, 0)
        assert stored_health(small, tmp_path) == live
    # neither an empty batch nor one before the window touches the rollup
    handler(small.runs.limit(0), 1)
    handler(small.runs.filter("period_start_time < DATE'2024-01-05'"), 2)
    assert stored_health(small, tmp_path) == live


def files_of(path):
    """bucket -> names of its data files."""
    found = {}
    for file in pathlib.Path(path).rglob("*.parquet"):
        found.setdefault(next(p for p in file.parts if p.startswith("bucket=")), set()).add(file.name)
    return found


def test_a_batch_swaps_its_buckets_only(spark, small, tmp_path):
    handler = rollup.refresh_rollup(small.jobs, str(tmp_path), buckets=8)
    handler(spark.createDataFrame([run(j, j, "SUCCESS", day=9) for j in range(1, 60)], RUN_SCHEMA), 0)
    health, held = files_of(tmp_path / "health"), files_of(tmp_path / "state")
    assert len(health) == len(held) == 8
    handler(spark.createDataFrame([run(5, 100, "FAILED", day=9, hour=2)], RUN_SCHEMA), 1)
    assert len([b for b, names in files_of(tmp_path / "health").items() if names != health[b]]) == 1
    assert len([b for b, names in files_of(tmp_path / "state").items() if names != held[b]]) == 1
    for _ in range(2):  # and a repeated batch finds the state before it
        handler(spark.createDataFrame([run(5, 101, "SUCCESS", day=9, hour=3)], RUN_SCHEMA), 2)
        got = {r.job_id: r.total_runs for r in rollup.health_written(spark, str(tmp_path)).collect()}
        assert got == {j: 3 if j == 5 else 1 for j in range(1, 60)}


def test_jobs_without_runs_leave_the_rollup(spark, small, tmp_path):
    handler = rollup.refresh_rollup(small.jobs, str(tmp_path), buckets=4)
    first = spark.createDataFrame([run(1, 1, "SUCCESS", day=9), run(2, 2, "FAILED", day=9)], RUN_SCHEMA)
    handler(first, 0)
    assert {r.job_id for r in rollup.health_written(spark, tmp_path).collect()} == {1, 2}
    handler(spark.createDataFrame([run(2, 3, "SUCCESS", day=28)], RUN_SCHEMA), 1)
    kept = rollup.health_written(spark, tmp_path).collect()
    assert [(r.job_id, r.total_runs) for r in kept] == [(2, 1)]


def test_hourly_counts_wait_for_the_watermark(spark, tmp_path):
    batches = [
        [run(1, 1, "SUCCESS", hour=1, minute=50), run(1, 2, "FAILED", hour=1, minute=55)],
        # five minutes late, within the source lag
        [run(1, 3, "SUCCESS", hour=2, minute=5), run(1, 4, "SUCCESS", hour=1, minute=58)],
        [run(1, 5, None, hour=3, minute=30)],
        # far too late: its window has been emitted
        [run(1, 6, "SUCCESS", hour=1, minute=1), run(1, 7, "SUCCESS", hour=4, minute=30)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(spark.createDataFrame([], RUN_SCHEMA).schema).parquet(f"{tmp_path}/in")
        runner.drain_append(run_counts.stream_run_counts(source), f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out/rows").collect()
    assert {(r.period.hour, r.outcome, r.runs) for r in rows} == {
        (1, "success", 2), (1, "failed", 1), (2, "success", 1), (3, "open", 1),
    }


def passed(spark, path, batches):
    """What passes if the events come in these batches."""
    schema = "condition_key string, raised_at timestamp"
    handler = suppress.suppress_repeats(str(path), buckets=4)
    for number, rows in enumerate(batches):
        handler(spark.createDataFrame(rows, schema), number)
    return sorted((r.condition_key, r.raised_at) for r in spark.read.parquet(f"{path}/rows").collect())


def test_repeats_are_held_back_for_a_day(spark, tmp_path):
    first = datetime(2024, 1, 1, 12)
    hours = {"a": [0, 1, 20, 24, 30, 47, 48, 90], "b": [0, 30, 60, 90], "c": [72]}
    events = sorted(((c, first + timedelta(hours=h)) for c, at in hours.items() for h in at), key=lambda e: (e[1], e[0]))
    want = [("a", 0), ("a", 24), ("a", 48), ("a", 90), ("b", 0), ("b", 30), ("b", 60), ("b", 90), ("c", 72)]
    for parts in (1, 3, 10):
        size = -(-len(events) // parts)
        got = passed(spark, tmp_path / str(parts), [events[i : i + size] for i in range(0, len(events), size)])
        assert got == [(c, first + timedelta(hours=h)) for c, h in want]


def test_a_repeated_batch_passes_the_same(spark, tmp_path):
    first = datetime(2024, 1, 1)
    handler = suppress.suppress_repeats(str(tmp_path), buckets=4)
    schema = "condition_key string, raised_at timestamp"
    handler(spark.createDataFrame([("a", first)], schema), 0)
    for _ in range(2):
        handler(spark.createDataFrame([("a", first + timedelta(hours=25)), ("a", first + timedelta(hours=26))], schema), 1)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 2


def test_a_hot_condition(spark, tmp_path):
    """100,000 times of one condition, five days of them, beside others; no list of them is built."""
    first = datetime(2024, 1, 1)
    times = F.expr("timestamp_millis(1704067200000 + id * 4320)")
    hot = spark.range(100_000).select(F.lit("hot").alias("condition_key"), times.alias("raised_at"))
    rest = spark.range(50).select(F.concat(F.lit("c"), "id").alias("condition_key"), F.lit(first).alias("raised_at"))
    handler = suppress.suppress_repeats(str(tmp_path), buckets=4)
    handler(hot.unionByName(rest), 0)
    written = spark.read.parquet(f"{tmp_path}/rows")
    assert written.filter("condition_key = 'hot'").count() == 5
    assert written.filter("condition_key != 'hot'").count() == 50
    # a later batch finds the last time, and conditions that hold nothing back any more are gone
    handler(spark.createDataFrame([("hot", first + timedelta(hours=119)), ("hot", first + timedelta(hours=121)), ("c7", first + timedelta(hours=121))], "condition_key string, raised_at timestamp"), 1)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 57
