from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from runledger.plans import rollups as RU
from runledger.sources import readers, schemas
from runledger.session import shared_folder


def built(t):
    return RU.build(t.runs, t.usage, t.jobs, t.as_of, t.as_of_ts)


def test_refresh_counts_and_reads_back(small, tmp_path):
    tables = built(small)
    counts = RU.refresh(tables, str(tmp_path))
    for name, expected in tables.items():
        stored = RU.read_rollup(small.spark, str(tmp_path), name)
        assert counts[name] == stored.count()
        assert sorted(map(str, stored.collect())) == sorted(map(str, expected.collect()))
    assert counts[RU.HEALTH] == 15
    # a second refresh replaces, it does not add
    assert RU.refresh(tables, str(tmp_path)) == counts
    assert RU.read_rollup(small.spark, str(tmp_path), RU.HEALTH).count() == 15


def test_reads(small, tmp_path):
    RU.refresh(built(small), str(tmp_path))
    health = RU.read_rollup(small.spark, str(tmp_path), RU.HEALTH)
    assert set(RU.read_health(health, 30).columns) == set(RU.read_health(health, 7).columns)
    assert RU.read_cost(RU.read_rollup(small.spark, str(tmp_path), RU.COST), 3).count() == 3
    alerts = RU.read_rollup(small.spark, str(tmp_path), RU.ALERTS)
    apart = sum(RU.read_alerts(alerts, w).count() for w in (1000, 1001, 1002))
    assert apart == RU.read_alerts(alerts, "all").count() == alerts.count()


def test_catalog_tables(small):
    counts = RU.refresh_tables(small.spark, built(small), "metrics")
    assert small.spark.table("metrics.job_health").count() == counts["job_health"]
    RU.ensure_namespace(small.spark, "metrics")
    small.spark.sql("DROP SCHEMA metrics CASCADE")


def test_columns_added_later_are_null_for_old_rows(small, tmp_path):
    old = small.spark.createDataFrame([(1, "a")], "id long, name string")
    new = small.spark.createDataFrame([(2, "b", 5)], "id long, name string, score int")
    assert {(r.id, r.score) for r in RU.evolve(old, new).collect()} == {(1, None), (2, 5)}
    old.write.parquet(f"{tmp_path}/t/part=1")
    new.write.parquet(f"{tmp_path}/t/part=2")
    assert {(r.id, r.score) for r in RU.read_rollup(small.spark, str(tmp_path), "t").collect()} == {(1, None), (2, 5)}


def test_freshness(small):
    now = datetime(2024, 1, 31, 12)
    for age, fresh in [(timedelta(minutes=59), True), (timedelta(hours=1), False), (timedelta(hours=2), False)]:
        table = RU.with_refresh_time(small.spark.range(3), now - age)
        assert RU.freshness(table, now).collect()[0].is_fresh is fresh
    nothing = RU.with_refresh_time(small.spark.range(0), now)
    assert tuple(RU.freshness(nothing, now).collect()[0]) == (None, False)


def test_typed_readers(small, tmp_path):
    usage = small.usage.withColumn("usage_metadata", F.col("usage_metadata").withField("notebook_id", F.lit(None).cast("string")))
    usage.write.parquet(f"{tmp_path}/usage")
    back = readers.read_usage(small.spark, f"{tmp_path}/usage")
    assert back.schema.fieldNames() == schemas.USAGE.fieldNames()
    assert readers.job_usage(back).count() == readers.job_usage(small.usage).count()
    small.jobs.withColumn("run_as_user_name", F.lit("x")).write.json(f"{tmp_path}/jobs")
    assert readers.read_jobs(small.spark, f"{tmp_path}/jobs", "json").count() == 239


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark).startswith(root)
    assert shared_folder(spark) != shared_folder(spark)
