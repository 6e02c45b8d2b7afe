from __future__ import annotations

from datetime import date, datetime

from runledger.operators import integrity as I
from tests.tables import AS_OF, job, jobs

LINEAGE = (
    "workspace_id long, entity_type string, entity_metadata struct<job_info struct<job_id string>>, "
    "target_table_full_name string, event_time timestamp_ntz"
)


def written(job_id, table, day=20, kind="JOB"):
    return (1, kind, ((str(job_id),),), table, datetime(2024, 1, day))


def test_output_tables_and_tag_fallback(spark):
    lineage = spark.createDataFrame(
        [written(1, "a.b.c"), written(1, "a.b.c"), written(1, None), written(2, "x.y", kind="NOTEBOOK")], LINEAGE
    )
    names = jobs(spark, [job(1, "a", output_tables="ignored.t"), job(2, "b", output_tables="s.t1, ,plain ")])
    rows = I.job_output_tables_with_fallback(lineage, names, AS_OF)
    assert {(r.job_id, r.table_name, r.origin) for r in rows.collect()} == {
        (1, "a.b.c", "lineage"), (2, "s.t1", "tag"), (2, "plain", "tag"),
    }
    parts = {r.table_name: (r.catalog_part, r.schema_part, r.table_part) for r in I.table_name_parts(rows).collect()}
    assert parts == {"a.b.c": ("a", "b", "c"), "s.t1": (None, "s", "t1")}


def test_all_or_the_first_tables_per_job(spark):
    lineage = spark.createDataFrame([written(1, f"a.b.t{n:02d}") for n in range(30)], LINEAGE)
    assert I.job_output_tables(lineage, AS_OF).count() == 30
    found = sorted(r.table_name for r in I.job_output_tables(lineage, AS_OF, limit=20).collect())
    assert found == [f"a.b.t{n:02d}" for n in range(20)]


def deltas(spark, counts):
    rows = [("t", date(2024, 1, 1 + n), c) for n, c in enumerate(counts)]
    return I.row_count_delta(spark.createDataFrame(rows, "table_name string, snapshot_date date, row_count long")).collect()[0]


def test_row_count_limits(spark):
    assert deltas(spark, [1000, 1200]).is_anomaly is False
    up = deltas(spark, [1000, 1201])
    assert (up.delta_percent, up.is_anomaly) == (20.1, True)
    assert deltas(spark, [1000, 800]).is_anomaly is False
    assert deltas(spark, [1000, 799]).is_anomaly is True
    zero = deltas(spark, [0, 0])
    assert (zero.delta_percent, zero.is_anomaly) == (0.0, False)
    assert (deltas(spark, [0, 5]).delta_percent, deltas(spark, [None, 5]).baseline_row_count) == (100.0, 0.0)
    single = deltas(spark, [7])
    assert (single.delta_percent, single.baseline_row_count) == (0.0, 7.0)


def test_baseline_is_the_mean_of_ten_snapshots_before(spark):
    row = deltas(spark, [10_000, *[100] * 10, 110])
    assert (row.baseline_row_count, row.delta_percent) == (100.0, 10.0)
    assert [p.row_count for p in row.trend] == [110, 100, 100, 100, 100]


def test_schema_drift(spark):
    schema = "table_name string, snapshot_version int, column_name string, data_type string"
    rows = [("t", 1, "old", "INT"), ("t", 2, "a", "INT"), ("t", 2, "b", "INT"), ("t", 3, "a", "BIGINT"), ("t", 3, "c", "INT")]
    rows += [("new", 3, "a", "INT"), ("same", 2, "a", "INT"), ("same", 3, "a", "INT")]
    found = {r.table_name: r for r in I.schema_drift(spark.createDataFrame(rows, schema)).collect()}
    assert found["t"].has_drift
    assert (found["t"].added_columns, found["t"].removed_columns) == (["c"], ["b"])
    assert [tuple(c) for c in found["t"].type_changes] == [("a", "INT", "BIGINT")]
    for name in ("new", "same"):
        assert not found[name].has_drift
        assert found[name].added_columns == []
