"""Health rollup kept current from a stream of runs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY
from ..functions.numbers import percent
from ..functions.states import is_failed, is_finished, is_success, priority, traffic_light
from ..operators.jobs import with_job_names
from . import state

COUNTS = ["finished", "succeeded", "open"]
RUN = "struct<started: timestamp_ntz, run_id: long, seconds: int, failed: boolean>"
STATE = f"workspace_id long, job_id long, run_date date, finished long, succeeded long, open long, newest array<{RUN}>"
HEALTH = (
    "workspace_id long, job_id long, job_name string, total_runs long, success_count long, success_rate double, last_run_time timestamp_ntz, "
    "last_duration_seconds int, priority string, status string, retry_count long, open_runs long"
)


def daily_parts(runs: DataFrame) -> DataFrame:
    """Counts and the newest two finished runs of every (job, day): all that the rollup needs of it.

    Both are reduced before the shuffle, the runs by a rank limit.
    """
    day = [*JOB_KEY, "run_date"]
    dated = runs.withColumn("run_date", F.to_date("period_start_time"))
    counts = dated.groupBy(*day).agg(
        F.count_if(is_finished()).alias("finished"),
        F.count_if(is_success()).alias("succeeded"),
        F.count_if(F.col("period_end_time").isNull()).alias("open"),
    )
    run = F.struct(
        F.col("period_start_time").cast("timestamp_ntz").alias("started"),
        "run_id",
        F.col("run_duration_seconds").cast("int").alias("seconds"),
        is_failed().alias("failed"),
    )
    newest = Window.partitionBy(*day).orderBy(F.col("period_start_time").desc(), F.col("run_id").desc())
    ranked = dated.filter(is_finished()).withColumn("rn", F.row_number().over(newest)).filter("rn <= 2")
    lists = ranked.groupBy(*day).agg(F.sort_array(F.collect_list(run), asc=False).alias("newest"))
    return counts.join(lists, day, "left").withColumn("newest", F.coalesce("newest", F.array().cast(f"array<{RUN}>")))


def merged(parts: DataFrame) -> DataFrame:
    """Parts of the same (job, day) as one."""
    return parts.groupBy(*JOB_KEY, "run_date").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.slice(F.sort_array(F.flatten(F.collect_list("newest")), asc=False), 1, 2).alias("newest"),
    )


def health_of(parts: DataFrame, jobs: DataFrame) -> DataFrame:
    """The rollup from daily parts: at most a window of rows per job."""
    per_job = parts.groupBy(*JOB_KEY).agg(
        F.sum("finished").alias("total_runs"),
        F.sum("succeeded").alias("success_count"),
        F.sum("open").alias("open_runs"),
        F.count_if(F.col("finished") > 0).alias("days"),
        F.slice(F.sort_array(F.flatten(F.collect_list("newest")), asc=False), 1, 2).alias("newest"),
    )
    rate = percent(F.col("success_count"), F.col("total_runs"))
    last, previous = F.get("newest", 0), F.get("newest", 1)
    second = F.coalesce(previous.failed, F.lit(False))
    return with_job_names(per_job.filter("total_runs > 0"), jobs).select(
        *JOB_KEY,
        "job_name",
        "total_runs",
        "success_count",
        rate.alias("success_rate"),
        last.started.alias("last_run_time"),
        last.seconds.alias("last_duration_seconds"),
        priority(last.failed, second, rate).alias("priority"),
        traffic_light(rate).alias("status"),
        (F.col("total_runs") - F.col("days")).alias("retry_count"),
        "open_runs",
    )


def health_written(spark: SparkSession, path: str) -> DataFrame:
    """The rollup as the newest batch left it."""
    return spark.read.schema(f"{HEALTH}, bucket int").parquet(f"{path}/health").filter("job_id IS NOT NULL").drop("bucket")


def refresh_rollup(
    jobs: DataFrame,
    path: str,
    days: int = 7,
    as_of: Callable[[date | None, date | None], date | None] | None = None,
    buckets: int = state.BUCKETS,
) -> Callable[[DataFrame, int], None]:
    """Batch handler: adds the daily parts of the new runs and swaps the buckets of the rollup that they change.

    The check day moves with the stream: it is the newest day seen so far, or what ``as_of`` makes
    of the newest day of the batch and the check day before it. Kept are the parts of the window,
    so a job without runs in it leaves the rollup. State and rollup are cut into the same buckets
    of jobs. A batch reads and writes the state of the buckets that its runs lie in. While the
    check day stays, it writes the same buckets of the rollup; on the first batch of a new day, when
    runs leave the window of every job, all of them, from the parts alone.
    """
    table = state.Buckets(path, STATE, JOB_KEY, buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = table.touched(batch.select(*JOB_KEY).distinct())
        held = table.before(spark, batch_id, touched)
        seen = batch.agg(F.max(F.to_date("period_start_time"))).first()[0]
        previous = date.fromisoformat(held.value) if held.value else None
        check_day = as_of(seen, previous) if as_of else max((d for d in (seen, previous) if d), default=None)
        if check_day is None or not touched:
            return
        since = F.lit(check_day - timedelta(days=days))
        parts = merged(held.rows.unionByName(daily_parts(batch))).filter(F.col("run_date") >= since)
        kept = table.keep(parts, held, batch_id, touched, check_day.isoformat())
        fresh = touched
        if check_day != previous:
            kept, fresh = table.before(spark, batch_id + 1).rows, list(range(buckets))
        health = table.bucketed(health_of(kept.filter(F.col("run_date").between(since, F.lit(check_day))), jobs))
        # A row without keys for each bucket, so that one that runs empty is swapped too.
        marks = spark.createDataFrame([(b,) for b in fresh], "bucket int")
        state.swap(health.unionByName(marks, allowMissingColumns=True).repartition("bucket"), f"{path}/health", "bucket")

    return handle
