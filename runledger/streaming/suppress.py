"""One alert per condition and holding time from a stream of failed runs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import condition_key
from ..functions.states import is_failed
from . import state

HOLD = timedelta(hours=24)
STATE = "condition_key string, passed_at timestamp"


def failure_conditions(runs: DataFrame) -> DataFrame:
    """Condition key and time of every failed run."""
    return runs.filter(is_failed()).select(
        condition_key("failure", "single").alias("condition_key"),
        F.col("period_start_time").cast("timestamp").alias("raised_at"),
    )


def _free(hold: timedelta) -> Column:
    """Whether an event is not held back by the last one that passed."""
    return F.col("passed_at").isNull() | (F.col("raised_at") >= F.col("passed_at") + F.make_dt_interval(secs=F.lit(hold.total_seconds())))


def suppress_repeats(path: str, hold: timedelta = HOLD, buckets: int = state.BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch handler: a condition passes if it was not passed within ``hold`` before, in event time.

    The result does not depend on how the events are cut into batches, as long as they arrive in
    the order of their times; an event older than one that has passed counts as its repeat. Of each
    condition the first free event passes, which is a minimum that tasks combine before the shuffle.
    Events that it holds back are gone, and the step is repeated with the rest: once for each holding
    time that the events of one condition in the batch span. No list of events is built. Kept is one
    time per condition, in buckets; a bucket that is written drops the times that can hold nothing
    back any more.
    """
    table = state.Buckets(path, STATE, ["condition_key"], buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = table.touched(batch.select("condition_key").distinct())
        held = table.before(spark, batch_id, touched)
        last, passes = held.rows, []
        waiting = batch.filter("raised_at IS NOT NULL")
        while True:
            waiting = waiting.join(last, "condition_key", "left").filter(_free(hold)).drop("passed_at")
            state.emit(waiting.groupBy("condition_key").agg(F.min("raised_at").alias("raised_at")), path, batch_id, len(passes))
            passed = spark.read.schema("condition_key string, raised_at timestamp").parquet(f"{path}/rows/batch_id={batch_id}/step={len(passes)}")
            passes.append(passed)
            if not passed.limit(1).count():
                break
            last = passed.withColumnRenamed("raised_at", "passed_at")
        newest = batch.agg(F.max("raised_at")).first()[0]
        both = held.rows
        for passed in passes:
            both = both.unionByName(passed.withColumnRenamed("raised_at", "passed_at"))
        open_ = both.groupBy("condition_key").agg(F.max("passed_at").alias("passed_at"))
        if newest is not None:
            open_ = open_.filter(F.col("passed_at") > F.lit(newest - hold))
        table.keep(open_, held, batch_id, touched)

    return handle
