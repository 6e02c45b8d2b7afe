"""Consecutive failures from a stream of finished runs."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.keys import JOB_KEY
from ..functions.states import is_failed, is_finished

RUN = "workspace_id long, job_id long, run_id long, started timestamp, state string, failed boolean"
LAST = "workspace_id long, job_id long, last_state string, previous_state string, last_failed boolean, consecutive_failure boolean"
HELD = "workspace_id array<long>, job_id array<long>, run_id array<long>, started array<long>, state array<string>, failed array<boolean>"
COLUMNS = [*JOB_KEY, "run_id", "started", "state", "failed"]
#: Runs that start more than this before the newest one seen are too late, and jobs without a run for so long are forgotten.
LATE, FORGET = timedelta(days=2), timedelta(days=90)
#: Jobs share this many values of the state: fixed for the life of a stream.
BUCKETS = 4096


def _newest_two(runs: pd.DataFrame) -> pd.DataFrame:
    """The newest two runs of each job, oldest first; of a run that comes twice the row that came last."""
    once = runs.drop_duplicates([*JOB_KEY, "run_id", "started"], keep="last").sort_values(["started", "run_id"])
    return once.groupby(JOB_KEY, dropna=False).tail(2)


def _two_of_each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The newest two runs of each job among the rows that come together: what a hot job sends on is two rows per Arrow batch."""
    for frame in frames:
        yield _newest_two(frame)


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Runs with the microseconds they started at; keys with nulls are integers still."""
    nulls = {name: "Int64" for name in JOB_KEY if frame[name].dtype.kind != "i"}
    return frame[COLUMNS].astype({**nulls, "started": "datetime64[us]"}).astype({"started": "int64"})


class LastTwo(StatefulProcessor):
    """Keeps the newest two runs of the jobs of a bucket in the state store, and a timer for the first job to be forgotten."""

    def __init__(self, forget: timedelta | None = FORGET) -> None:
        self.forget = None if forget is None else forget // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("last_two", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = known = self._two()
        touched = None
        for frame in rows:
            arrived = _plain(frame)
            known = _newest_two(arrived if known is None else pd.concat([known, arrived]))
            jobs = arrived[JOB_KEY].drop_duplicates()
            touched = jobs if touched is None else pd.concat([touched, jobs]).drop_duplicates()
        if touched is None:
            return
        known = known.sort_values([*JOB_KEY, "started", "run_id"], ignore_index=True)
        if before is None or not known.equals(before):
            self._hold(known, self._due(before))
        yield self._rows(known).merge(touched, on=JOB_KEY)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fired, held = expiredTimerInfo.getExpiryTimeInMs(), self._two()
        if held is not None:
            due = held.groupby(JOB_KEY, dropna=False)["started"].transform("max").add(self.forget) // 1000
            left = held[due >= max(fired + 1, timerValues.getCurrentWatermarkInMs())]
            self._hold(left, fired) if len(left) else self.held.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass

    def _two(self) -> pd.DataFrame | None:
        """What is held, sorted by job, start and run."""
        if not self.held.exists():
            return None
        columns = dict(zip(COLUMNS, self.held.get(), strict=True))
        kinds = {name: "Int64" if None in columns[name] else "int64" for name in JOB_KEY}
        return pd.DataFrame({name: pd.Series(list(values), dtype=kinds.get(name)) for name, values in columns.items()})

    def _hold(self, runs: pd.DataFrame, timer: int | None) -> None:
        """Keeps the runs and moves the timer of the bucket from where it is."""
        self.held.update(tuple([None if name in JOB_KEY and pd.isna(v) else v for v in runs[name].tolist()] for name in COLUMNS))
        due = self._due(runs)
        if due != timer:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)

    def _due(self, runs: pd.DataFrame | None) -> int | None:
        """When the first of the jobs is to be forgotten, in milliseconds."""
        if runs is None or self.forget is None:
            return None
        last = ~runs.duplicated(JOB_KEY, keep="last")
        return (int(runs["started"][last].min()) + self.forget) // 1000

    @staticmethod
    def _rows(known: pd.DataFrame) -> pd.DataFrame:
        """A row per job from runs sorted by job, start and run."""
        first, last = ~known.duplicated(JOB_KEY, keep="first"), ~known.duplicated(JOB_KEY, keep="last")
        previous = known["state"].shift().where(~first, None)
        failed_before = known["failed"].shift(fill_value=False).astype(bool) & ~first
        found = known[JOB_KEY].assign(last_state=known["state"], previous_state=previous, last_failed=known["failed"].astype(bool))
        return found.assign(consecutive_failure=found["last_failed"] & failed_before)[last]


def last_states(runs: DataFrame, late: timedelta = LATE, forget: timedelta | None = FORGET, buckets: int = BUCKETS) -> DataFrame:
    """The last two states of every job that a batch touches, from a stream of runs; update mode.

    State is the two newest runs of every job, in one value of the state store per bucket of jobs, so that the
    calls to Python and to the store are bounded by the buckets. Order of arrival does not
    matter within ``late``: a run takes its place by start time, one older than both kept runs changes
    nothing, and a run that comes twice counts once. A run that starts more than ``late`` before the newest
    run of all earlier batches is dropped, whatever its job. A job whose newest run lies ``forget`` behind the
    watermark leaves the state; with its next run it starts anew.
    """
    arrived = runs.filter(is_finished()).select(
        *JOB_KEY,
        "run_id",
        F.col("period_start_time").cast("timestamp").alias("started"),
        F.upper("result_state").alias("state"),
        is_failed().alias("failed"),
    )
    reduced = arrived.mapInPandas(_two_of_each, RUN).withWatermark("started", f"{int(late.total_seconds())} seconds")
    dealt = reduced.withColumn("bucket", F.pmod(F.xxhash64(*JOB_KEY), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(LastTwo(forget), LAST, "Update", "EventTime")


def latest_per_job(written: DataFrame) -> DataFrame:
    """Newest emission of every job from the rows written batch by batch."""
    newest = Window.partitionBy(*JOB_KEY).orderBy(F.col("written_at_batch").desc())
    return (
        written.withColumn("rn", F.row_number().over(newest))
        .filter("rn = 1")
        .select(*JOB_KEY, "last_state", "previous_state", "last_failed", "consecutive_failure")
    )
