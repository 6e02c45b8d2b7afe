"""Daily sketches of run durations and run ids: any window is answered by merging days, without reading runs again."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import JOB_KEY, join_jobs, together
from ..functions.states import is_finished
from ..functions.timing import effective_seconds, trailing
from .cost import daily_job
from .health import MIN_RUNS_FOR_STATS
from .utilization import MIN_RUNS

#: Size of a quantile sketch, and by how much the rank of its quantiles is off at most (three times the bound that holds in 99 of 100 cases).
QUANTILE_SIZE, RANK_ERROR = 400, 0.02
#: Bits of a distinct-count sketch, and by how much its counts are off at most (three standard errors).
COUNT_BITS, COUNT_ERROR = 12, 0.05


def daily_sketches(runs: DataFrame) -> DataFrame:
    """One row per job and day of the finished runs with a positive effective duration.

    Beside exact sums, which merge by adding, it holds a quantile sketch of the durations and a sketch of the
    distinct run ids. Both are built on the map side, so a hot job sends one row per day and task.
    """
    done = runs.filter(is_finished() & F.col("period_end_time").isNotNull())
    timed = done.select(*JOB_KEY, "run_id", F.to_date("period_start_time").alias("run_date"), effective_seconds().alias("seconds"))
    return (
        timed.filter("seconds > 0")
        .groupBy(*JOB_KEY, "run_date")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("seconds").alias("total_seconds"),
            F.max("seconds").alias("max_seconds"),
            F.sum(F.lit(3600.0) / F.col("seconds")).alias("inverse_hours"),
            F.kll_sketch_agg_bigint("seconds", F.lit(QUANTILE_SIZE)).alias("durations"),
            F.hll_sketch_agg("run_id", F.lit(COUNT_BITS)).alias("run_ids"),
        )
    )


def refresh_days(sketches: DataFrame, path: str) -> None:
    """Writes the days that occur, and leaves all other days of the table as they are."""
    days = sketches.repartition("run_date")
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged_durations(sketches: DataFrame, as_of: date, days: int) -> DataFrame:
    """Duration statistics of a window of days. Mean, maximum and count are exact; median and p90 are runs whose rank is
    off by ``RANK_ERROR`` at most."""

    def quantile(point: float) -> Column:
        return F.kll_sketch_get_quantile_bigint("durations", F.lit(point)).cast("double")

    per_job = (
        sketches.filter(trailing("run_date", as_of, days))
        .groupBy(*JOB_KEY)
        .agg(
            F.kll_merge_agg_bigint("durations", F.lit(QUANTILE_SIZE)).alias("durations"),
            F.sum("total_seconds").alias("total_seconds"),
            F.max("max_seconds").alias("max_seconds"),
            F.sum("n").alias("run_count"),
        )
    )
    return per_job.select(
        *JOB_KEY,
        quantile(0.5).alias("median_duration_seconds"),
        quantile(0.9).alias("p90_duration_seconds"),
        (F.col("total_seconds").cast("double") / F.col("run_count")).alias("avg_duration_seconds"),
        F.col("max_seconds").cast("double").alias("max_duration_seconds"),
        "run_count",
        (F.col("run_count") >= MIN_RUNS_FOR_STATS).alias("has_sufficient_data"),
    )


def merged_run_counts(sketches: DataFrame, as_of: date, days: int) -> DataFrame:
    """Distinct runs of every job in a window of days, off by ``COUNT_ERROR`` of the count at most."""
    count = F.hll_sketch_estimate(F.hll_union_agg("run_ids"))
    return sketches.filter(trailing("run_date", as_of, days)).groupBy(*JOB_KEY).agg(count.alias("runs_analyzed"))


def merged_dbu_rate(sketches: DataFrame, usage: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Mean usage per hour of every job with at least three runs, from the daily table: no run id is shuffled.

    The rate is exact; only the number of distinct runs is estimated.
    """
    window = sketches.filter(trailing("run_date", as_of, days))
    by_day = together(window.select(*JOB_KEY, F.col("run_date").alias("usage_date"), "n", "inverse_hours", "run_ids"))
    spend = daily_job(usage, as_of, days).filter("dbus > 0")
    day_sum = F.coalesce(F.col("dbus").cast("double"), F.lit(0.0)) * F.col("inverse_hours")
    rates = by_day.drop("run_ids").join(spend.hint("merge"), [*JOB_KEY, "usage_date"], "left")
    rates = rates.groupBy(*JOB_KEY).agg((F.sum(day_sum) / F.sum("n")).alias("avg_dbus_per_hour"))
    counts = by_day.groupBy(*JOB_KEY).agg(F.hll_sketch_estimate(F.hll_union_agg("run_ids")).alias("runs_analyzed"))
    return join_jobs(rates, counts.filter(F.col("runs_analyzed") >= MIN_RUNS))


def rank_checked(stats: DataFrame, histogram: DataFrame, bound: float = RANK_ERROR) -> DataFrame:
    """Whether the exact ranks of each job's median and p90 are within the bound. ``histogram`` has seconds and n per job."""
    met = histogram.join(stats, JOB_KEY)
    columns = {"median": 0.5, "p90": 0.9}
    shares = []
    for name in columns:
        value = F.col(f"{name}_duration_seconds")
        for side, condition in (("below", F.col("seconds") < value), ("upto", F.col("seconds") <= value)):
            shares.append((F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"{name}_{side}"))
    ranks = met.groupBy(*JOB_KEY).agg(*shares)
    within = [
        ((F.col(f"{name}_below") - bound <= point) & (F.col(f"{name}_upto") + bound >= point)).alias(f"{name}_within_bound")
        for name, point in columns.items()
    ]
    return stats.join(ranks, JOB_KEY).select(*JOB_KEY, "run_count", "avg_duration_seconds", "max_duration_seconds", *within)
