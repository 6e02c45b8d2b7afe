"""The last change at or before each event, without a range join and without a task that holds all of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _moment(column: str) -> Column:
    return F.col(column).cast("timestamp")


def _bin(column: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(column) / (seconds * 1_000_000))


def last_change(
    events: DataFrame, changes: DataFrame, keys: list[str], at: str, since: str, take: list[str], seconds: int = DAY, parts: int = 1
) -> DataFrame:
    """Adds ``in_force``, a struct of ``since`` and ``take`` of the newest change of the key at or before each event, or NULL.

    Time is cut into bins of ``seconds``. A change reaches the events of its own bin; later bins that
    have events get the newest change before them, found from one row per key and bin. So the events of a
    hot key are spread over its bins, and over ``parts`` tasks in each, and both sides may be of any length.
    Of changes of one moment the one with the largest ``take`` counts. Rows without a time have no match.
    """
    change = F.struct(_moment(since).alias(since), *take)
    dated = events.withColumn("_at", _moment(at)).withColumn("_bin", _bin(F.col("_at"), seconds))
    made = changes.filter(F.col(since).isNotNull()).select(*keys, _moment(since).alias("_at"), change.alias("_change"))
    made = made.withColumn("_bin", _bin(F.col("_at"), seconds))

    # The newest change before each bin that has events.
    of_bin = made.groupBy(*keys, "_bin").agg(F.max("_change").alias("_change"))
    asked = dated.filter("_bin IS NOT NULL").groupBy(*keys, "_bin").agg(F.lit(True).alias("_asked"))
    bins = of_bin.unionByName(asked, allowMissingColumns=True).groupBy(*keys, "_bin")
    bins = bins.agg(F.max("_change").alias("_change"), F.max("_asked").alias("_asked"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.withColumn("_change", F.last("_change", ignorenulls=True).over(before)).filter("_asked AND _change IS NOT NULL")
    start = F.timestamp_micros((F.col("_bin") * seconds * 1_000_000).cast("long"))
    known = carried.select(*keys, "_bin", start.alias("_at"), "_change", F.lit(0).alias("_kind")).unionByName(
        made.select(*keys, "_bin", "_at", "_change", F.lit(1).alias("_kind"))
    )
    # Each part of a bin needs all changes of the bin.
    known = known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    event = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    rows = dated.select(*keys, "_bin", "_at", F.lit(2).alias("_kind"), F.pmod(F.xxhash64("_at", event), F.lit(parts)).cast("int").alias("_part"), event.alias("_event"))
    both = rows.unionByName(known, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "_bin", "_part").orderBy("_at", "_kind", "_change").rowsBetween(Window.unboundedPreceding, 0)
    in_force = F.when(F.col("_at").isNotNull(), F.last("_change", ignorenulls=True).over(so_far))
    return both.withColumn("in_force", in_force).filter("_kind = 2").select("_event.*", "in_force")
