"""State of a stream as a table cut into buckets of keys, of which a batch writes those it touches.

Each bucket has two folders that take turns. A batch finds for every bucket the newest version that an earlier batch
left, and writes its own into the other folder by dynamic partition overwrite. So a repeated batch finds the same state
and leaves the same rows, and buckets that it does not touch keep their files. Each version holds one row without keys
that carries the number of its batch, so that a bucket that runs empty still replaces what was there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

#: Buckets of a state table unless the caller knows better: fixed for the life of the stream.
BUCKETS = 64


def swap(rows: DataFrame, path: str, *partitions: str) -> None:
    """Overwrites the partitions that occur in the rows, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def emit(df: DataFrame, path: str, batch_id: int, step: int = 0) -> None:
    """One folder of result rows per batch and step, overwritten on a retry."""
    df.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}/step={step}")


class Buckets:
    """The state table below a path. ``schema`` has the keys among its columns."""

    def __init__(self, path: str, schema: str, keys: list[str], count: int = BUCKETS) -> None:
        self.path, self.keys, self.count = f"{path}/state", keys, count
        self.schema = T.StructType.fromDDL(schema)
        extra = "_batch long, _value string, bucket int, slot int"
        self.stored = T.StructType([*self.schema.fields, *T.StructType.fromDDL(extra).fields])

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int"))

    def touched(self, rows: DataFrame) -> list[int]:
        """Numbers of the buckets that the rows lie in, ``count`` at the most."""
        return sorted(r.bucket for r in self.bucketed(rows).select("bucket").distinct().collect())

    def _versions(self, spark: SparkSession, batch_id: int) -> dict[int, tuple[int, int, str | None]]:
        """bucket -> batch, slot and value of the newest version before the batch."""
        try:
            written = spark.read.schema(self.stored).parquet(self.path)
        except AnalysisException:  # nothing has been written yet
            return {}
        marks = written.filter(F.col(self.keys[0]).isNull() & (F.col("_batch") < batch_id))
        newest = marks.groupBy("bucket").agg(F.max(F.struct("_batch", "slot", "_value")).alias("x"))
        return {r.bucket: (r.x._batch, r.x.slot, r.x._value) for r in newest.collect()}

    def before(self, spark: SparkSession, batch_id: int, buckets: list[int] | None = None) -> "Held":
        """What earlier batches left in these buckets, or in all."""
        versions = self._versions(spark, batch_id)
        value = max((v for v in versions.values()), default=(None, None, None))[2]
        chosen = {b: slot for b, (_, slot, _) in versions.items() if buckets is None or b in buckets}
        if not chosen:
            return Held(spark.createDataFrame([], self.schema), {b: slot for b, (_, slot, _) in versions.items()}, value)
        rows = spark.read.schema(self.stored).parquet(self.path)
        mine = F.lit(False)
        for slot in (0, 1):
            mine = mine | ((F.col("slot") == slot) & F.col("bucket").isin([b for b, s in chosen.items() if s == slot]))
        rows = rows.filter(mine & F.col(self.keys[0]).isNotNull()).select(*self.schema.fieldNames())
        return Held(rows, {b: slot for b, (_, slot, _) in versions.items()}, value)

    def keep(self, rows: DataFrame, held: "Held", batch_id: int, buckets: list[int], value: str | None = None) -> DataFrame:
        """Writes the state of these buckets after a batch and reads it back. ``value`` is one text for the whole state."""
        spark = rows.sparkSession
        slots = {b: 1 - held.slots.get(b, 1) for b in buckets}
        if not slots:
            return rows
        slot = F.element_at(F.create_map(*[F.lit(x) for pair in slots.items() for x in pair]), F.col("bucket"))
        marks = spark.createDataFrame([(b,) for b in buckets], "bucket int")
        for field in self.schema.fields:
            marks = marks.withColumn(field.name, F.lit(None).cast(field.dataType))
        both = self.bucketed(rows.select(*self.schema.fieldNames())).unionByName(marks)
        stamped = both.withColumn("_batch", F.lit(batch_id).cast("long")).withColumn("_value", F.lit(value).cast("string")).withColumn("slot", slot)
        # The rows of a bucket go to its file by one shuffle.
        swap(stamped.repartition("bucket"), self.path, "bucket", "slot")
        return self.before(spark, batch_id + 1, buckets).rows


class Held:
    def __init__(self, rows: DataFrame, slots: dict[int, int], value: str | None) -> None:
        self.rows, self.slots, self.value = rows, slots, value
