"""Draining a stream into files that survive retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PARTITIONS = "spark.sql.shuffle.partitions"
#: Keyed state lives in a store that writes what a batch has changed, not the whole state.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that a stream takes over at its start."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def state_partitions(spark: SparkSession, count: int | None) -> Iterator[None]:
    """Partitions of a stream's state: fixed for the life of its checkpoint, so chosen at the start
    of the stream instead of taken from the setting for batch shuffles."""
    before = spark.conf.get(PARTITIONS)
    if count is not None:
        spark.conf.set(PARTITIONS, str(count))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


def drain_append(stream: DataFrame, path: str, partitions: int | None = None) -> None:
    """Appends final rows through the file sink, which commits every batch exactly once."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{path}/_state")
        .trigger(availableNow=True)
    )
    with state_partitions(stream.sparkSession, partitions):
        query = writer.start(f"{path}/rows")
    query.awaitTermination()


def drain_batches(
    stream: DataFrame,
    path: str,
    handle: Callable[[DataFrame, int], None],
    mode: str = "append",
    partitions: int | None = None,
    store: dict[str, str] | None = None,
) -> StreamingQuery:
    """Calls ``handle`` for every batch; it must overwrite what an earlier try of the batch wrote."""
    writer = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", f"{path}/_state")
        .trigger(availableNow=True)
    )
    with state_partitions(stream.sparkSession, partitions), settings(stream.sparkSession, store or {}):
        query = writer.start()
        query.awaitTermination()
    return query


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per batch id, overwritten on a retry."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("written_at_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{path}/rows/batch_id={batch_id}"
        )

    return handle
