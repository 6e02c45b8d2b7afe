"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.session import shared_folder


def stored(frame: DataFrame) -> DataFrame:
    """Writes the rows as a table below spark.checkpoint.dir and reads it: later steps neither repeat the work
    nor depend on the executors that did it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/rows.parquet"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_least(frame: DataFrame, keys: list[str], value: str, name: str, parts: int = 64) -> DataFrame:
    """Adds the least value among the rows of equal keys. Rows of a hot key stay dealt over parts: only one row of each
    part is joined with the least of all."""
    dealt = frame.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(parts)))
    per_part = dealt.groupBy(*keys, "_part").agg(F.min(value).alias("_least"))
    least = per_part.groupBy(*keys).agg(F.min("_least").alias(name))
    return dealt.join(per_part.join(least, keys).select(*keys, "_part", name), [*keys, "_part"]).drop("_part")


def plain_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text of each row, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_tables(function: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that applies the function to whole tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(*(table(spark, sf_dir, name) for name in names))

    return run
