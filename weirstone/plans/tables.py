"""Tables of a folder, with the views of them that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def events_in_runs(spark: SparkSession, folder: str, runs: int = 13) -> DataFrame:
    """Events dealt over runs out of their order in time."""
    return events(spark, folder).withColumn("run", F.pmod(F.col("event_id") * 7919, F.lit(runs)))


HOUR = 3_600_000
DAY = 24 * HOUR
