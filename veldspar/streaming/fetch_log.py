"""A growing log of page fetches: JSON lines that are appended to a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "url string, status int, fetched_at timestamp, attempts int, bytes bigint, path string, error string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """New log lines as they come."""
    return spark.readStream.schema(SCHEMA).json(folder)


def by_hour(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, fetches, failures) of each hour; lines that come later than ``late`` are left out of closed hours."""
    hour = F.window("fetched_at", "1 hour")
    failed = F.coalesce((F.col("status") >= 400) | F.col("error").isNotNull(), F.lit(False)).cast("bigint")
    return log.withWatermark("fetched_at", late).groupBy(hour.alias("w")).agg(F.count("*").alias("fetches"), F.sum(failed).alias("failures")).select(F.col("w.start").alias("hour"), "fetches", "failures")
