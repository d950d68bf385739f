"""Billing and spend events as batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adloom import schemas


def read_subscription_events(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 1_000) -> DataFrame:
    """JSON events with the explicit schema."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    return reader.schema(schemas.SUBSCRIPTION_EVENT).json(path)


def read_spends(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 1_000) -> DataFrame:
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    return reader.schema(schemas.SPEND).json(path)
