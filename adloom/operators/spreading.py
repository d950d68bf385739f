"""Spreading small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str = "product_id") -> DataFrame:
    """Spread a catalog read as a few splits over all cores before it is multiplied by templates.

    A catalog that already has a split per core is left alone, so large inputs are not exchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
