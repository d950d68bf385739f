"""Stored campaigns: upsert, update, delete and lookup by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.operators.selection import top_k_per_key


def upsert_campaigns(stored: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """One row per id: the one with the highest version, changes first when versions are equal."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return top_k_per_key(both, [key], [F.col(version).desc(), F.col("_new").desc()], 1).drop("rank", "_new")


def update_by_id(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Replace stored rows that have a change; changes for unknown ids are ignored."""
    known = changes.join(stored.select(key), key, "left_semi")
    return stored.join(changes.select(key), key, "left_anti").unionByName(known)


def delete_campaigns(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def active_campaign(stored: DataFrame, key: str, wanted) -> DataFrame:
    """The row with an id, or none; a literal id reaches the scan as a pushed filter."""
    return stored.filter(F.col(key) == wanted)
