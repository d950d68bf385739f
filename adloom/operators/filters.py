"""Searches and predicates over items and configuration rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_items(items: DataFrame, needle: str = "", group: str | None = None, text_col: str = "text",
                 group_col: str = "item_group") -> DataFrame:
    """Items of a group (or of all) whose text contains the needle in any letter case."""
    if group is not None:
        items = items.filter(F.col(group_col) == group)
    return items.filter(F.lower(text_col).contains(needle.lower())) if needle else items


def by_attribute(items: DataFrame, name: str, value: str | None) -> DataFrame:
    """Optional equality on one attribute, such as duration, tool or platform."""
    return items if value is None else items.filter(F.col("attrs")[name] == value)


def modules_by_group(modules: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Module ids per group in listed order; groups without modules do not appear."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "module_id")))
    return modules.groupBy(*keys, "module_group").agg(F.array_join(F.transform(ordered, lambda m: m["module_id"]), ",").alias("modules"))


def links_by_platform(items: DataFrame) -> DataFrame:
    """Research links of a product per platform, in listed order (at most the templates of one platform)."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return items.groupBy("product_id", F.col("item_group").alias("platform")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("links"))


def missing_config(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows with the names of required fields that are empty; complete rows are left out."""
    unset = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    missing: Column = F.array_compact(F.array(*[F.when(unset(c), F.lit(c)) for c in required]))
    return df.withColumn("missing", missing).filter(F.size("missing") > 0)
