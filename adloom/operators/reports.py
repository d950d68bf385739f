"""Aggregations over items, products and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KPI_MODULES = ["hooks", "scripts", "ads", "ugc", "imageprompts", "videoprompts", "offers", "abtesting"]


def campaign_kpis(items: DataFrame) -> DataFrame:
    """Item counts per campaign and module, as one row per campaign."""
    return items.groupBy("campaign_id").agg(*[F.count_if(F.col("module") == m).alias(f"n_{m}") for m in KPI_MODULES])


def campaign_cards(items: DataFrame) -> DataFrame:
    """One card per campaign, from items that carry the campaign's own columns: no second pass over the catalog."""
    own = ["name", "created", "source_label", "score"]
    counts = [F.count_if(F.col("module") == m).alias(f"n_{m}") for m in ("hooks", "scripts", "ads", "ugc")]
    return items.groupBy("campaign_id").agg(*[F.first(x).alias(x) for x in own], *counts)


def group_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("module", "item_group").agg(F.count("*").alias("n"))


def category_distribution(scored: DataFrame) -> DataFrame:
    """Products, mean score and mean price per category."""
    return scored.groupBy(F.col("resolved_id").alias("category_id")).agg(
        F.count("*").alias("products"), F.round(F.avg("score"), 4).alias("mean_score"),
        F.round(F.avg("recommended_price"), 4).alias("mean_price"))


def plan_workload(plan_items: DataFrame) -> DataFrame:
    """Pieces to produce by phase, priority and platform, with subtotals and the total."""
    pieces = F.col("attrs")["count"].cast("int")
    return plan_items.rollup(F.col("item_group").alias("phase"), F.col("attrs")["priority"].alias("priority"), F.col("attrs")["platform"].alias("platform")).agg(
        F.sum(pieces).alias("pieces"), F.count("*").alias("lines"))


def plan_summary(accounts: DataFrame, plans: DataFrame, plan_modules: DataFrame) -> DataFrame:
    """Per plan: price, limits, number of modules and features, and accounts that use it."""
    modules = plan_modules.groupBy("plan_id").agg(F.count("*").alias("modules"))
    used = accounts.groupBy("plan_id").agg(F.count("*").alias("accounts"))
    included = F.size(F.filter("features", lambda f: f["included"])).alias("features_included")
    return plans.select("plan_id", "plan_name", "price", "credits", "campaign_limit", included).join(
        modules, "plan_id").join(used, "plan_id", "left").fillna(0, ["accounts"])
