"""Plans and entitlements of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.knowledge import subscriptions
from adloom.sources.static import load_plans, plan_locked, plan_modules


def known_plan(plan_id: Column) -> Column:
    """The plan id when it is a known one, else the first plan."""
    return F.when(plan_id.isin(list(subscriptions.RANK)), plan_id).otherwise(subscriptions.DEFAULT_PLAN)


def _by_plan(values: dict, plan_id: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[known_plan(plan_id)]


def plan_rank(plan_id: Column) -> Column:
    return _by_plan(subscriptions.RANK, plan_id)


def plan_quota(plan_id: Column) -> Column:
    return _by_plan(subscriptions.CREDITS, plan_id)


def plan_campaign_limit(plan_id: Column) -> Column:
    return _by_plan(subscriptions.CAMPAIGN_LIMIT, plan_id)


def action_cost(action: Column) -> Column:
    """Credits of an action; null for an unknown one."""
    costs = subscriptions.ACTION_COSTS
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in costs.items() for x in kv]), action)


def plan_lookup(accounts: DataFrame) -> DataFrame:
    plans = load_plans(accounts.sparkSession).drop("features")
    return accounts.withColumn("plan_id", known_plan(F.col("plan_id"))).join(F.broadcast(plans), "plan_id")


def entitlements(accounts: DataFrame) -> DataFrame:
    """Modules that each account may use; the rank comparison is done once per plan, not per account."""
    known = accounts.withColumn("plan_id", known_plan(F.col("plan_id")))
    return known.join(F.broadcast(plan_modules(accounts.sparkSession)), "plan_id")


def locked_modules(accounts: DataFrame) -> DataFrame:
    """Modules outside the account's plan, with the plan that includes them and its price."""
    known = accounts.withColumn("plan_id", known_plan(F.col("plan_id")))
    return known.join(F.broadcast(plan_locked(accounts.sparkSession)), "plan_id")


def change_direction(old: Column, new: Column) -> Column:
    a, b = plan_rank(old), plan_rank(new)
    return F.when(b > a, "upgrade").when(b < a, "downgrade").otherwise("same")
