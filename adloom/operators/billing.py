"""Subscription events to plan changes and profile updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.numbers import billing_period
from adloom.knowledge.subscriptions import ENDED_STATUSES, PAID_STATUSES
from adloom.operators.accounts import plan_quota


def price_to_plan(price_id: Column, prices: dict[str, str]) -> Column:
    """Plan of a billing price; null for prices outside the (plan -> price) configuration."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for plan, price in prices.items():
        out = out.when(price_id == price, plan)
    return out


def plan_of_event(prices: dict[str, str]) -> Column:
    """Plan that an event sets; null when the event changes nothing."""
    kind, d = F.col("type"), F.col("data")
    paid = F.when(d["plan"].isin("premium", "max"), d["plan"])
    updated = F.when(d["status"].isin(PAID_STATUSES), price_to_plan(d["price_id"], prices)).when(d["status"].isin(ENDED_STATUSES), "free")
    return (F.when(d["user_id"].isNull(), None).when(kind == "checkout.session.completed", paid)
            .when(kind == "customer.subscription.updated", updated).when(kind == "customer.subscription.deleted", "free"))


def to_plan_changes(events: DataFrame, prices: dict[str, str]) -> DataFrame:
    """Effective events in the shape the ledger takes; every one resets the campaign count."""
    changed = events.withColumn("plan_id", plan_of_event(prices)).filter(F.col("plan_id").isNotNull())
    return changed.select("event_id", F.col("created").alias("ts"), F.col("data.user_id").alias("user_id"), "plan_id",
                          F.lit(False).alias("keeps_counter"))


def apply_subscription_events(profiles: DataFrame, events: DataFrame, prices: dict[str, str]) -> DataFrame:
    """Profiles after a batch: the latest effective event per user sets plan, credits, month and count.

    The latest event is an aggregate with a map-side step, so replays of one user shrink before the exchange.
    """
    latest = to_plan_changes(events, prices).groupBy("user_id").agg(F.max_by(F.struct("plan_id", "ts"), F.struct("ts", "event_id")).alias("e"))
    hit = F.col("e").isNotNull()
    put = lambda new, old: F.when(hit, new).otherwise(F.col(old)).alias(old)
    return profiles.join(latest, "user_id", "left").select(
        "user_id", put(F.col("e.plan_id"), "plan_id"), put(plan_quota(F.col("e.plan_id")), "credits"),
        put(billing_period(F.col("e.ts")), "period"), put(F.lit(0), "campaigns_this_month"))
