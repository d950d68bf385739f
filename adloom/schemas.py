"""Explicit schemas of inputs and documents."""

from pyspark.sql import types as T

PRODUCT = "name string, description string, source_url string, source_type string, price string, image_data_url string, audience_hint string, category_id string"
PROFILE = "user_id long, email string, plan_id string, credits int, period string, campaigns_this_month int, stripe_customer_id string, created_at timestamp"
SPEND = "event_id long, ts timestamp, user_id long, action string"
SUBSCRIPTION_EVENT = (
    "event_id string, type string, created timestamp, "
    "data struct<user_id: long, plan: string, status: string, price_id: string>"
)
CREATIVE_ITEM = (
    "campaign_id string, module string, item_group string, ord int, title string, text string, attrs map<string,string>"
)
AUDIENCE = "struct<name: string, description: string, pains: array<string>>"
CATEGORY = (
    "ord int, id string, name string, keywords array<string>, problem string, secondary_problems array<string>, "
    f"benefits array<string>, desires array<string>, fears array<string>, audiences array<{AUDIENCE}>, "
    "visual_hooks array<string>, environment string, demo_action string, wow_moment string, price_lo int, "
    "price_hi int, saturation int, visual_appeal int, explainability int, ugc_fit int"
)
# Replacement document written by an outside writer: every top-level field is required.
OVERLAY = (
    f"problem string, secondaryProblems array<string>, benefits array<string>, audiences array<{AUDIENCE}>, "
    "angles array<struct<name: string, emotion: string, description: string, bigIdea: string>>, "
    "objections array<struct<objection: string, response: string>>, differentiators array<string>, "
    "pricing struct<recommended: string, range: string, strategy: string, marginNote: string>, "
    "scoreVerdict string, scoreTotal int, hooks array<struct<category: string, items: array<string>>>, "
    "landing struct<headline: string, subheadline: string, guarantee: string>, "
    "ugcScripts array<struct<persona: string, hook: string, script: string>>"
)


def fields(ddl: str) -> list[str]:
    return T.StructType.fromDDL(ddl).fieldNames()
