"""Credit ledger, profiles and subscription events."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom import schemas
from adloom.operators import accounts, billing, ledger
from adloom.queries.accounts import account_rows
from adloom.queries.inputs import table
from adloom.queries.registry import query

c = F.col
ACTIONS = {"purchase": "campaign", "click": "competitor", "view": "iteration"}
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
PRICES = {"max": "price_max", "premium": "price_premium"}


def action_of(event_type):
    names = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, event_type), event_type)


def spends(spark, sf, months: int = 1, signups: bool = True):
    """All events as spends; with months > 1 they are spread over so many months. One in 29 comes from nobody with a profile.

    ``signups`` leaves sign-ups in, as an action that nobody knows; with plan changes they are those.
    """
    ts = c("ts") + F.make_interval(months=F.pmod(c("event_id"), F.lit(months)).cast("int"))
    events = table(spark, sf, "events") if signups else table(spark, sf, "events").filter(c("event_type") != "signup")
    return events.select("event_id", ts.alias("ts"), user_of().alias("user_id"), action_of(c("event_type")).alias("action"))


def user_of():
    return F.when(c("event_id") % 29 == 0, -c("user_id") - 1).otherwise(c("user_id"))


def profiles(spark, sf):
    """Stored profiles of all accounts; half hold a balance of January 2024, some of a month after most of their events."""
    known = account_rows(spark, sf).withColumn("plan_id", accounts.known_plan(c("plan_id")))
    january = c("user_id") % 2 == 0
    period = F.when(c("user_id") % 7 == 3, "2024-02").when(january, "2024-01").otherwise("2023-12")
    return known.select(
        "user_id", "plan_id", (accounts.plan_quota(c("plan_id")) - F.when(january, 5).otherwise(0)).alias("credits"),
        period.alias("period"), F.when(c("user_id") % 6 == 0, 1).otherwise(0).alias("campaigns_this_month"))


def plan_changes(spark, sf, months: int = 1):
    ts = c("ts") + F.make_interval(months=F.pmod(c("event_id"), F.lit(months)).cast("int"))
    plan = F.element_at(F.array(F.lit("free"), F.lit("premium"), F.lit("max")), (c("event_id") % 3 + 1).cast("int"))
    return table(spark, sf, "events").filter(c("event_type") == "signup").select(
        "event_id", ts.alias("ts"), user_of().alias("user_id"), plan.alias("plan_id"), (c("event_id") % 2 == 1).alias("keeps_counter"))


PROFILE_SQL = """
profiles AS (
  SELECT c_custkey AS user_id, plan_id, CASE plan_id WHEN 'premium' THEN 100 WHEN 'max' THEN 500 ELSE 10 END - CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 0 END AS credits,
    CASE WHEN c_custkey % 7 = 3 THEN '2024-02' WHEN c_custkey % 2 = 0 THEN '2024-01' ELSE '2023-12' END AS period, CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS campaigns
  FROM (SELECT c_custkey, CASE WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'premium' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'max' ELSE 'free' END AS plan_id FROM customer))"""


def ledger_ctes(months: int, with_changes: bool) -> str:
    """A step-by-step run per account as a recursive query, ending in decisions."""
    change = "event_type = 'signup'" if with_changes else "FALSE"
    return f"""
ev AS (
  SELECT event_id, ts + to_months((event_id % {months})::INTEGER) AS ts, CASE WHEN event_id % 29 = 0 THEN -user_id - 1 ELSE user_id END AS user_id,
    CASE event_type WHEN 'purchase' THEN 'campaign' WHEN 'click' THEN 'competitor' WHEN 'view' THEN 'iteration' ELSE event_type END AS action,
    CASE event_type WHEN 'purchase' THEN 10 WHEN 'click' THEN 5 WHEN 'view' THEN 5 END AS cost,
    CASE WHEN {change} THEN ['free', 'premium', 'max'][event_id % 3 + 1] END AS new_plan, event_id % 2 = 1 AS keeps
  FROM events),
seq AS (SELECT *, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
{PROFILE_SQL.strip()},
run AS (
  SELECT p.user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, '' AS reason, p.plan_id, p.credits::INTEGER AS credits, p.period, p.campaigns::INTEGER AS campaigns FROM profiles p
  UNION ALL
  SELECT user_id, n, event_id, reason,
    CASE WHEN reason = 'change' THEN new_plan ELSE plan_id END,
    CASE WHEN reason = 'change' THEN CASE new_plan WHEN 'premium' THEN 100 WHEN 'max' THEN 500 ELSE 10 END
      WHEN reason = '' THEN credits - cost ELSE credits END::INTEGER,
    period,
    CASE WHEN reason = 'change' AND NOT keeps THEN 0 WHEN reason = '' AND action = 'campaign' THEN campaigns + 1 ELSE campaigns END::INTEGER
  FROM (
    SELECT *, CASE WHEN new_plan IS NOT NULL THEN CASE WHEN late THEN 'late_change' ELSE 'change' END WHEN cost IS NULL THEN 'bad_action' WHEN late THEN 'late'
        WHEN action = 'campaign' AND campaigns >= CASE plan_id WHEN 'premium' THEN 10 WHEN 'max' THEN 50 ELSE 1 END THEN 'limit'
        WHEN credits < cost THEN 'credits' ELSE '' END AS reason
    FROM (
      SELECT s.user_id, s.n, s.event_id, s.action, s.cost, s.new_plan, s.keeps, r.plan_id, s.month < r.period AS late,
        CASE WHEN s.cost IS NULL AND s.new_plan IS NULL THEN r.period ELSE greatest(s.month, r.period) END AS period,
        CASE WHEN (s.cost IS NOT NULL OR s.new_plan IS NOT NULL) AND r.period < s.month
          THEN CASE r.plan_id WHEN 'premium' THEN 100 WHEN 'max' THEN 500 ELSE 10 END ELSE r.credits END AS credits,
        CASE WHEN (s.cost IS NOT NULL OR s.new_plan IS NOT NULL) AND r.period < s.month THEN 0 ELSE r.campaigns END AS campaigns
      FROM run r JOIN seq s ON s.user_id = r.user_id AND s.n = r.n + 1))),
decisions AS (
  SELECT s.event_id, s.ts, s.user_id, s.action, coalesce(r.reason = '', FALSE) AS ok,
    CASE WHEN s.cost IS NULL THEN 'bad_action' WHEN r.event_id IS NULL THEN 'no_profile' ELSE r.reason END AS reason,
    CASE WHEN s.cost IS NOT NULL THEN r.credits END AS credits, CASE WHEN s.cost IS NOT NULL THEN r.campaigns END AS campaigns_this_month,
    CASE WHEN s.cost IS NOT NULL THEN r.plan_id END AS plan_id, CASE WHEN s.cost IS NOT NULL THEN r.period END AS period
  FROM seq s LEFT JOIN run r ON r.event_id = s.event_id WHERE s.new_plan IS NULL)"""


def ledger_sql(months: int, with_changes: bool, select: str) -> str:
    return "WITH RECURSIVE " + ledger_ctes(months, with_changes).strip() + "\n" + select


@query("credit_ledger", ledger_sql(1, False, "SELECT * FROM decisions"))
def _(spark, sf):
    return ledger.credit_ledger(spends(spark, sf), profiles(spark, sf))


@query("monthly_rollover", ledger_sql(3, False, "SELECT * FROM decisions"))
def _(spark, sf):
    return ledger.credit_ledger(spends(spark, sf, 3), profiles(spark, sf))


@query("ledger_with_plan_changes", ledger_sql(3, True, "SELECT * FROM decisions"))
def _(spark, sf):
    return ledger.credit_ledger(spends(spark, sf, 3, False), profiles(spark, sf), plan_changes(spark, sf, 3))


@query("running_balance", ledger_sql(1, False, "SELECT user_id, event_id, credits FROM decisions WHERE credits IS NOT NULL"))
def _(spark, sf):
    return ledger.credit_ledger(spends(spark, sf), profiles(spark, sf)).filter(c("credits").isNotNull()).select("user_id", "event_id", "credits")


@query("denials_report", ledger_sql(3, False, "SELECT strftime(ts, '%Y-%m') AS period, user_id, reason, count(*) AS events, count(*) FILTER (ok) AS accepted FROM decisions GROUP BY 1, 2, 3"))
def _(spark, sf):
    return ledger.denials_report(ledger.credit_ledger(spends(spark, sf, 3), profiles(spark, sf)))


LATEST = """,
final AS (SELECT p.user_id, p.plan_id, coalesce(f.credits, p.credits) AS credits, coalesce(f.period, p.period) AS period, coalesce(f.campaigns, p.campaigns) AS campaigns
  FROM profiles p LEFT JOIN (SELECT user_id, arg_max(credits, n) AS credits, arg_max(period, n) AS period, arg_max(campaigns, n) AS campaigns FROM run WHERE n > 0 GROUP BY 1) f USING (user_id))"""


@query("current_profile", ledger_sql(3, False, "").rstrip() + LATEST + """
SELECT user_id, plan_id, greatest(period, '2024-02') AS period, CASE WHEN period < '2024-02' THEN CASE plan_id WHEN 'premium' THEN 100 WHEN 'max' THEN 500 ELSE 10 END ELSE credits END AS credits,
  CASE WHEN period < '2024-02' THEN 0 ELSE campaigns END AS campaigns_this_month FROM final""")
def _(spark, sf):
    # Some states are of March already and stay as they are.
    states = ledger.account_states(spends(spark, sf, 3), profiles(spark, sf))
    return ledger.current_profile(states, F.lit("2024-02-15 00:00:00").cast("timestamp"))


PROBES = 45


@query("profile_as_of", ledger_sql(3, True, "").rstrip() + f""",
history AS (SELECT user_id, since, arg_max(plan_id, n) AS plan_id, arg_max(credits, n) AS credits, arg_max(period, n) AS period, arg_max(campaigns, n) AS campaigns
  FROM (SELECT r.*, coalesce(s.ts, TIMESTAMP '0001-01-01') AS since FROM run r LEFT JOIN seq s ON s.user_id = r.user_id AND s.n = r.n) GROUP BY ALL),
probes AS (SELECT event_id, user_id, ts + to_days((event_id % {PROBES})::INTEGER) AS at FROM events)
SELECT event_id, p.user_id, at, plan_id, CASE WHEN period < strftime(at, '%Y-%m') THEN CASE plan_id WHEN 'premium' THEN 100 WHEN 'max' THEN 500 ELSE 10 END ELSE credits END AS credits,
  greatest(period, CASE WHEN period IS NOT NULL THEN strftime(at, '%Y-%m') END) AS period, CASE WHEN period < strftime(at, '%Y-%m') THEN 0 ELSE campaigns END AS campaigns_this_month
FROM probes p ASOF LEFT JOIN history h ON p.user_id = h.user_id AND p.at >= h.since""".replace(" at,", " asked,").replace(" at >", " asked >").replace(" AS at ", " AS asked ").replace("(at,", "(asked,").replace("p.at ", "p.asked "))
def _(spark, sf):
    asked = c("ts") + F.make_interval(days=(c("event_id") % PROBES).cast("int"))
    probes = table(spark, sf, "events").select("event_id", "user_id", asked.alias("asked"))
    history = ledger.account_history(spends(spark, sf, 3, False), profiles(spark, sf), plan_changes(spark, sf, 3))
    return ledger.profile_as_of(history, probes, "asked")


@query("late_events", "WITH " + PROFILE_SQL.strip() + """,
ev AS (SELECT event_id, ts + to_months((event_id % 3)::INTEGER) AS ts, CASE WHEN event_id % 29 = 0 THEN -user_id - 1 ELSE user_id END AS user_id, event_type,
  CASE event_type WHEN 'purchase' THEN 'campaign' WHEN 'click' THEN 'competitor' WHEN 'view' THEN 'iteration' ELSE event_type END AS action FROM events)
SELECT event_id, ts, user_id, CASE WHEN event_type <> 'signup' THEN action END AS action, CASE WHEN event_type = 'signup' THEN ['free', 'premium', 'max'][event_id % 3 + 1] END AS plan_id, period AS held_in
FROM ev JOIN profiles USING (user_id) WHERE strftime(ts, '%Y-%m') < period""")
def _(spark, sf):
    return ledger.late_events(spends(spark, sf, 3, False), profiles(spark, sf), plan_changes(spark, sf, 3))


@query("usage_summary", ledger_sql(1, False, "").rstrip() + LATEST + """
SELECT user_id, plan_id, period, credits, quota, campaigns AS campaigns_this_month, campaign_limit, greatest(0.0::DOUBLE, least(100.0::DOUBLE, credits / quota * 100)) AS pct, credits < 10 AS low
FROM (SELECT *, CASE plan_id WHEN 'premium' THEN 100 WHEN 'max' THEN 500 ELSE 10 END AS quota, CASE plan_id WHEN 'premium' THEN 10 WHEN 'max' THEN 50 ELSE 1 END AS campaign_limit FROM final)""")
def _(spark, sf):
    return ledger.usage_summary(ledger.account_states(spends(spark, sf), profiles(spark, sf)))


@query("account_states", ledger_sql(3, True, "").rstrip() + """,
final AS (SELECT user_id, arg_max(plan_id, n) AS plan_id, arg_max(credits, n) AS credits, arg_max(period, n) AS period, arg_max(campaigns, n) AS campaigns_this_month FROM run GROUP BY 1)
SELECT * FROM final""")
def _(spark, sf):
    return ledger.account_states(spends(spark, sf, 3, False), profiles(spark, sf), plan_changes(spark, sf, 3))


@query("provision_profiles", "WITH " + PROFILE_SQL.strip() + """
SELECT user_id, plan_id, credits, period, campaigns AS campaigns_this_month FROM profiles
UNION ALL SELECT DISTINCT -user_id - 1, 'free', 10, '2024-02', 0 FROM events WHERE event_id % 29 = 0""")
def _(spark, sf):
    users = account_rows(spark, sf).select("user_id").unionByName(spends(spark, sf).select("user_id"))
    return ledger.provision_profiles(profiles(spark, sf), users, F.lit("2024-02-01").cast("timestamp"))


def subscription_events(spark, sf):
    return billing_events(table(spark, sf, "events"))


def billing_events(events):
    """Billing events made from the event log, as JSON text read back with the explicit schema."""
    k = c("event_id")
    kind = (F.when(c("event_type") == "signup", "checkout.session.completed").when(c("event_type") == "click", "customer.subscription.updated")
            .when(c("event_type") == "error", "customer.subscription.deleted").otherwise("invoice.paid"))
    nth = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    body = F.to_json(F.struct(
        k.cast("string").alias("event_id"), kind.alias("type"), c("ts").cast("timestamp").alias("created"), F.struct(
            F.when(k % 13 != 0, c("user_id")).alias("user_id"), nth(["premium", "max", "gold"], k).alias("plan"),
            nth(["active", "trialing", "past_due", "canceled", "unpaid"], k).alias("status"), nth(["price_max", "price_premium", "price_x"], k).alias("price_id")).alias("data")), MICROS)
    return events.select(F.from_json(body, schemas.SUBSCRIPTION_EVENT).alias("e")).select("e.*")


SUBSCRIPTION_SQL = """
sub AS (
  SELECT event_id, ts, user_id, CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 3 < 2 THEN ['premium', 'max'][event_id % 3 + 1] END
    WHEN 'click' THEN CASE WHEN event_id % 5 IN (0, 1) THEN CASE event_id % 3 WHEN 0 THEN 'max' WHEN 1 THEN 'premium' END WHEN event_id % 5 IN (3, 4) THEN 'free' END
    WHEN 'error' THEN 'free' END AS plan_id
  FROM events WHERE event_id % 13 <> 0),
changes AS (SELECT * FROM sub WHERE plan_id IS NOT NULL)"""


@query("price_to_plan", "SELECT event_id::VARCHAR AS event_id, CASE event_id % 3 WHEN 0 THEN 'max' WHEN 1 THEN 'premium' END AS plan_id FROM events")
def _(spark, sf):
    return subscription_events(spark, sf).select("event_id", billing.price_to_plan(c("data.price_id"), PRICES).alias("plan_id"))


@query("subscription_plan_changes", "WITH " + SUBSCRIPTION_SQL.strip() + " SELECT event_id::VARCHAR AS event_id, ts, user_id, plan_id, FALSE AS keeps_counter FROM changes")
def _(spark, sf):
    changes = billing.to_plan_changes(subscription_events(spark, sf), PRICES)
    return changes.withColumn("ts", c("ts").cast("timestamp_ntz"))


APPLIED_SQL = ("WITH " + PROFILE_SQL.strip() + "," + SUBSCRIPTION_SQL + """,
latest AS (SELECT user_id, arg_max(plan_id, (ts, event_id::VARCHAR)) AS plan_id, max(ts) AS ts FROM changes GROUP BY 1)
SELECT p.user_id, coalesce(l.plan_id, p.plan_id) AS plan_id,
  CASE WHEN l.plan_id IS NULL THEN p.credits ELSE CASE l.plan_id WHEN 'premium' THEN 100 WHEN 'max' THEN 500 ELSE 10 END END AS credits,
  coalesce(strftime(l.ts, '%Y-%m'), p.period) AS period, CASE WHEN l.plan_id IS NULL THEN p.campaigns ELSE 0 END AS campaigns_this_month
FROM profiles p LEFT JOIN latest l USING (user_id)""")


@query("apply_subscription_events", APPLIED_SQL)
def _(spark, sf):
    return billing.apply_subscription_events(profiles(spark, sf), subscription_events(spark, sf), PRICES)
