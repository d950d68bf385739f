"""Accounts, plans, stored campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from adloom.operators import accounts, campaigns, filters, reports, selection
from adloom.queries import sqlkit as S
from adloom.queries.inputs import table
from adloom.queries.registry import query
from adloom.sources.static import load_plans, plan_modules

c = F.col

ACCOUNTS_SQL = """accounts AS (SELECT c_custkey AS user_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'free'
  WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'premium' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'max' ELSE 'otro' END AS plan_id FROM customer)"""


def account_rows(spark, sf, *extra):
    """Accounts with a plan taken from the market segment."""
    s = c("c_mktsegment")
    plan = (F.when(s.isin("BUILDING", "MACHINERY"), "free").when(s.isin("FURNITURE", "HOUSEHOLD"), "premium")
            .when(s == "AUTOMOBILE", "max").otherwise("otro"))
    return table(spark, sf, "customer").select(c("c_custkey").alias("user_id"), plan.alias("plan_id"), *extra)


KNOWN = "CASE WHEN plan_id IN (SELECT plan_id FROM plans) THEN plan_id ELSE 'free' END"


@query("plan_lookup", S.with_ctes(S.PLAN_CTE, ACCOUNTS_SQL) + f"""
SELECT user_id, p.* FROM (SELECT user_id, {KNOWN} AS plan_id FROM accounts) a JOIN plans p USING (plan_id)""")
def _(spark, sf):
    return accounts.plan_lookup(account_rows(spark, sf))


@query("entitlements", S.with_ctes(S.PLAN_CTE, S.MODULE_CTE, ACCOUNTS_SQL) + f"""
SELECT user_id, a.plan_id, m.module_id, m.module_name, m.module_group, m.min_plan FROM (SELECT user_id, {KNOWN} AS plan_id FROM accounts) a
JOIN plans p USING (plan_id) JOIN modules m ON p.rank >= (SELECT q.rank FROM plans q WHERE q.plan_id = m.min_plan)""")
def _(spark, sf):
    return accounts.entitlements(account_rows(spark, sf)).drop("ord")


@query("locked_modules", S.with_ctes(S.PLAN_CTE, S.MODULE_CTE, ACCOUNTS_SQL) + f"""
SELECT user_id, a.plan_id, m.module_id, m.module_name, m.min_plan AS required_plan, q.price AS required_price
FROM (SELECT user_id, {KNOWN} AS plan_id FROM accounts) a JOIN plans p USING (plan_id) JOIN modules m ON TRUE JOIN plans q ON q.plan_id = m.min_plan
WHERE p.rank < q.rank""")
def _(spark, sf):
    return accounts.locked_modules(account_rows(spark, sf))


@query("plan_change_direction", S.with_ctes(S.PLAN_CTE) + """
SELECT event_id, CASE WHEN b.rank > a.rank THEN 'upgrade' WHEN b.rank < a.rank THEN 'downgrade' ELSE 'same' END AS direction
FROM (SELECT event_id, ['free', 'premium', 'max'][event_id % 3 + 1] AS o, ['free', 'premium', 'max'][user_id % 3 + 1] AS n FROM events)
JOIN plans a ON a.plan_id = o JOIN plans b ON b.plan_id = n""")
def _(spark, sf):
    nth = lambda k: F.element_at(F.array(F.lit("free"), F.lit("premium"), F.lit("max")), (c(k) % 3 + 1).cast("int"))
    return table(spark, sf, "events").select(
        "event_id", accounts.change_direction(nth("event_id"), nth("user_id")).alias("direction"))


@query("plan_quota", S.with_ctes(S.PLAN_CTE, ACCOUNTS_SQL) + f"""
SELECT user_id, credits, campaign_limit FROM (SELECT user_id, {KNOWN} AS plan_id FROM accounts) JOIN plans USING (plan_id)""")
def _(spark, sf):
    return account_rows(spark, sf).select("user_id", accounts.plan_quota(c("plan_id")).alias("credits"),
                                          accounts.plan_campaign_limit(c("plan_id")).alias("campaign_limit"))


@query("action_cost", S.with_ctes(S.COST_CTE) + """
SELECT event_type, cost, count(*) AS n FROM (SELECT event_type, CASE event_type WHEN 'purchase' THEN 'campaign' WHEN 'click' THEN 'competitor'
  WHEN 'view' THEN 'iteration' ELSE event_type END AS action FROM events) LEFT JOIN costs USING (action) GROUP BY 1, 2""")
def _(spark, sf):
    from adloom.queries.ledger import action_of
    return table(spark, sf, "events").groupBy("event_type", accounts.action_cost(action_of(c("event_type"))).alias("cost")).agg(
        F.count("*").alias("n"))


@query("plan_summary", S.with_ctes(S.PLAN_CTE, S.MODULE_CTE, ACCOUNTS_SQL) + f"""
SELECT plan_id, plan_name, price, credits, campaign_limit, features_included,
  (SELECT count(*) FROM modules m JOIN plans q ON q.plan_id = m.min_plan WHERE q.rank <= p.rank) AS modules,
  (SELECT count(*) FROM accounts a WHERE CASE WHEN a.plan_id = 'otro' THEN 'free' ELSE a.plan_id END = p.plan_id) AS accounts
FROM plans p JOIN (VALUES ('free', 2), ('premium', 3), ('max', 4)) f(plan_id, features_included) USING (plan_id)""")
def _(spark, sf):
    known = account_rows(spark, sf).withColumn("plan_id", accounts.known_plan(c("plan_id")))
    return reports.plan_summary(known, load_plans(spark), plan_modules(spark))


@query("modules_by_group", S.with_ctes(S.PLAN_CTE, S.MODULE_CTE, ACCOUNTS_SQL) + f"""
SELECT plan_id, module_group, string_agg(module_id, ',' ORDER BY m.ord) AS modules
FROM (SELECT DISTINCT {KNOWN} AS plan_id FROM accounts) a JOIN plans p USING (plan_id) JOIN plans q ON q.rank <= p.rank JOIN modules m ON m.min_plan = q.plan_id
GROUP BY 1, 2""")
def _(spark, sf):
    used = account_rows(spark, sf).select(accounts.known_plan(c("plan_id")).alias("plan_id")).distinct()
    return filters.modules_by_group(used.join(F.broadcast(plan_modules(spark)), "plan_id"), ["plan_id"])


@query("latest_n", """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 12""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return selection.latest_n(orders, "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


CHANGES = """SELECT o_orderkey + CASE WHEN o_orderpriority = '1-URGENT' THEN 1000000000 ELSE 0 END AS id, 'X' AS status,
  o_orderdate + INTERVAL 1 DAY AS updated FROM orders WHERE o_orderstatus = 'P'"""
STORED = "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS updated FROM orders"


def stored_and_changes(spark, sf):
    """All orders as stored rows; pending ones also as changes, of which urgent ones are new."""
    orders = table(spark, sf, "orders")
    stored = orders.select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"), c("o_orderdate").alias("updated"))
    new_id = c("o_orderkey") + F.when(c("o_orderpriority") == "1-URGENT", 1000000000).otherwise(0)
    changes = orders.filter(c("o_orderstatus") == "P").select(
        new_id.alias("id"), F.lit("X").alias("status"), (c("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("updated"))
    return stored, changes


@query("upsert_campaigns", f"SELECT * FROM ({CHANGES}) UNION ALL SELECT * FROM ({STORED}) WHERE id NOT IN (SELECT id FROM ({CHANGES}))")
def _(spark, sf):
    return campaigns.upsert_campaigns(*stored_and_changes(spark, sf), "id", "updated")


@query("update_by_id", f"SELECT * FROM ({CHANGES}) WHERE id < 1000000000 UNION ALL SELECT * FROM ({STORED}) WHERE id NOT IN (SELECT id FROM ({CHANGES}))")
def _(spark, sf):
    return campaigns.update_by_id(*stored_and_changes(spark, sf), "id")


@query("delete_campaigns", f"SELECT * FROM ({STORED}) WHERE id NOT IN (SELECT id FROM ({CHANGES}))")
def _(spark, sf):
    stored, changes = stored_and_changes(spark, sf)
    return campaigns.delete_campaigns(stored, changes, "id")


@query("active_campaign", f"SELECT * FROM ({STORED}) WHERE id = 42")
def _(spark, sf):
    return campaigns.active_campaign(stored_and_changes(spark, sf)[0], "id", 42)
