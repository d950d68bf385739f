"""Balances above the plan quota, URLs as browsers read them, event tables that are folders."""

import datetime as dt

from pyspark.sql import functions as F

from adloom.functions import urls
from adloom.operators.ledger import credit_ledger
from adloom.queries.streaming import event_stream


def test_stored_balance_above_quota(spark):
    at = dt.datetime(2024, 1, 1)
    spends = spark.createDataFrame([(i, at + dt.timedelta(seconds=i), u, "iteration") for i in range(150) for u in (1, 2)],
                                   "event_id long, ts timestamp, user_id long, action string")
    profiles = spark.createDataFrame([(1, "max", 1000, "2024-01", 0), (2, "max", 7, "2024-01", 0)],
                                     "user_id long, plan_id string, credits int, period string, campaigns_this_month int")
    rows = credit_ledger(spends, profiles).filter("ok").groupBy("user_id").agg(F.count("*").alias("n"), F.min("credits").alias("left")).collect()
    cost = (1000 - {r.user_id: r.left for r in rows}[1]) // {r.user_id: r.n for r in rows}[1]
    assert {r.user_id: r.n for r in rows} == {u: n for u, n in ((1, min(150, 1000 // cost)), (2, 7 // cost)) if n}


def test_urls_of_browsers(spark):
    cases = {"https://www.shop.example/p/Super-Widget-Deluxe/dp/1?ref=a|b": ("shop.example", "Super Widget Deluxe"),
             "https://mi_tienda.es/Super-Widget-Deluxe": ("mi_tienda.es", "Super Widget Deluxe"),
             "https://USER:pw@Shop.example:8080/Super Widget-Deluxe x": ("shop.example", None),
             "https://user@mail.example:p@w@Shop.example/Super-Widget-Deluxe": ("shop.example", "Super Widget Deluxe"),
             "no url": ("no url", "")}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    for r in df.select("u", urls.url_domain(F.col("u")).alias("d"), urls.guess_name(F.col("u")).alias("n")).collect():
        domain, name = cases[r.u]
        assert r.d == domain and (name is None or r.n == name), r


def test_events_in_a_folder(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    query = event_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("folder_events").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("folder_events").count() == spark.read.parquet(f"{sf}/events.parquet").count()
