import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from adloom.operators import asof, ledger
from adloom.operators.billing import apply_subscription_events
from adloom.queries import ledger as q
from adloom.sources.events import read_subscription_events
from adloom.streaming.dedup import ReplayMemory, dedup_events, dedup_stream
from adloom.streaming.ledger import credit_ledger_stream, decide, ledger_by_batch, on_time
from adloom.streaming.profiles import current_table, read_version, snapshot_version, upsert_profiles_stream

KEYS = ["event_id", "user_id", "action", "ok", "reason", "credits", "campaigns_this_month", "plan_id", "period"]


def rows(df, columns=KEYS):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def event_log(spark, sf):
    """Spends and plan changes of three months in one table; some changes keep the campaign count."""
    spends = q.spends(spark, sf, 3, False).withColumns({"plan_id": F.lit(None).cast("string"), "keeps_counter": F.lit(None).cast("boolean")})
    changes = q.plan_changes(spark, sf, 3).select("event_id", "ts", "user_id", F.lit(None).cast("string").alias("action"), "plan_id", "keeps_counter")
    return spends.unionByName(changes).withColumn("ts", F.col("ts").cast("timestamp"))


def opening(spark, sf):
    """Stored profiles; the month of some is after that of their first events."""
    return q.profiles(spark, sf).withColumns({c: F.col(c).cast("int") for c in ("credits", "campaigns_this_month")})


def expected(spark, sf):
    log = event_log(spark, sf)
    return ledger.credit_ledger(log.filter("plan_id is null").drop("plan_id", "keeps_counter"), opening(spark, sf), log.filter("plan_id is not null").drop("action"))


CLOSE = "event_id long, ts timestamp, user_id long, action string, plan_id string, keeps_counter boolean"


def stream_of(spark, sf, folder, files=3, late=()):
    """The log as files in time order, rows shuffled in each, one file per micro-batch; then the ``late`` rows and a row that closes the stream."""
    log = event_log(spark, sf).orderBy("ts", "event_id").toPandas()
    log["keeps_counter"] = log["keeps_counter"].astype(object).where(log["keeps_counter"].notna(), None)
    step = len(log) // files + 1
    for i in range(files):
        part = log.iloc[i * step:(i + 1) * step].sample(frac=1, random_state=i)
        spark.createDataFrame(part, CLOSE).coalesce(1).write.mode("append").parquet(folder)
    for rows in ([*late], [(-1, datetime(2100, 1, 1), -1, "close", None, None)]):
        if rows:
            spark.createDataFrame(rows, CLOSE).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(CLOSE).option("maxFilesPerTrigger", 1).parquet(folder)


def test_keyed_stream_equals_batch(spark, sf, tmp_path):
    """Three batches of shuffled rows in chunks of 50, then rows that come too late."""
    late = [(10**9, datetime(2024, 1, 5), 1, "campaign", None, None), (10**9 + 1, datetime(2024, 1, 6), 1, None, "max", False), (10**9 + 2, datetime(2024, 1, 7), -5, "view", None, None)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        out = credit_ledger_stream(stream_of(spark, sf, str(tmp_path / "in"), late=late), opening(spark, sf))
        query = (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        spark.conf.set(key, before)
    decided, side = on_time(spark.read.parquet(str(tmp_path / "out")).filter("event_id >= 0"))
    got = rows(decided)
    assert got == rows(expected(spark, sf)) and any(r[4] == "late" for r in got)
    assert rows(side, ["event_id", "action", "plan_id"]) == sorted([(e[0], e[3], e[4]) for e in late], key=repr)


def test_batchwise_stream_equals_batch(spark, sf, tmp_path):
    events = stream_of(spark, sf, str(tmp_path / "in"), files=3)
    query = ledger_by_batch(events, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp"), opening(spark, sf))
    query.awaitTermination(300)
    assert query.exception() is None
    assert rows(spark.read.parquet(str(tmp_path / "out" / "decisions")).filter("event_id >= 0")) == rows(expected(spark, sf))
    log = event_log(spark, sf)
    want = ledger.late_events(log.filter("plan_id is null").select("event_id", "ts", "user_id", "action"), opening(spark, sf), log.filter("plan_id is not null").drop("action"))
    columns = ["event_id", "user_id", "action", "plan_id", "held_in"]
    assert rows(spark.read.parquet(str(tmp_path / "out" / "late")), columns) == rows(want, columns) and want.count()
    last = read_version(spark, str(tmp_path / "state"), 2)
    assert last.count() == opening(spark, sf).count()


def test_states_never_go_back(spark):
    spends = spark.createDataFrame([(1, datetime(2024, 1, 5), 1, "iteration"), (2, datetime(2024, 4, 1), 2, "iteration")], "event_id long, ts timestamp, user_id long, action string")
    profiles = spark.createDataFrame([(1, "free", 3, "2024-03", 1), (2, "free", 3, "2024-03", 1)], "user_id long, plan_id string, credits int, period string, campaigns_this_month int")
    changes = spark.createDataFrame([(3, datetime(2024, 2, 1), 1, "max", False)], "event_id long, ts timestamp, user_id long, plan_id string, keeps_counter boolean")
    for late in (None, changes):
        decisions, states = ledger.run_ledger(spends, profiles, late)
        assert [tuple(r)[4:] for r in decisions.orderBy("event_id").collect()] == [(False, "late", 3, 1, "free", "2024-03"), (True, "", 5, 0, "free", "2024-04")]
        assert rows(states, states.columns) == [(1, "free", 3, "2024-03", 1), (2, "free", 5, "2024-04", 0)]
    now = ledger.current_profile(states, F.lit("2024-02-10").cast("timestamp"))
    assert rows(now, ["user_id", "credits", "period"]) == [(1, 3, "2024-03"), (2, 5, "2024-04")]
    assert rows(ledger.late_events(spends, profiles, changes), ["event_id", "held_in"]) == [(1, "2024-03"), (3, "2024-03")]


def test_as_of_against_a_scan(spark):
    """A hot key, ties in time, probes before the first and at the time of a row, null keys and times."""
    rng = random.Random(6)
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 20))
    history = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([at(), datetime(2024, 1, 9, 12)]), i, f"v{i}") for i in range(300)]
    probes = [(i, rng.choice([1, 2, 3, 4, None]), rng.choice([at(), datetime(2024, 1, 9, 12), None])) for i in range(400)]
    h = spark.createDataFrame(history, "k long, t timestamp, n long, v string")
    p = spark.createDataFrame(probes, "id long, k long, at timestamp")
    want = {}
    for i, k, t in probes:
        past = [r for r in history if k is not None and t is not None and r[0] == k and r[1] <= t]
        want[i] = max(past, key=lambda r: (r[1], r[2]))[3] if past else None
    for chunk in ("1 hour", "3 days", "900 days"):
        assert {r.id: r.v for r in asof.as_of(p, h, "k", "at", ["t", "n"], ["v"], chunk).collect()} == want
    assert asof.as_of(p, h.limit(0), "k", "at", ["t", "n"], ["v"]).filter("v IS NULL").count() == len(probes)


def test_late_event_does_not_roll_back():
    state = ("premium", 40, "2024-03", 6)
    assert decide(state, "campaign", None, "2024-02") == (state, (False, "late", 40, 6, "premium", "2024-03"))
    assert decide(state, "nothing", None, "2024-03") == (state, (False, "bad_action", None, None, None, None))
    assert decide(None, "campaign", None, "2024-03")[1][1] == "no_profile"
    assert decide(state, None, "free", "2024-03", True)[0] == ("free", 10, "2024-03", 6) and decide(state, None, "free", "2024-04", True)[0] == ("free", 10, "2024-04", 0)
    assert decide(state, None, "free", "2024-02", True)[0] == state


COLUMNS = ["user_id", "plan_id", "credits", "period", "campaigns_this_month"]
EVENT = "event_id string, type string, created timestamp, data struct<user_id: long, plan: string, status: string, price_id: string>"


def bought(i, day, user, plan):
    return (i, "checkout.session.completed", day, (user, plan, None, None))


def billing_stream(spark, folder, batches):
    for batch in batches:
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").json(folder)
    return read_subscription_events(spark, folder, stream=True, files_per_trigger=1)


def test_profile_log(spark, tmp_path):
    """Late and replayed events, only changed rows written, snapshots in between, reading an older state."""
    may, june, july = datetime(2024, 5, 2), datetime(2024, 6, 2), datetime(2024, 7, 2)
    batches = [[bought("a", june, 1, "max"), bought("b", june, 2, "premium"), bought("x", june, 77, "max")], [bought("c", may, 1, "premium"), bought("a", june, 1, "max")],
               [bought("d", july, 2, "max")], [bought("b", june, 2, "premium")]]
    initial = spark.createDataFrame([(u, "free", 7, "2024-04", 1) for u in (1, 2, 3)], "user_id long, plan_id string, credits int, period string, campaigns_this_month int")
    folder = str(tmp_path / "table")
    for every in (2, 100):
        folder = str(tmp_path / f"table{every}")
        stream = billing_stream(spark, str(tmp_path / f"in{every}"), batches)
        upsert_profiles_stream(stream, folder, q.PRICES, str(tmp_path / f"cp{every}"), initial, every).awaitTermination(300)
        want = [(1, "max", 500, "2024-06", 0), (2, "max", 500, "2024-07", 0), (3, "free", 7, "2024-04", 1)]
        assert rows(current_table(spark, folder), COLUMNS) == want
        assert rows(current_table(spark, folder, 1), COLUMNS) == [want[0], (2, "premium", 100, "2024-06", 0), want[2]]
        assert snapshot_version(spark, folder) == (1 if every == 2 else -1)
        assert spark.read.parquet(f"{folder}/delta/batch=2").count() == 1
    # A snapshot without a pointer is one whose writing broke off: nobody reads it.
    initial.limit(0).withColumns({"set_at": F.lit(None).cast("timestamp"), "set_by": F.lit("")}).write.parquet(f"{folder}/snapshot/version=3")
    assert rows(current_table(spark, folder), COLUMNS) == want


def test_profile_stream_and_dedup(spark, sf, tmp_path):
    events = q.subscription_events(spark, sf)
    events.union(events).coalesce(1).write.json(str(tmp_path / "in"))
    stream = read_subscription_events(spark, str(tmp_path / "in"), stream=True)
    query = upsert_profiles_stream(stream, str(tmp_path / "profiles"), q.PRICES, str(tmp_path / "cp"), opening(spark, sf))
    query.awaitTermination(300)
    assert query.exception() is None
    want = apply_subscription_events(opening(spark, sf), events, q.PRICES)
    assert rows(current_table(spark, str(tmp_path / "profiles")), COLUMNS) == rows(want, COLUMNS)
    assert dedup_events(events.union(events)).count() == events.count()


def test_replay_memory(spark, tmp_path):
    """A replay after 90 days is dropped, a late new event is kept and reported, tiny filters change nothing, a repeated batch gives the same rows."""
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    batches = [[bought(f"a{i}", day(i % 5), 1, "max") for i in range(200)] + [bought("a1", day(1), 1, "max")], [bought("b", day(90), 1, "max"), bought("a7", day(2), 1, "max")],
               [bought("late", day(3), 1, "max"), bought("a9", day(4), 1, "max"), bought("c", day(91), 1, "max"), bought("b", day(90), 1, "max")]]
    for bits in (1 << 20, 64):
        memory = ReplayMemory(str(tmp_path / f"memory{bits}"), bits=bits)
        out = str(tmp_path / f"out{bits}")
        dedup_stream(billing_stream(spark, str(tmp_path / f"in{bits}"), batches), memory, out, str(tmp_path / f"cp{bits}")).awaitTermination(300)
        got = rows(spark.read.parquet(out), ["event_id", "batch", "late"])
        assert got == sorted([(f"a{i}", 0, False) for i in range(200)] + [("b", 1, False), ("late", 2, True), ("c", 2, False)], key=repr)
        again = memory.new_events(spark.createDataFrame(batches[1], EVENT), 1)
        assert rows(again, ["event_id"]) == [("b",)]
