"""The credit ledger over a stream of spends and plan changes."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from adloom.functions.numbers import billing_period
from adloom.knowledge.subscriptions import ACTION_COSTS, CAMPAIGN_LIMIT, CREDITS
from adloom.operators import ledger
from adloom.streaming.profiles import read_version, write_version

STATE = "plan_id string, credits int, period string, campaigns int"
WAITING = "at long, event_id long, action string, plan_id string, keeps boolean, month string"
OUTPUT = ("event_id long, ts timestamp, user_id long, action string, ok boolean, reason string, credits int, "
          "campaigns_this_month int, plan_id string, period string")
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Reason of rows that came after their slice of time was decided.
TOO_LATE = "too_late"
#: Lists that the slices of an account are dealt to in turn; a timer reads one of them.
LISTS = 16
#: Rows of an account that are held before they go to the state.
HELD = 10_000
DECISION = Row(*[c.split()[0] for c in OUTPUT.split(", ")])
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


class AccountLedger(StatefulProcessor):
    """Rows wait in list state until the watermark has passed their slice of time; a timer then decides the slice in order.

    So neither the order of rows in a micro-batch nor the chunks that they come in matter, and a worker holds the rows of one
    slice (and those that share its list), not an account's whole batch. Rows of a slice that is decided already come out as
    ``too_late`` and change nothing.
    """

    def __init__(self, slice_ms: int):
        self.slice_ms = slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", STATE)
        self.waiting = [handle.getListState(f"waiting{i}", WAITING) for i in range(LISTS)]

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.account.update((initialState["plan_id"], int(initialState["credits"]), initialState["period"], int(initialState["campaigns_this_month"])))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, held, n = timerValues.getCurrentWatermarkInMs(), defaultdict(list), 0
        for e in rows:
            end = (e["at"] // 1000 // self.slice_ms + 1) * self.slice_ms
            if end <= now:
                yield _row(e["event_id"], e["at"], key[0], e["action"], False, TOO_LATE, None, None, e["plan_id"], e["month"])
                continue
            held[end].append((e["at"], e["event_id"], e["action"], e["plan_id"], e["keeps"], e["month"]))
            n += 1
            if n == HELD:
                self._wait(held)
                held, n = defaultdict(list), 0
        self._wait(held)

    def _wait(self, held: dict[int, list[tuple]]) -> None:
        for end, rows in held.items():
            self.waiting[end // self.slice_ms % LISTS].appendList(rows)
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        held = self.waiting[end // self.slice_ms % LISTS]
        due, rest = [], []
        for row in held.get():
            (due if row[0] // 1000 < end else rest).append(tuple(row))
        if rest:
            held.put(rest)
        else:
            held.clear()
        before = self.account.get()
        state = tuple(before) if before is not None else None
        first = state
        for at, event_id, action, plan_id, keeps, month in sorted(due, key=lambda r: r[:2]):
            state, decision = decide(state, action, plan_id, month, keeps)
            if decision is not None:
                yield _row(event_id, at, key[0], action, *decision)
        if state != first:
            self.account.update(state)

    def close(self) -> None:
        pass


def _row(event_id: int, at: int, *rest) -> Row:
    return DECISION(event_id, EPOCH + dt.timedelta(microseconds=at), *rest)


def decide(state, action: str, new_plan, month: str, keeps: bool = False):
    """Next state and (ok, reason, credits, campaigns, plan, period); plan changes give no decision.

    An event of a month before the state's month is refused as late and changes nothing. A plan change refills the credits
    and starts the campaign count anew, unless it ``keeps`` the count of its month.
    """
    if new_plan is not None:
        if state is None or month < state[2]:
            return state, None
        return (new_plan, CREDITS[new_plan], month, state[3] if keeps and month == state[2] else 0), None
    cost = ACTION_COSTS.get(action)
    if cost is None:
        return state, (False, "bad_action", None, None, None, None)
    if state is None:
        return None, (False, "no_profile", None, None, None, None)
    plan, credits, period, campaigns = state
    if month < period:
        return state, (False, "late", credits, campaigns, plan, period)
    if month > period:
        credits, period, campaigns = CREDITS[plan], month, 0
    reason = ""
    if action == ledger.COUNTED and campaigns >= CAMPAIGN_LIMIT[plan]:
        reason = "limit"
    elif credits < cost:
        reason = "credits"
    else:
        credits, campaigns = credits - cost, campaigns + (action == ledger.COUNTED)
    return (plan, credits, period, campaigns), (reason == "", reason, credits, campaigns, plan, period)


def credit_ledger_stream(events: DataFrame, profiles: DataFrame, delay: str = "1 day", slice_ms: int = 3_600_000) -> DataFrame:
    """Decisions with keyed state, in the order of event times.

    ``events`` has event_id, ts, user_id, action, plan_id (set for plan changes) and keeps_counter (optional). A row may come as
    much as ``delay`` after later ones; what comes later still is in the output as ``too_late`` (see ``on_time``). Needs the
    RocksDB state store (see STATE_STORE). Where single accounts dominate a stream, use ``ledger_by_batch``, which splits them.
    """
    keeps = F.coalesce("keeps_counter", F.lit(False)) if "keeps_counter" in events.columns else F.lit(False)
    # Times as plain numbers: a watermarked column would make the engine drop late rows unseen.
    rows = events.withWatermark("ts", delay).select(
        "user_id", F.unix_micros("ts").alias("at"), "event_id", "action", "plan_id", keeps.alias("keeps"), billing_period(F.col("ts")).alias("month"))
    return rows.groupBy("user_id").transformWithState(
        AccountLedger(slice_ms), OUTPUT, "Append", "EventTime", initialState=profiles.groupBy("user_id"))


def on_time(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions, and the side output of rows that came too late to be decided."""
    late = F.col("reason") == TOO_LATE
    return decisions.filter(~late), decisions.filter(late).select("event_id", "ts", "user_id", "action", "plan_id")


def ledger_by_batch(events: DataFrame, state_dir: str, out_dir: str, checkpoint: str, initial: DataFrame | None = None, **trigger):
    """Start the ledger by micro-batch: each batch is one run of the batch ledger over versioned profiles.

    Accounts are not keys of a task here, so one that sends most of a batch is split like in the batch job. Events of a month
    before the stored state's are refused as late, and also listed in the folder ``late``. Replaying a batch rewrites its own folders.
    """
    if initial is not None:
        write_version(initial, state_dir, -1)

    def run(batch: DataFrame, batch_id: int) -> None:
        profiles = read_version(batch.sparkSession, state_dir, batch_id - 1)
        spends = batch.filter("plan_id IS NULL").select("event_id", "ts", "user_id", "action")
        keeps = F.coalesce("keeps_counter", F.lit(False)) if "keeps_counter" in batch.columns else F.lit(False)
        changes = batch.filter("plan_id IS NOT NULL").select("event_id", "ts", "user_id", "plan_id", keeps.alias("keeps_counter"))
        decisions, states = ledger.run_ledger(spends, profiles, changes)
        decisions.write.mode("overwrite").parquet(f"{out_dir}/decisions/batch={batch_id}")
        ledger.late_events(spends, profiles, changes).write.mode("overwrite").parquet(f"{out_dir}/late/batch={batch_id}")
        write_version(states, state_dir, batch_id)

    return (events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
