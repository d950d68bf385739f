"""Repair of conversation structure: the cheapest edits after which roles alternate.

Rows of a conversation are read in order of their turn. A row may be kept, get another role, be deleted, or be preceded by an
inserted empty one, until the role initials read ``(s?(ua)+)?``. The edits are a path through a graph whose nodes are (row, what
may come next): nothing yet, after the system row, after a user row, after an assistant row. Every edge has one integer as its
weight. High digits of it carry the cost; the low digits, of a fixed width, carry the letter of the edit at the place that it has
in the audit, and places behind the end are zero. So the least integer is the least cost and, of equal costs, the audit that is
least in ASCII order, and an ordinary minimum over sums decides everything.

A conversation is streamed: rows whose edits all remaining paths agree on are written out and forgotten, and the digits of those
edits are cut off, so memory holds a few open rows whatever the length (where paths stay apart, as many rows as they do, still
exactly). Only the audit, which is a value of the result row, grows with the conversation. The digest of a repaired
conversation is one hash over all its rows in order; no method can split it, so one task streams each conversation. Repeats
are found before that by a window over (conversation, role, text), which sorts outside of memory.

Faults of a row, the first that holds: blank (no character but space and the five controls from tab to carriage return),
duplicate (role and text seen earlier), truncated (the last such character is none of ``.!?``).

Defined results: null conversation ids are one conversation, whose id stays null; null turns come first; null roles and texts are
one space. Rows of equal turn follow by role and text. Roles of other initials than s, u, a must be changed or deleted. A
conversation of no rows after the damage has zeros, an empty audit and the digest of the empty string. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from adloom.llm.common import need

BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Digits of the letters in ASCII order, three bits each; 0 is the padding behind the end.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = " DIKR"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: What may come next: NEW (nothing written), SYSTEM, USER, ASSISTANT (last written row).
NEW, SYSTEM, USER, ASSISTANT = range(4)
#: Node and role of a written user or assistant row, by the node before it.
NEXT = {NEW: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Open rows at which edits that all paths agree on are cut off, and places of the audit at the start.
OPEN_ROWS = 48
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "place long, edit string, role string, text string"


class Paths:
    """The cheapest path to every node behind the rows so far: an integer and the length of its audit."""

    def __init__(self):
        self.places, self.at = 2 * OPEN_ROWS + 4, {NEW: (0, 0)}

    def weight(self, cost: int, letter: str, place: int) -> int:
        return (cost << 3 * self.places) + (DIGIT[letter] << 3 * (self.places - 1 - place))

    def _step(self, into: dict, node: int, value: int, length: int, cost: int, letter: str) -> None:
        value += self.weight(cost, letter, length)
        if node not in into or value < into[node][0]:
            into[node] = (value, length + 1)

    def insert(self) -> None:
        """At most one row before each: two neighbouring inserted rows could be left out of any path."""
        found = dict(self.at)
        for node, (value, length) in self.at.items():
            self._step(found, NEXT[node], value, length, INSERT, "I")
        self.at = found

    def consume(self, initial: str, must_go: bool, cut_off: bool) -> None:
        longest = max(length for _, length in self.at.values())
        if longest + 3 > self.places:
            self._widen(2 * self.places)
        self.insert()
        found: dict = {}
        for node, (value, length) in self.at.items():
            self._step(found, node, value, length, DELETE, "D")
            if must_go:
                continue
            extra = CUT_OFF if cut_off else 0
            if initial == "s" and node == NEW:
                self._step(found, SYSTEM, value, length, KEEP + extra, "K")
            to = NEXT[node]
            same = initial == ROLE[to][0]
            self._step(found, to, value, length, (KEEP if same else REROLE) + extra, "K" if same else "R")
        self.at = found

    def _widen(self, places: int) -> None:
        more, low = 3 * (places - self.places), (1 << 3 * self.places) - 1
        self.at = {node: (((value & ~low) << more) | ((value & low) << more), length) for node, (value, length) in self.at.items()}
        self.places = places

    def audit(self, value: int, length: int) -> str:
        return "".join(LETTER[value >> 3 * (self.places - 1 - i) & 7] for i in range(length))

    def agreed(self) -> str:
        """Letters that all paths begin with; they are cut off from the digits."""
        low = (1 << 3 * self.places) - 1
        digits = [(v & low, n) for v, n in self.at.values()]
        shared = min(n for _, n in digits)
        apart = 0
        for v, _ in digits:
            apart |= v ^ digits[0][0]
        if apart:
            shared = min(shared, (3 * self.places - apart.bit_length()) // 3)
        letters = self.audit(digits[0][0], shared)
        self.at = {node: ((value & ~low) | ((value & low) << 3 * shared & low), length - shared) for node, (value, length) in self.at.items()}
        return letters

    def close(self) -> str:
        """The rest of the cheapest path that ends in a whole exchange."""
        self.insert()
        value, length = min(self.at[node] for node in (NEW, ASSISTANT) if node in self.at)
        return self.audit(value, length)


class Conversation:
    """Streams one conversation: rows in order go in, written rows and the summary come out."""

    def __init__(self, conv_id):
        self.conv_id, self.paths, self.open, self.node = conv_id, Paths(), [], NEW
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.low, self.high, self.last_turn, self.before = 0, None, None, None, None
        self.cost, self.audit, self.hash, self.place = 0, [], hashlib.sha256(), 0

    def add(self, turn, role: str, text: str, repeated: bool) -> list[tuple]:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn
            self.high = self.last_turn = turn
        initial, bare = role[:1], text.strip(BLANK)
        if self.before is not None:
            self.counts["illegal"] += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        fault = "blank" if not bare else "duplicate" if repeated else "truncated" if bare[-1] not in ENDS else ""
        if fault:
            self.counts[fault] += 1
        self.paths.consume(initial, fault in ("blank", "duplicate"), fault == "truncated")
        self.open.append((role, text, fault == "truncated"))
        return self._write(self.paths.agreed()) if len(self.open) % OPEN_ROWS == 0 else []

    def _write(self, letters: str) -> list[tuple]:
        out, used = [], 0
        for letter in letters:
            role, text, cut_off = ("", "", False) if letter == "I" else self.open[used]
            used += letter != "I"
            self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[letter] + (CUT_OFF if cut_off and letter in "KR" else 0)
            if letter != "D":
                self.node = SYSTEM if letter == "K" and role[:1] == "s" else NEXT[self.node]
                role = role if letter == "K" else ROLE[self.node]
                self.hash.update(("\n" if self.place else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                self.place += 1
            out.append((self.place - 1 if letter != "D" else None, letter, role, text))
        del self.open[:used]
        self.audit.append(letters)
        return out

    def close(self) -> list[tuple]:
        return self._write(self.paths.close())

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        c = self.counts
        return (gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.cost, "".join(self.audit), self.hash.hexdigest())


def _streamer(messages: bool, schema: pa.Schema):
    """Over batches that are sorted by conversation and order."""
    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)

    def stream(batches):
        now, rows = None, []

        def ended():
            last = now.close()
            rows.extend((now.conv_id, *m) for m in last) if messages else rows.append((now.conv_id, *now.summary()))
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "repeated", "dropped")]
            for conv_id, turn, role, text, repeated, dropped in zip(*columns):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        ended()
                    now = Conversation(conv_id)
                if not dropped:
                    written = now.add(turn, role, text, repeated)
                    if messages:
                        rows.extend((conv_id, *m) for m in written)
            if rows:
                yield flush(rows)
                rows = []
        if now is not None:
            ended()
            yield flush(rows)
    return stream


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows with faults by crc32 of ``conv_id:turn`` modulo 20. Dropped rows stay without content."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))), F.lit(20))
    rows = need(conversations, "conv_id", "turn", "role", "text").withColumn("kind", kind)
    broken = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(text("role"))
    gone = F.col("kind") == 0
    changed = rows.select("conv_id", "turn", F.when(gone, "").otherwise(role).alias("role"), F.when(gone, "").otherwise(broken).alias("text"), gone.alias("dropped"),
                          F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return changed.drop("copy")


def whole(conversations: DataFrame) -> DataFrame:
    """The rows as they are, for repair without any damage."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return need(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", text("role"), text("text"), F.lit(False).alias("dropped"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition, in order, with their repeats marked."""
    same = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.asc_nulls_first("turn"))
    marked = rows.withColumn("repeated", F.row_number().over(same) > 1)
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _applied(rows: DataFrame, columns: str, messages: bool) -> DataFrame:
    out = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {columns}"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], out).schema)
    return _ordered(rows).mapInArrow(_streamer(messages, schema), out)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, cost and audit of the cheapest edits, digest of the repaired conversation."""
    return _applied(rows, SUMMARY, False)


def repaired_messages(rows: DataFrame) -> DataFrame:
    """The edits in order: conv_id, place among the remaining rows (null where deleted), edit, role, text."""
    return _applied(rows, MESSAGES, True)


def damage_report(conversations: DataFrame) -> DataFrame:
    """What repair finds after the damage, one row per original conversation."""
    return repair(damaged(conversations))

