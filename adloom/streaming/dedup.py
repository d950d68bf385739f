"""Replay protection for billing events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one task's filter for one day, and bits set per id.
FILTER_BITS, HASHES = 1 << 20, 3


def dedup_events(events: DataFrame, delay: str = "30 days", time: str = "created", key: str = "event_id") -> DataFrame:
    """Drop replays of an event id; a stream forgets ids older than the watermark (see ``ReplayMemory`` for one that does not)."""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


class ReplayMemory:
    """Ids of all events that were ever taken, in one bucket per day of the event, so a replay is found however late it comes.

    A replay has the time of its event, so it falls into the same day. Each micro-batch reads the Bloom filters of its days
    only: rows (day, word) of 64 bits, joined by equality. Ids that a filter lacks are new; the few others are looked
    up among the ids of their days. Both are stored per batch and day, so a repeated micro-batch rewrites its own folders and never sees them.
    """

    def __init__(self, folder: str, time: str = "created", key: str = "event_id", bits: int = FILTER_BITS):
        self.folder, self.time, self.key, self.bits = folder, time, key, bits

    def _slots(self) -> Column:
        at = lambda i: F.pmod(F.xxhash64(F.lit(i), F.col(self.key)), F.lit(self.bits))
        return F.array(*[at(i) for i in range(HASHES)])

    def _words(self, ids: DataFrame) -> DataFrame:
        """_day, word, mask: the words of the filter that an id needs, one row per word."""
        slot = ids.withColumn("_slot", F.explode(self._slots()))
        return slot.groupBy("_day", self.key, F.floor(F.col("_slot") / 64).cast("int").alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, cast(_slot % 64 as int)))").alias("mask"))

    def create(self, spark: SparkSession) -> None:
        """Empty folders, so that the first batch finds something to read."""
        spark.createDataFrame([], f"{self.key} string, batch int, _day date").write.mode("append").partitionBy("batch", "_day").parquet(f"{self.folder}/ids")
        spark.createDataFrame([], "word int, mask long, batch int, _day date").write.mode("append").partitionBy("batch", "_day").parquet(f"{self.folder}/filter")
        spark.createDataFrame([], "newest timestamp, batch int").write.mode("append").partitionBy("batch").parquet(f"{self.folder}/newest")

    def new_events(self, events: DataFrame, batch: int) -> DataFrame:
        """The events of a batch that no earlier batch had, each id once; the earliest row of an id stays."""
        spark = events.sparkSession
        order = F.struct(F.col(self.time), F.xxhash64(*[F.col(c).cast("string") if not t.startswith(("struct", "array", "map")) else F.to_json(c) for c, t in events.dtypes]))
        row = F.struct(*events.columns)
        own = events.groupBy(F.col(self.key).alias("_id")).agg(F.min_by(row, order).alias("r")).select("r.*").withColumn("_day", F.to_date(self.time))
        first, last = own.agg(F.min("_day"), F.max("_day")).first()  # partitions outside of these days are not read

        def old(name: str, schema: str) -> DataFrame:
            stored = spark.read.schema(f"{schema}, batch int, _day date").parquet(f"{self.folder}/{name}")
            return stored.filter((F.col("batch") < batch) & F.col("_day").between(F.lit(first), F.lit(last)))
        needed = self._words(own.select(self.key, "_day"))
        have = old("filter", "word int, mask long").groupBy("_day", "word").agg(F.expr("bit_or(mask)").alias("have"))
        hit = needed.join(have, ["_day", "word"], "left").withColumn("_in", F.col("mask").bitwiseAND(F.coalesce("have", F.lit(0))) == F.col("mask"))
        maybe = hit.groupBy("_day", self.key).agg(F.min("_in").alias("_in")).filter("_in").select("_day", self.key)
        seen = old("ids", f"{self.key} string").select("_day", self.key).join(maybe, ["_day", self.key], "left_semi")
        return own.join(seen, ["_day", self.key], "left_anti").drop("_day")

    def remember(self, events: DataFrame, batch: int) -> None:
        """Store the ids of the new events of a batch and the filter words of their days."""
        ids = events.select(F.col(self.key).cast("string").alias(self.key), F.to_date(self.time).alias("_day"))
        ids.repartition("_day", F.pmod(F.xxhash64(self.key), F.lit(8))).write.mode("overwrite").partitionBy("_day").parquet(f"{self.folder}/ids/batch={batch}")
        words = self._words(ids).groupBy("_day", "word").agg(F.expr("bit_or(mask)").alias("mask"))
        words.repartition("_day", F.col("word") % 8).write.mode("overwrite").partitionBy("_day").parquet(f"{self.folder}/filter/batch={batch}")


def dedup_stream(events: DataFrame, memory: ReplayMemory, out: str, checkpoint: str, late_after: str = "30 days", **trigger):
    """Start a query that writes every event once below ``out``, in folders per batch; nothing is forgotten.

    ``late`` marks new events that lie more than ``late_after`` before the newest one seen so far: they are kept and reported.
    """
    spark = events.sparkSession
    memory.create(spark)

    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = memory.new_events(batch, batch_id)
        newest = seen(batch.sparkSession).filter(F.col("batch") < batch_id).agg(F.max("newest").alias("_newest"))
        bound = F.col("_newest") - F.expr(f"INTERVAL {late_after}")
        marked = fresh.join(F.broadcast(newest)).withColumn("late", F.coalesce(F.col(memory.time) < bound, F.lit(False))).drop("_newest")  # one row
        path = f"{out}/batch={batch_id}"
        marked.write.mode("overwrite").parquet(path)
        written = batch.sparkSession.read.schema(marked.schema).parquet(path)
        memory.remember(written, batch_id)
        written.agg(F.max(memory.time).alias("newest")).write.mode("overwrite").parquet(f"{memory.folder}/newest/batch={batch_id}")

    def seen(session: SparkSession) -> DataFrame:
        """One small row per batch: its newest time."""
        return session.read.schema("newest timestamp, batch int").parquet(f"{memory.folder}/newest")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

