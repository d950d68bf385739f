"""Profile table kept by a stream: a log of changed rows over a snapshot, merged when it is read.

Folders below the table's: ``delta/batch=N`` has the rows that micro-batch N changed, with the time and id of the event that set
them; ``snapshot/version=V`` is the whole table up to batch V; ``pointer/version=V`` is written after it and makes it valid. A reader
takes the newest snapshot that has a pointer and the deltas after it, and of each account the row of the latest event. So a
micro-batch writes as much as it changes, an older event that arrives later never wins, and replaying a batch rewrites
its own folder with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.numbers import billing_period
from adloom.operators.accounts import plan_quota
from adloom.operators.billing import to_plan_changes

COLUMNS = "user_id long, plan_id string, credits int, period string, campaigns_this_month int"
#: ``set_at`` and ``set_by`` are the time and the id of the event that set the row; null for rows that no event has set.
LOGGED = f"{COLUMNS}, set_at timestamp, set_by string"


def version_path(folder: str, version: int) -> str:
    return f"{folder}/version={version}"


def write_version(profiles: DataFrame, folder: str, version: int) -> None:
    cast = [profiles[f.split()[0]].cast(f.split()[1]).alias(f.split()[0]) for f in COLUMNS.split(", ")]
    profiles.select(*cast).write.mode("overwrite").parquet(version_path(folder, version))


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(COLUMNS).parquet(version_path(folder, version))


def write_snapshot(profiles: DataFrame, folder: str, version: int) -> None:
    """Store the whole table as of micro-batch ``version``; valid once its pointer is there. Deltas up to it are not read any more."""
    missing = {"set_at": F.lit(None).cast("timestamp"), "set_by": F.lit(None).cast("string")}
    whole = profiles.withColumns({k: v for k, v in missing.items() if k not in profiles.columns})
    cast = [F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in LOGGED.split(", ")]
    whole.select(*cast).write.mode("overwrite").parquet(f"{folder}/snapshot/version={version}")
    profiles.sparkSession.range(1).select(F.lit(version).alias("snapshot")).write.mode("overwrite").parquet(f"{folder}/pointer/version={version}")


def snapshot_version(spark: SparkSession, folder: str, before: int | None = None) -> int:
    """Newest valid snapshot (one small row per snapshot is read)."""
    pointers = spark.read.schema("snapshot int, version int").parquet(f"{folder}/pointer")
    if before is not None:
        pointers = pointers.filter(F.col("version") < before)
    return pointers.agg(F.max("version")).first()[0]


def write_delta(changed: DataFrame, folder: str, batch: int) -> None:
    cast = [F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in LOGGED.split(", ")]
    changed.select(*cast).write.mode("overwrite").parquet(f"{folder}/delta/batch={batch}")


def changed_profiles(events: DataFrame, prices: dict[str, str]) -> DataFrame:
    """The row that the latest effective event of each account in a batch of billing events sets."""
    latest = to_plan_changes(events, prices).groupBy("user_id").agg(F.max_by(F.struct("plan_id", "ts", "event_id"), F.struct("ts", "event_id")).alias("e"))
    return latest.select("user_id", "e.plan_id", plan_quota(F.col("e.plan_id")).alias("credits"), billing_period(F.col("e.ts")).alias("period"),
                         F.lit(0).alias("campaigns_this_month"), F.col("e.ts").alias("set_at"), F.col("e.event_id").alias("set_by"))


def merged(snapshot: DataFrame, deltas: DataFrame) -> DataFrame:
    """Of each known account the row of the latest event. Aggregates before the exchange, so an account that changes often sends few rows."""
    names = [f.split()[0] for f in LOGGED.split(", ")]
    both = snapshot.select(*names, F.lit(True).alias("known")).unionByName(deltas.select(*names, F.lit(False).alias("known")))
    row = F.struct(*names)
    latest = both.groupBy("user_id").agg(F.max_by(row, F.struct(F.coalesce("set_at", F.lit("0001-01-01").cast("timestamp")), F.coalesce("set_by", F.lit("")))).alias("r"), F.max("known").alias("known"))
    return latest.filter("known").select("r.*")


def current_table(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The table, or what it was after micro-batch ``upto``: user_id ... campaigns_this_month, set_at, set_by."""
    version = snapshot_version(spark, folder, None if upto is None else upto + 1)
    snapshot = spark.read.schema(LOGGED).parquet(f"{folder}/snapshot/version={version}")
    # An empty delta gives the folder, so that a table without any batch can be read.
    deltas = spark.read.schema(f"{LOGGED}, batch int").parquet(f"{folder}/delta").filter(F.col("batch") > version)
    if upto is not None:
        deltas = deltas.filter(F.col("batch") <= upto)
    return merged(snapshot, deltas)


def create_table(profiles: DataFrame, folder: str) -> None:
    write_snapshot(profiles, folder, -1)
    empty = profiles.sparkSession.createDataFrame([], LOGGED)
    write_delta(empty, folder, -1)


def compact(spark: SparkSession, folder: str, upto: int) -> None:
    """Fold the deltas up to a micro-batch into a new snapshot; readers of older versions still find theirs."""
    write_snapshot(current_table(spark, folder, upto), folder, upto)


def upsert_profiles_stream(events: DataFrame, folder: str, prices: dict[str, str], checkpoint: str, initial: DataFrame | None = None, compact_every: int = 20, **trigger):
    """Start a query that logs what billing events change in the profile table; ``initial`` creates the table.

    Every ``compact_every`` micro-batches the deltas before it become a snapshot.
    """
    if initial is not None:
        create_table(initial, folder)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compact_every == 0:
            compact(batch.sparkSession, folder, batch_id - 1)
        write_delta(changed_profiles(batch, prices), folder, batch_id)

    # Replays need no filter here: the same event sets the same row.
    return (events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
