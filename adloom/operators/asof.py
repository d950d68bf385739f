"""As-of lookup: for every probe the value that was valid at its time.

History and probes are put into one log and scanned for the last value, inside chunks of time first and then over one closing
value per chunk. So a key that holds most of the history is sorted by many tasks, and no pair of a probe and a history
row is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = {"hour": 3_600_000_000, "day": 86_400_000_000}


def time_chunk(ts: Column, chunk: str) -> Column:
    """Number of the time chunk ("1 hour", "10 days") that a time lies in; null for null."""
    number, unit = chunk.split()
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (int(number) * MICROS[unit.removesuffix("s")]))


def running_sums(df: DataFrame, keys: list[str], order: list[str], chunk: str, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums per key in the given order, whose first column is a time.

    Two levels: inside (key, time chunk), and over the totals of chunks, so no key is ordered in one task.
    """
    names = list(sums)
    cut = df.withColumns({"_chunk": time_chunk(F.col(order[0]), chunk)} | {f"_v_{n}": v for n, v in sums.items()})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    offsets = totals.select(*keys, "_chunk", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    inner = cut.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in names})
    return inner.join(offsets, [*keys, "_chunk"]).withColumns({n: F.col(f"_i_{n}") + F.col(f"_o_{n}") for n in names}).drop(
        "_chunk", *[f"_{k}_{n}" for k in "vio" for n in names])


def as_of(probes: DataFrame, history: DataFrame, key: str, at: str, since: list[str], values: list[str], chunk: str = "1 day") -> DataFrame:
    """Probes with the values of the last history row of their key at or before ``at``; null where there is none.

    ``since`` orders the history of a key: its time first, then what breaks ties. Probes of null key or time find nothing.
    """
    held = F.struct(*values)
    own = F.struct(*[F.col(c) for c in probes.columns])
    nothing = lambda c: F.lit(None).cast(history.schema[c].dataType)
    state = history.select(F.col(key).alias("_key"), F.col(since[0]).cast("timestamp").alias("_t"), F.lit(0).alias("_probe"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(since[1:])],
                           held.alias("_v"), F.lit(None).cast(probes.select(own.alias("p")).schema["p"].dataType).alias("_p"))
    asked = probes.select(F.col(key).alias("_key"), F.col(at).cast("timestamp").alias("_t"), F.lit(1).alias("_probe"), *[nothing(c).alias(f"_o{i}") for i, c in enumerate(since[1:])],
                          F.lit(None).cast(history.select(held.alias("v")).schema["v"].dataType).alias("_v"), own.alias("_p"))
    ties = [f"_o{i}" for i in range(len(since) - 1)]
    log = state.filter("_key IS NOT NULL AND _t IS NOT NULL").unionByName(asked).withColumn("_chunk", time_chunk(F.col("_t"), chunk))
    inside = Window.partitionBy("_key", "_chunk").orderBy("_t", "_probe", *ties).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    closing = log.groupBy("_key", "_chunk").agg(F.max_by("_v", F.when(F.col("_probe") == 0, F.struct("_t", *ties))).alias("_close"))
    carried = closing.select("_key", "_chunk", F.last("_close", ignorenulls=True).over(earlier).alias("_carried"))
    seen = log.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).filter("_probe = 1")
    found = seen.join(carried, seen["_key"].eqNullSafe(carried["_key"]) & seen["_chunk"].eqNullSafe(carried["_chunk"]), "left")
    known = seen["_key"].isNotNull() & seen["_t"].isNotNull()
    return found.select("_p", F.when(known, F.coalesce("_v", "_carried")).alias("_v")).select("_p.*", *[F.col(f"_v.{v}").alias(v) for v in values])
