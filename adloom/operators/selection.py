"""Top-k, sampling and first-match selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.functions.seeded import digest

# Up to here Spark drops surplus rows on the map side (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1_000


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank", salts: int = 64) -> DataFrame:
    """First k rows per key in the given order, with their rank.

    Each map task keeps at most k rows per key before the exchange, so a key that holds most of the
    table still sends few rows. For a k above the limit that Spark prunes itself, a first pass ranks
    within random-free salts of a key.
    """
    if k > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_salt", "_r")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def sample_k(df: DataFrame, keys: list[str], item: str, seed: Column, k: int) -> DataFrame:
    """k rows per key without replacement, for any k, repeatable for the same seed; ``rank`` is the drawn order.

    The k smallest digests per key. Digests are uniform, so counts of their first twelve bits (summed on the map side) tell the
    range that holds them; only rows of that range, k and a 4,096th of the key's rows, are ranked, however hot the key is.
    """
    keyed = df.withColumn("_h", digest(seed, F.col(item).cast("string"))).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = keyed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = counts.withColumn("_before", before).filter(F.col("_before") < k).select(*[F.col(x).alias(f"_k{i}") for i, x in enumerate(keys)], F.col("_b").alias("_kb"))
    same = [keyed[x].eqNullSafe(wanted[f"_k{i}"]) for i, x in enumerate(keys)]
    # By key and bits: joined by the key alone, a hot one would go to one task whole.
    near = keyed.join(wanted, [*same, keyed["_b"] == wanted["_kb"]]).select(*df.columns, "_h")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", item)))
    return ranked.filter(F.col("rank") <= k).drop("_h")


def latest_n(df: DataFrame, owner: str, created: str, key: str, n: int = 12) -> DataFrame:
    """Newest n rows per owner."""
    return top_k_per_key(df, [owner], [F.col(created).desc(), F.col(key)], n)


def first_match(lines: Column, test) -> Column:
    """First element that satisfies the test; null when none does."""
    return F.get(F.filter(lines, test), F.lit(0))


def first_k(values: Column, k: int) -> Column:
    return F.slice(values, 1, k)


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the position at which each was first seen."""
    return df.groupBy(value).agg(F.min(order).alias("first_seen"))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First n rows overall; each task keeps n rows and only those are merged."""
    return df.orderBy(*order).limit(n)
