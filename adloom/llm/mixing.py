"""Mixing of sources to target weights by Sainte-Lague apportionment.

Sizes are words. Each source gets a target by weight, never above ``cap`` times its size; what a cap cuts off is shared
again by weight (water filling). Blocks of equal length are then allocated to the sources by highest quotients
(target / 1, / 3, / 5 ...), and each source's blocks to its shards by the same rule, which gives integer quotas. Inside a
shard the documents stand in a seeded order as one stream of words, read round and round; the shard's quota of blocks is
taken from its start, so a document is taken once, twice or in part.

Only the quotients that can decide are listed: with shares p of ``n`` parties and ``b`` blocks, a party gets between
round(p * (b - n / 2)) and round(p * (b + n / 2)) blocks, so about two quotients per party are ranked.

Defined results: null and blank texts have size 0 and take nothing; null sources are one source, last in order; null ids
sort as empty text; repeated rows are separate documents; an empty table gives an empty result. Totals of 0 give targets
of 0. Columns of the input other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import need, word_count

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
CAP = 2
BLOCK = 16
SHARD_WORDS = 1 << 20
SEED = "mix-1"


def _order(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """source, source_size, target: one row per source of (source, size). The sources themselves are ranked in one task."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    # Sources in the order in which their caps bind. Those before the first whose cap is above its share are capped.
    up = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(total)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level)
    free = F.col("limit") > F.col("level") * F.col("weight")
    water = F.first(F.when(free, F.col("level")), ignorenulls=True).over(everything)
    target = F.when(water.isNull(), F.col("limit")).otherwise(F.least("limit", water * F.col("weight")))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def apportion(parties: DataFrame, group: list[str], party: str, votes: str, blocks: Column) -> DataFrame:
    """Adds ``seats``: the group's ``blocks`` allocated to its parties by highest quotients votes / (2 k - 1); ties go to the first party."""
    whole = Window.partitionBy(*group)
    base = parties.withColumn("_n", F.count("*").over(whole)).withColumn("_all", F.sum(votes).over(whole)).withColumn("_blocks", blocks)
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0)
    edge = lambda sign: F.greatest(F.floor(share * (F.col("_blocks") + F.lit(sign * 0.5) * F.col("_n")) + 0.5), F.lit(0))
    base = base.withColumn("_low", F.greatest(edge(-1) - 1, F.lit(0)).cast("long")).withColumn("_high", (edge(1) + 1).cast("long"))
    base = base.withColumn("_left", F.col("_blocks") - F.sum("_low").over(whole))
    quotients = base.withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high")))).withColumn("_q", F.col(votes) / (2 * F.col("_k") - 1))
    place = F.row_number().over(whole.orderBy(F.desc("_q"), F.col(party).asc_nulls_last(), "_k"))
    won = quotients.withColumn("_won", F.when((place <= F.col("_left")) & (F.col("_q") > 0), 1).otherwise(0))
    kept = [c for c in parties.columns]
    return won.groupBy(*kept).agg((F.max("_low") + F.sum("_won")).cast("long").alias("seats"))


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, block: int = BLOCK,
        shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (both of its source), taken (words, repeats counted)."""
    sizes = need(docs, "doc_id", "text", "source").select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(seed).alias("at"))
    targets = source_targets(sizes, weights, total, cap)
    blocks = F.floor(F.sum("target").over(Window.partitionBy("_one")) / block + 0.5).cast("long")
    quotas = (apportion(targets.withColumn("_one", F.lit(1)), ["_one"], "source", "target", blocks)
              .withColumnRenamed("seats", "source_blocks").drop("_one")
              .withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")))
    same = sizes["source"].eqNullSafe(quotas["source"])
    shard = F.pmod(F.conv(F.substring("at", 1, 8), 16, 10).cast("long"), F.col("shards"))
    rows = sizes.join(quotas, same).drop(quotas["source"]).withColumn("shard", shard)
    shards = rows.groupBy("source", "shard", "source_blocks").agg(F.sum("size").alias("length"))
    seats = apportion(shards, ["source"], "shard", "length", F.col("source_blocks")).select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "length", "seats")
    held = rows.join(seats, rows["source"].eqNullSafe(seats["_source"]) & (rows["shard"] == seats["_shard"]))
    stream = Window.partitionBy("source", "shard").orderBy("at", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(stream), F.lit(0))
    quota = F.least(F.col("seats") * block, F.floor(F.col("length") * F.lit(float(cap))).cast("long"))
    placed = held.withColumn("start", start).withColumn("quota", quota)
    rounds = F.when(F.col("length") > 0, F.floor(F.col("quota") / F.col("length"))).otherwise(0)
    rest = F.col("quota") - rounds * F.col("length") - F.col("start")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
