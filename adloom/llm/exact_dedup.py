"""Exact deduplication by skew-safe combining.

1. Rows are deduplicated inside each map task (partial aggregation on digest, salt and content).
2. Groups are merged by digest, salt and content. Only the most frequent digests carry a salt, so the content of all
   other rows is shuffled once.
3. The winners of the salts are combined per digest and content.

Content takes part in every grouping key, so equal digests of different contents never merge. Rows learn their group
through the digest; a digest that has more than one content (none is known for SHA-256) goes by content instead.

Defined results: null text counts as empty; empty texts are one group. Null ids never win against others; a group of null
ids only has a null ``keep_id`` and keeps its rows. Repeated rows of the winning id are all marked kept and counted, and
``deduplicate`` leaves one of them. An empty table gives an empty result. Other columns pass through ``deduplicate`` unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import ascii_lower, need

#: So many of the most frequent digests are salted; any other digest holds less than one row in so many.
HOT_DIGESTS = 1024
SALTS = 32


def _keyed(docs: DataFrame, digest_bytes: int) -> DataFrame:
    text = ascii_lower(F.coalesce("text", F.lit("")))
    keyed = need(docs, "doc_id", "text").select("doc_id", text.alias("content"))
    return keyed.withColumn("sha", F.unhex(F.sha2("content", 256))).withColumn("digest", F.substring("sha", 1, digest_bytes))


def content_groups(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per content: digest, content, keep_id, group_size."""
    keyed = _keyed(docs, digest_bytes)
    hot = (keyed.groupBy("digest").count().filter("count > 1").orderBy(F.desc("count"), "digest").limit(HOT_DIGESTS)
           .select("digest", F.lit(True).alias("hot")))
    salted = keyed.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(-1))
    # The salt is read as an aggregate, so that the two branches below share one exchange.
    merged = salted.groupBy("digest", "salt", "content").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max("salt").alias("at"))
    columns = ["digest", "content", "keep_id", "group_size"]
    combined = merged.filter("at >= 0").groupBy("digest", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return merged.filter("at < 0").select(columns).unionByName(combined.select(columns))


def duplicate_groups(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id (largest id of the group), group_size, kept, text_sha256.

    ``digest_bytes`` shortens the grouping digest (tests force collisions with it); results never depend on it.
    """
    keyed, groups = _keyed(docs, digest_bytes), content_groups(docs, digest_bytes)
    digests = groups.groupBy("digest").agg(
        F.count("*").alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    # As many rows as SHA-256 has collisions in the input.
    clash = F.broadcast(digests.filter("contents > 1").select("digest"))
    plain = keyed.select("doc_id", "sha", "digest").join(digests.filter("contents = 1"), "digest")
    by_content = (keyed.join(clash, "digest").select("doc_id", "sha", "digest", "content")
                  .join(groups.join(clash, "digest"), ["digest", "content"]))
    columns = ["doc_id", "sha", "keep_id", "group_size"]
    found = plain.select(columns).unionByName(by_content.select(columns))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, one row each, with all their columns.

    Whole rows move once, by (id, digest), which also leaves one of repeated rows.
    """
    key = lambda i, sha: F.concat(sha, F.coalesce(i.cast("string"), F.lit("")).cast("binary"), F.when(i.isNull(), F.lit("-")).otherwise("").cast("binary"))
    kept = duplicate_groups(docs).filter("kept").select(key(F.col("doc_id"), F.unhex("text_sha256")).alias("_key")).distinct()
    own = docs.withColumn("_key", key(F.col("doc_id"), F.unhex(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))))
    return own.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)
