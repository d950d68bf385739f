"""License scan by diagonal voting.

All rolling k-grams of words are hashed inside the row. Those that may be in a template (a bit table of fixed size, filled
from the templates) go on to an equality join with template positions; every hit votes for a diagonal, the offset of text
position and template position. Votes are counted per diagonal, neighbouring diagonals of a template whose spans touch are
merged (an inserted or dropped word moves the diagonal), and a merged span counts when the matched words cover enough of
the template. A base phrase is a template of its own: all its k-grams on one diagonal, verified against the words.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Everything else separates.

Defined results: null text counts as empty: no words, no labels (empty text), null positions, score 0. Repeated rows are
separate documents (grouped by their row within the scan, not by id). Very long texts stay in their row; only hits leave it.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.binding import let
from adloom.llm.common import ascii_lower, bit_table, may_hit, need

K = 2
MAX_SHIFT = 2
MIN_COVER = 0.75
#: Base phrases with their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Longer templates with labels of their own.
TEMPLATES = [
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4"),
    ("licensed under cc by 4 0", "cc-by-4"),
    ("released under the mit license", "mit-grant"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text"),
    ("all rights reserved", "all-rights-reserved"),
]
SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BITS = 1 << 16


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def template_positions(spark: SparkSession, base, templates, k: int) -> DataFrame:
    """gram, template, t_pos: every k-gram of every template. Templates are given in code, so their number is bounded."""
    rows = [(i, phrase, label, i < len(base)) for i, (phrase, label) in enumerate([*base, *templates])]
    table = spark.createDataFrame(rows, "template int, phrase string, label string, is_base boolean").withColumn("t_words", F.split("phrase", " "))
    return (table.select("template", "label", "is_base", "t_words", F.posexplode(_grams(F.col("t_words"), k)).alias("t_pos", "gram"))
            .withColumn("t_grams", F.size("t_words") - (k - 1)))


def _grams(words: Column, k: int) -> Column:
    """Hash of each run of k words."""
    if k == 2:
        return F.when(F.size(words) < 2, F.array().cast("array<bigint>")).otherwise(
            F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.xxhash64(a, b)))
    n = F.size(words) - (k - 1)
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, k))))


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, k: int = K, max_shift: int = MAX_SHIFT, min_cover: float = MIN_COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (template label, start, end, cover) per document."""
    spark = docs.sparkSession
    positions = template_positions(spark, base, templates, k)
    table = bit_table(positions, "gram", BITS)
    # Everything that needs the words is made while they are bound, so that a text is split once.
    def hits(words):
        grams = F.filter(F.transform(_grams(words, k), lambda g, i: F.struct(i.alias("pos"), g.alias("gram"))), lambda x: may_hit(table, x["gram"], BITS))
        own = F.transform(grams, lambda h: F.struct(h["pos"].alias("pos"), h["gram"].alias("gram"), F.slice(words, h["pos"] + 1, k).alias("own")))
        return F.struct(F.size(words).cast("long").alias("n_words"), own.alias("hits"))
    found = (need(docs, "doc_id", "text").select("doc_id", F.explode(F.array(let(license_words(F.col("text")), hits))).alias("f"))
             .select(F.monotonically_increasing_id().alias("row"), "doc_id", "f.n_words", "f.hits"))
    votes = (found.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("h")).select("row", "doc_id", "n_words", "h.*")
             .join(F.broadcast(positions), "gram", "left")
             .withColumn("votes_for", F.when(F.col("own") == F.slice("t_words", F.col("t_pos") + 1, k), F.col("template"))))
    lines = votes.groupBy("row", "doc_id", "n_words", "votes_for", F.when(F.col("votes_for").isNotNull(), F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.min("t_pos").alias("t_low"),
        F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("t_grams").alias("t_grams"))
    real, is_base = F.col("votes_for").isNotNull(), F.col("is_base")
    # As many rows per document as places where a template begins to match.
    per = lines.groupBy("row", "doc_id", "n_words").agg(
        F.sort_array(F.collect_list(F.when(real & is_base & (F.col("votes") == F.col("t_grams")), F.struct("diagonal", "label")))).alias("places"),
        F.sort_array(F.collect_list(F.when(real & ~is_base, F.struct(F.col("votes_for").alias("template"), "low", "diagonal", "high", "t_low", "votes", "t_grams", "label")))).alias("diagonals"))
    cover = lambda s: F.least(s["votes"] / s["t_grams"], F.lit(1.0))
    good = F.transform(F.filter(_merged(k, max_shift), lambda s: cover(s) >= min_cover), lambda s: F.struct(
        s["label"].alias("label"), s["low"].cast("long").alias("start"), (s["end"] + k).cast("long").alias("end"), cover(s).alias("cover")))
    labelled = per.withColumn("spans", good)
    place = lambda f: f(F.transform("places", lambda p: p["diagonal"])).cast("long")
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own_labels = F.transform("spans", lambda s: s["label"])
    return labelled.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), place(F.array_min).alias("first_word"), place(F.array_max).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own_labels))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))).alias("score"), "spans")


def _merged(k: int, max_shift: int) -> Column:
    """Spans of ``diagonals``: a piece joins the one before it if both text and template go on and the diagonal moves by little."""
    kind = ("array<struct<template:int,low:int,end:int,diagonal:int,high:int,t_low:int,votes:bigint,t_grams:int,label:string>>")

    def step(spans, d):
        last = F.element_at(spans, -1)
        joins = ((F.size(spans) > 0) & (last["template"] == d["template"]) & (F.abs(d["diagonal"] - last["diagonal"]) <= max_shift)
                 & (d["low"] <= last["high"] + k + max_shift) & (d["t_low"] > last["t_low"]))
        piece = lambda low, end, votes: F.struct(
            d["template"].alias("template"), low.alias("low"), end.alias("end"), d["diagonal"].alias("diagonal"), d["high"].alias("high"),
            d["t_low"].alias("t_low"), votes.alias("votes"), d["t_grams"].alias("t_grams"), d["label"].alias("label"))
        grown = F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))),
                         F.array(piece(last["low"], F.greatest(last["end"], d["high"]), last["votes"] + d["votes"])))
        return F.when(F.coalesce(joins, F.lit(False)), grown).otherwise(F.concat(spans, F.array(piece(d["low"], d["high"], d["votes"]))))
    return F.aggregate("diagonals", F.array().cast(kind), step)
