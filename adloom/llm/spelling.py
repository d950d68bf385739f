"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under their frequent form.

1. Words are counted over whole texts; every 31st occurrence by checksum loses a code point, as a typing error would.
2. Two words of lengths m <= L differ by one edit exactly if their common prefix and common suffix together reach L - 1. So one of
   the first half or the last half of the longer word is common to both: every word is put under its prefix of half
   a length and its suffix of the other half, for L = m and L = m + 1.
3. Rows of a key are tiles: words as rows of code points, padded on the right in one matrix and on the left in another. Blocks of
   rows are compared pair by pair in dense form; the first unequal column of either matrix gives the lengths of prefix and suffix.
   A pair that has the common prefix of its key is counted there, any other one under its suffix key, so none counts twice.
4. Keys of more than ``TILE`` words are dealt into blocks by a hash, and each pair of blocks is a tile of its own in some task.
5. Only sums leave a tile: the number of near words and the most frequent of them, per word, never pairs.

A word's form is its near word of largest count (ties: least in code-point order) if that is at least ten times as frequent. Counts
grow tenfold along forms, so no chain is longer than 18 steps, and five doublings reach every root.

Defined results: null texts have no words, a null id reads as empty text in the checksum. Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``
with only A-Z lower-cased, so a code point is one byte of Latin-1 whatever the length of the word. Repeated rows count repeatedly. An
empty table has no words; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import ascii_lower, need
from adloom.session import shared_dir, staged

LETTERS = "A-Za-z\\u00C0-\\u00FF"
MIN_LENGTH = 7
MIN_COUNT = 2
FREQUENT = 10
LOSES = 31
#: Words of one tile's block at most, on average.
TILE = 2048
#: Rows of a dense block; single rows for words beyond LONG code points.
BLOCK, LONG = 32, 256
#: Pairs that are compared at a time.
CELLS = 1 << 18
#: Rows that a task compares at a time.
ROWS = 1 << 17
NEAR = "word string, n_near long, less long, form string"


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """word: one row for every run of at least ``min_length`` letters, after the loss of a code point where the checksum says so."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?<![{LETTERS}])[{LETTERS}]{{{min_length},}}+"), 0)
    rows = need(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    lower = rows.select(ascii_lower(F.col("run")).alias("run"), "id").select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.char_length("run")))
    return lower.select(F.when(F.col("h") % LOSES == 0, less).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= min_length)


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: distinct words and their occurrences."""
    return occurrences(docs, min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """word, n, m, longer, side, key: under the longer length L, side 0 has the first ceil((L - 1) / 2) code points, side 1 the last floor((L + 1) / 2)."""
    half = F.floor(F.col("longer") / 2).cast("int")
    size = F.char_length("word")
    lengths = vocabulary.select("word", "n", size.alias("m"), F.explode(F.array(size, size + 1)).alias("longer"))
    sides = lengths.select("*", half.alias("half"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    tail = F.col("longer") - F.col("half")
    key = F.when(F.col("side") == 0, F.substring("word", 1, F.col("half"))).otherwise(F.substring("word", F.col("m") - tail + 1, tail))
    return sides.filter((F.col("side") == 0) | (F.col("m") >= tail)).select("word", "n", "m", "longer", "side", key.alias("key"))


def _tiles(keyed: DataFrame, tile: int) -> DataFrame:
    """Adds block, low, high: the row's block and the pair of blocks whose tile it is in."""
    at = ["side", "longer", "key"]
    heavy = keyed.groupBy(*at).count().filter(F.col("count") > tile).select(*at, F.ceil(F.col("count") / tile).cast("int").alias("blocks"))
    dealt = keyed.join(heavy, at, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("word", "n", *at, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def padded(encoded: list[bytes], width: int, right: bool) -> np.ndarray:
    """One row of code points per word; shorter words are padded with 0 behind (``right``) or before."""
    pad = (lambda w: w.ljust(width, b"\0")) if right else (lambda w: w.rjust(width, b"\0"))
    return np.frombuffer(b"".join(map(pad, encoded)), np.uint8).reshape(len(encoded), width)


def _pairs(group: np.ndarray, block: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray, half: int, side: int, crossed: np.ndarray):
    """Index pairs (i < j) of near words in the same group. All rows are keyed under one longer length, the width of the matrices.

    Words of a group have the key in common, so the columns of the key count without being looked at.
    """
    n, width = head.shape
    rows = BLOCK if width <= LONG else 1
    fill = -n % rows
    blocks = (n + fill) // rows
    lay = lambda x, empty: np.concatenate([x, np.full((fill, *x.shape[1:]), empty, x.dtype)]).reshape(blocks, rows, *x.shape[1:])
    g, b, h, t, full, c = lay(group.astype(np.int32), -1), lay(block, 0), lay(head, 0), lay(tail, 0), lay(size == width, False), lay(crossed, False)
    step = max(CELLS // (rows * rows), 1)
    one, two = (lambda v: v[:, :, None]), (lambda v: v[:, None, :])
    ordered = np.triu(np.ones((rows, rows), bool), 1)
    for apart in range(blocks):
        # Blocks that lie ``apart`` share a group if the last row of the first is in the group of the first row of the second.
        first = np.arange(blocks - apart)
        if apart:
            first = first[g[first, -1] == g[first + apart, 0]]
        if not len(first):
            break
        for at in range(0, len(first), step):
            x, y = first[at: at + step], first[at: at + step] + apart
            same = (one(g[x]) == two(g[y])) & (one(full[x]) | two(full[y]))  # a pair belongs to its longer length
            same &= one(g[x] >= 0)
            if not apart:
                same &= ordered
            if c[x].any():
                same &= ~one(c[x]) | (one(b[x]) != two(b[y]))
            common = np.zeros(same.shape, np.uint8 if width < 255 else np.int32)
            alive = same.copy()
            for k in range(half if not side else 0, width if not side else half):
                alive &= one(h[x, :, k]) == two(h[y, :, k])
                common += alive
            if side:
                same &= ~alive  # the whole prefix is common: the pair is counted under that
            alive = same.copy()
            for k in range(1, width - half + 1) if not side else range(width - half + 1, width + 1):
                alive &= one(t[x, :, width - k]) == two(t[y, :, width - k])
                common += alive
            longest = width - (half if not side else width - half) - 1
            near = same & (common >= longest)
            k, i, j = np.nonzero(near)
            if len(k):
                yield x[k] * rows + i, y[k] * rows + j


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of whole tiles, sorted by side, longer, key, low, high."""
    out = []
    for (side, width), part in rows.groupby(["side", "longer"], sort=False):
        fresh = (part[["key", "low", "high"]] != part[["key", "low", "high"]].shift()).any(axis=1).to_numpy()
        group = np.cumsum(fresh)
        repeated = np.bincount(group)[group] > 1  # single rows have nothing to meet
        part, group = part[repeated], group[repeated]
        if not len(part):
            continue
        encoded = [w.encode("latin-1") for w in part["word"]]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        head, tail = padded(encoded, int(width), True), padded(encoded, int(width), False)
        found = list(_pairs(group, part["block"].to_numpy(), head, tail, size, int(width) // 2, int(side), (part["low"] != part["high"]).to_numpy()))
        if not found:
            continue
        one, two = (np.concatenate(x) for x in zip(*found))
        me, other = np.r_[one, two], np.r_[two, one]
        counts, names = part["n"].to_numpy(), part["word"].to_numpy(object)
        links = np.bincount(me, minlength=len(part))
        # The most frequent near word first; code-point order is that of Latin-1 bytes.
        rank = np.empty(len(part), np.int64)
        rank[np.lexsort((head.view(f"S{int(width)}").ravel(), -counts))] = np.arange(len(part))
        best = np.full(len(part), len(part))
        np.minimum.at(best, me, rank[other])
        order = np.argsort(rank)
        have = np.flatnonzero(links)
        top = order[best[have]]
        out.append((names[have], links[have], -counts[top], names[top]))
    joined = lambda k, kind: np.concatenate([x[k] for x in out] or [np.empty(0)]).astype(kind)
    text = lambda k: pd.Series(joined(k, object), dtype=object)
    return pd.DataFrame({"word": text(0), "n_near": joined(1, np.int64), "less": joined(2, np.int64), "form": text(3)})


def _compared(batches):
    """Gathers rows until they hold enough whole tiles; the last tile waits for the next batch."""
    held, size = [], 0

    def tile_of(frame, i):
        return tuple(frame[["side", "longer", "key", "low", "high"]].iloc[i])
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < ROWS or tile_of(batch, -1) == tile_of(held[0], 0):
            continue
        rows = pd.concat(held, ignore_index=True)
        last = (rows[["side", "longer", "key", "low", "high"]] == list(tile_of(rows, -1))).all(axis=1).to_numpy()
        yield _compare(rows[~last])
        held, size = [rows[last]], int(last.sum())
    if size:
        yield _compare(pd.concat(held, ignore_index=True))


def near_words(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, best (less: minus the count, form) for every word that has near words."""
    at = ["side", "longer", "key", "low", "high"]
    dealt = _tiles(_keyed(vocabulary), tile).repartition(*at).sortWithinPartitions(*at)
    partial = dealt.mapInPandas(_compared, NEAR)
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, frequent: int = FREQUENT, tile: int = TILE) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    folder = shared_dir(docs.sparkSession, "spelling")
    vocabulary = staged(words(docs, min_length, min_count), folder, "words")
    known = staged(vocabulary.join(near_words(vocabulary, tile), "word", "left"), folder, "near")
    far = -F.col("best.less") >= F.col("n") * frequent
    formed = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                          F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.less")).cast("long").alias("form_n"))
    links = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for k in range(5):  # a count grows tenfold with each step, so 2 ** 5 steps are more than any chain has
        links = staged(links, folder, f"root-{k}")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = links.join(further, "root", "left")
        if joined.filter("beyond IS NOT NULL").isEmpty():
            break
        links = joined.select("word", F.coalesce("beyond", "root").alias("root"))
    return formed.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
