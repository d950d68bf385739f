"""Repeatable draws: every choice depends only on (seed, tag), never on other choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_of(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def digest(seed: Column, tag: Column | str) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.md5(F.concat(seed, F.lit("|"), tag))


def draw(md5: Column, slot: int = 0) -> Column:
    """One of the four 32-bit numbers in a digest."""
    return F.conv(F.substring(md5, 8 * slot + 1, 8), 16, 10).cast("bigint")


def int_between(number: Column, lo, hi) -> Column:
    return F.pmod(number, F.lit(hi) - F.lit(lo) + 1) + F.lit(lo)


def seeded_int(seed: Column, tag: Column | str, lo: int, hi: int) -> Column:
    return int_between(draw(digest(seed, tag)), lo, hi)


def pick(number: Column, values: Column) -> Column:
    """Element of a non-empty array by number."""
    return F.element_at(values, (F.pmod(number, F.size(values)) + 1).cast("int"))


def seeded_pick(seed: Column, tag: Column | str, values: Column) -> Column:
    return pick(draw(digest(seed, tag)), values)


def sampled(seed: Column, tag: str, values: Column, k: int) -> Column:
    """k distinct elements of a short array in shuffled order (all of them when fewer)."""
    keyed = F.transform(values, lambda v: F.struct(digest(seed, F.concat(F.lit(f"{tag}|"), v)).alias("h"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["v"])
