"""Small helpers the operators share."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Python class text of the white space that separates words: space and the five controls from tab to carriage return.
SPACE = "[ \\x09-\\x0D]+"


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones never clash; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; all other characters stay, whatever case they have."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def words(c: Column) -> Column:
    """Runs of anything but white space, in order; null gives none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE), "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def bit_table(hashes: DataFrame, column: str, bits: int) -> Column:
    """Literal array of longs with two bits set for every hash. Its size depends on ``bits`` only; a hash that it lacks is not among them."""
    slots = hashes.select(F.explode(F.array(*_slots(F.col(column), bits))).alias("s"))
    words = slots.select(F.floor(F.col("s") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(s % 64 as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    table = np.zeros(bits // 64, np.int64)
    for row in words.collect():  # at most bits / 64 rows
        table[row["w"]] = row["b"]
    return F.lit(table)


def _slots(h: Column, bits: int) -> list[Column]:
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))]


def may_hit(table: Column, h: Column, bits: int) -> Column:
    """Whether both bits of the hash are set."""
    at = lambda s: F.getbit(F.get(table, F.shiftright(s, 6).cast("int")), F.pmod(s, F.lit(64)).cast("int")) == 1
    one, two = _slots(h, bits)
    return at(one) & at(two)
