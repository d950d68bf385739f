"""Bind a value once so that an expression may use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; plain repetition would compute it at every mention.

    The value is the start of a fold over nothing: unlike a transformed array of one, that copies neither the value nor the result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, lambda held: use(held))
