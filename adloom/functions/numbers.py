"""Money, rounding, percent and date projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price used when the text holds none.
FALLBACK_PRICE = 39.95


def half_up(x: Column) -> Column:
    """Round half towards plus infinity, as browsers do."""
    return F.floor(x + 0.5)


def fixed2(x: Column) -> Column:
    """Two decimals from the exact binary value; only exact ties (odd eighths) go up."""
    tie = x * 8 == F.floor(x * 8)
    as_text = lambda v: F.call_function("format_number", v, F.lit("0.00"))
    return F.when(tie, as_text(F.floor(x * 100 + 0.5) / 100)).otherwise(as_text(x))


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), fixed2(x))


def parse_money(text: Column) -> Column:
    """First number left once all but digits and dots is removed; zero or none gives the fallback."""
    digits = F.regexp_replace(text, "[^0-9.]", "")
    value = F.regexp_extract(digits, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(FALLBACK_PRICE))


def clamp(x: Column, lo, hi) -> Column:
    """Value limited to lo..hi; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def clamp_pct(x: Column, top: Column) -> Column:
    return clamp(x / top * 100, 0.0, 100.0)


def score_band(x: Column) -> Column:
    return F.when(x >= 80, "green").when(x >= 60, "amber").otherwise("red")


def priority_tone(value: Column) -> Column:
    return F.when(value == "Alta", "bad").when(value == "Media", "warn").otherwise("default")


def impact_tone(value: Column) -> Column:
    return F.when(value == "Positivo", "ok").when(value == "Negativo", "bad").otherwise("default")


def billing_period(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "d/M/yyyy")
