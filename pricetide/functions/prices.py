"""Prices from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_price(text: Column) -> Column:
    """A price in Spanish ("1.234,56 €") or plain ("1234.56") notation as double; null if there is none.
    With both signs the point separates thousands; a comma alone is the decimal sign."""
    kept = F.regexp_replace(text, r"[^\d,.\-]", "")
    plain = F.when(F.contains(kept, F.lit(",")), F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(kept)
    # two commas or points leave no number
    return F.when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))


def parse_minor_units(raw: Column, unit: int | Column = 2) -> Column:
    """A whole number of minor units ("1600" cents) as a price, for any number of digits ``unit``; null
    unless it is a whole number."""
    text, unit = F.trim(raw.cast("string")), F.lit(unit).cast("int")
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("decimal(28,0)"))
    exact = F.round(whole / F.pow(F.lit(10), unit).cast("decimal(12,0)"), 2).cast("double")
    return F.when(unit.between(0, 11), exact).otherwise(F.round(whole.cast("double") / F.pow(F.lit(10.0), unit), 2))


def drop_percent(before: Column, now: Column) -> Column:
    """How far a price fell, in percent with one digit (half up, in decimals)."""
    return F.round((before - now) / before * 100, 1)
