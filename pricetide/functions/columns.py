"""Column helpers shared by the functions and operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of([F.contains(c, F.lit(w)) for w in words])


def is_true(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def first_case(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)
