"""Times as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_unix(c: Column) -> Column:
    """Seconds since 1970 with fractions; null stays null."""
    return F.unix_micros(c) / 1_000_000


def from_unix(c: Column) -> Column:
    return F.timestamp_micros(F.round(c * 1_000_000).cast("long"))
