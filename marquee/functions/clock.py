"""Event time as numbers, the same in every session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def micros(c: Column) -> Column:
    """Microseconds of the wall clock since 1970."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, c.cast("timestamp_ntz"))
