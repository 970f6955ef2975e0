"""Half-open intervals kept as two timestamp columns; a NULL end is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval_valid(start: Column, end: Column) -> Column:
    """A start is required; a zero-length interval is legal."""
    return F.coalesce(start.isNotNull() & (end.isNull() | (end >= start)), F.lit(False))


def contains(start: Column, end: Column, instant: Column) -> Column:
    return F.coalesce((start <= instant) & (end.isNull() | (end > instant)), F.lit(False))


def is_open(end: Column) -> Column:
    return end.isNull()


def close_at(start: Column, end: Column, instant: Column) -> Column:
    """New end of an interval closed at ``instant``; NULL where that is not allowed."""
    return F.when(instant >= start, instant)
