"""Rates, changes and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves towards plus infinity, in double precision."""
    return F.floor(x.cast("double") * 10**digits + 0.5) / float(10**digits)


def rate(part: Column, whole: Column) -> Column:
    """Per cent of a whole to one decimal, halves away from zero, exact decimals inside; 0 of nothing."""
    share = F.try_divide(part.cast("decimal(20,0)") * F.lit(100).cast("decimal(5,1)"), whole.cast("decimal(20,0)"))
    return F.coalesce(F.round(share, 1).cast("double"), F.lit(0.0))


def pp_change(current: Column, previous: Column) -> Column:
    """Change in percentage points, to one decimal."""
    return half_up(current - previous, 1)


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def distinct_where(value: Column, condition: Column | None = None) -> Column:
    return F.count_distinct(value if condition is None else F.when(condition, value)).cast("bigint")
