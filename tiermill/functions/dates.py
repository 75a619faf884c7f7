"""Date helpers whose results differ from the obvious built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECONDS = {"hour": 3600, "minute": 60}


def boundaries(unit: str, start: Column, end: Column) -> Column:
    """Number of hour or minute boundaries between two timestamps.

    ``timestampdiff`` counts whole elapsed units (10:59 to 11:01 is zero
    hours); service checks count boundaries crossed (one hour).
    """
    tick = lambda c: F.unix_timestamp(F.date_trunc(unit, c))
    return ((tick(end) - tick(start)) / _SECONDS[unit]).cast("bigint")


def date_key(day: Column) -> Column:
    """``yyyymmdd`` as an integer, by arithmetic so it stays in codegen."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.day(day)


def days_before(day: Column, as_of: Column) -> Column:
    return F.datediff(as_of, day)
