"""Rounding that does not depend on floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, total: Column, when_empty: int | Column) -> Column:
    """``part / total * 100`` rounded half up to two decimals, from integers."""
    hundredths = F.call_function("div", part * 20000 + total, total * 2)
    empty = when_empty if isinstance(when_empty, Column) else F.lit(when_empty)
    return F.when(total == 0, empty.cast("decimal(5,2)")).otherwise(
        (hundredths.cast("decimal(12,0)") / 100).cast("decimal(5,2)")
    )


def mean_2dp(total: Column, n: Column) -> Column:
    """Mean of non-negative two-decimal values, rounded half up to two decimals."""
    hundredths = F.call_function("div", (total * 200).cast("bigint") + n, n * 2)
    return (hundredths.cast("decimal(18,0)") / 100).cast("decimal(18,2)")


def money(value: Column) -> Column:
    """Two-decimal amount for reports; rounded as a decimal, then widened."""
    return F.round(value, 2).cast("double")
