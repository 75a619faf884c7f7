"""Small text parsers used by the catalog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tags(tags: Column) -> Column:
    """Comma list to an array, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(tags, ","), lambda t: F.trim(t)), lambda t: t != "")


def leading_percent(sla: Column, default: float = 99.5) -> Column:
    """``99.50% availability`` to 99.5; text without a number gives the default."""
    found = F.regexp_extract(sla, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*%?", 1)
    return F.coalesce(F.try_to_number(found, F.lit("999999999.99")).cast("double"), F.lit(default))


def contains_any(query: str, *columns: Column) -> Column:
    """Case-blind literal search over several columns; wildcards have no meaning."""
    needle = F.lit(query.lower())
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(column), needle), F.lit(False))
    return hit
