"""Source-to-target mapping driven by configuration rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One target column: an expression over source columns, cast to a type."""

    stt_id: int
    source_column: str
    target_column: str
    transformation: str | None = None
    data_type: str | None = None
    active: bool = True


def apply(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Target frame of the active rules, in rule order."""
    columns = []
    for rule in sorted((r for r in rules if r.active), key=lambda r: r.stt_id):
        value = F.expr(rule.transformation) if rule.transformation else F.col(rule.source_column)
        columns.append((value.cast(rule.data_type) if rule.data_type else value).alias(rule.target_column))
    return df.select(*columns)


def rules_from(config: DataFrame, source: str, table: str) -> list[Rule]:
    """Read the rules of one source table; configuration, never data."""
    wanted = config.where((F.col("source_system") == source) & (F.col("source_table") == table) & F.col("is_active"))
    fields = ("stt_id", "source_column", "target_column", "transformation", "data_type")
    return [Rule(*[row[f] for f in fields]) for row in wanted.select(*fields).collect()]
