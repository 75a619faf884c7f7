"""Declarative row rules: check, explain, and route rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A boolean SQL expression that must hold; NULL counts as holding."""

    name: str
    dimension: str
    expression: str
    severity: str = "ERROR"
    action: str = "REJECT"  # REJECT | QUARANTINE | FLAG
    message: str = ""
    active: bool = True


def violations(rules: Iterable[Rule]) -> Column:
    """Array of the rules a row breaks."""
    broken = [
        F.when(
            ~F.coalesce(F.expr(rule.expression), F.lit(True)),
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(rule.dimension).alias("dimension"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.action).alias("action"),
                F.lit(rule.message).alias("message"),
            ),
        )
        for rule in rules
        if rule.active
    ]
    return F.array_compact(F.array(*broken))


def judge(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Add ``violations``, ``dq_flags`` and ``route`` to every row."""
    has = lambda action: F.exists("violations", lambda v: v["action"] == action)
    return df.withColumn("violations", violations(rules)).withColumns(
        {
            "dq_flags": F.transform("violations", lambda v: v["rule"]),
            "route": F.when(has("REJECT"), "REJECTED").when(has("QUARANTINE"), "QUARANTINED").otherwise("PASSED"),
        }
    )


def passed(judged: DataFrame) -> DataFrame:
    """Rows that stay in the flow; quarantined ones stay, marked."""
    return (
        judged.where(F.col("route") != "REJECTED")
        .withColumn("is_quarantined", F.col("route") == "QUARANTINED")
        .drop("violations", "route")
    )


def _details(judged: DataFrame, action: str, table: str, record: list[str]) -> DataFrame:
    broken = F.filter("violations", lambda v: v["action"] == action)
    return judged.withColumn("record_data", F.to_json(F.struct(*record))).select(
        "batch_id", "source_system", F.lit(table).alias("source_table"), "record_data", "load_timestamp",
        F.inline(broken),
    )


def rejected(judged: DataFrame, table: str, record: list[str]) -> DataFrame:
    """Log rows for rejections, one per broken rule, with the row as JSON."""
    return _details(judged.where(F.col("route") == "REJECTED"), "REJECT", table, record).select(
        "batch_id", "source_system", "source_table", "record_data",
        F.col("rule").alias("rule_violated"), F.col("dimension").alias("dama_dimension"), "severity",
        F.col("message").alias("rejection_reason"), "load_timestamp",
    )


def quarantined(judged: DataFrame, table: str, record: list[str]) -> DataFrame:
    """Log rows awaiting review, one per broken rule."""
    return _details(judged.where(F.col("route") == "QUARANTINED"), "QUARANTINE", table, record).select(
        "batch_id", "source_system", "source_table", "record_data", F.col("rule").alias("rule_violated"),
        F.col("message").alias("quarantine_reason"), F.lit("OPEN").alias("status"), "load_timestamp",
    )


def tally(df: DataFrame, by: list[str], rules: Iterable[Rule]) -> DataFrame:
    """Broken-row counts of every rule per group, in one pass."""
    active = [r for r in rules if r.active]
    counts = [
        F.count_if(~F.coalesce(F.expr(r.expression), F.lit(True))).alias(f"_{i}") for i, r in enumerate(active)
    ]
    wide = df.groupBy(*by).agg(F.count("*").alias("records_checked"), *counts)
    rows = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("rule_name"), F.lit(r.dimension).alias("dama_dimension"),
                F.lit(r.severity).alias("severity"), F.lit(r.action).alias("action_on_fail"),
                F.col(f"_{i}").alias("records_failed"),
            )
            for i, r in enumerate(active)
        ]
    )
    return wide.select(*by, "records_checked", F.inline(rows))
