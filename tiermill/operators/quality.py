"""Six-dimension data quality checks.

All row-level checks of a frame run in one aggregation: every check becomes a
``count_if`` and the wide result row is turned into one row per check. Only
duplicate keys and three-sigma limits need work of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermill.functions.dates import boundaries
from tiermill.functions.exact import percent
from tiermill.reference import DATE_FLOOR, EUROPE_CURRENCIES, VALID_CURRENCIES
from tiermill.session import stored

MIN_ROWS_FOR_SIGMA = 30


@dataclass(frozen=True)
class Check:
    """A row-level check. ``failed`` is true for a failing row; NULL passes."""

    dimension: str
    rule: str
    failed: Column
    quarantine: str = "none"  # none | failed | failed_below_99
    empty_rate: int = 100


def outcome(counted: DataFrame, by: list[str], table: str) -> DataFrame:
    """Result rows from one row per check with its total and failures."""
    total, failed, policy = F.col("_total"), F.col("_failed"), F.col("_policy")
    many = (policy == "failed") | ((policy == "failed_below_99") & ((total - failed) * 100 < total * 99))
    return counted.select(
        *by,
        F.lit(table).alias("target_table"),
        "dama_dimension",
        "rule_name",
        total.alias("records_checked"),
        (total - failed).alias("records_passed"),
        failed.alias("records_failed"),
        F.when(many, failed).otherwise(F.lit(0)).cast("bigint").alias("records_quarantined"),
        percent(total - failed, total, F.col("_empty_rate")).alias("pass_rate"),
    )


def counted(df: DataFrame, by: list[str], checks: list[Check]) -> DataFrame:
    """One row per group and row-level check with its total and failures, in one pass; these add up over batches."""
    counters = [F.count_if(c.failed).alias(f"_failed_{i}") for i, c in enumerate(checks)]
    wide = df.groupBy(*by).agg(F.count("*").alias("_total"), *counters)
    rows = ", ".join(
        f"named_struct('dama_dimension', '{c.dimension}', 'rule_name', '{c.rule}', '_policy', '{c.quarantine}', "
        f"'_empty_rate', {c.empty_rate}, '_failed', _failed_{i})"
        for i, c in enumerate(checks)
    )
    return wide.select(*by, "_total", F.expr(f"inline(array({rows}))"))


def labels(check: Check) -> dict[str, Column]:
    """The columns by which ``outcome`` knows a check that was counted on its own."""
    return {
        "dama_dimension": F.lit(check.dimension),
        "rule_name": F.lit(check.rule),
        "_policy": F.lit(check.quarantine),
        "_empty_rate": F.lit(check.empty_rate),
    }


def evaluate(df: DataFrame, by: list[str], table: str, checks: list[Check]) -> DataFrame:
    """Result rows of row-level checks, per group of ``by``, in one pass."""
    return outcome(counted(df, by, checks), by, table)


# -- the dimensions ------------------------------------------------------------


def completeness(columns: list[str]) -> list[Check]:
    return [
        Check("COMPLETENESS", f"{c.upper()}_NOT_NULL", F.col(c).isNull(), "failed_below_99", 0)
        for c in columns
    ]


def validity(run_date: date, floor: date = DATE_FLOOR) -> list[Check]:
    day = F.col("order_date")
    return [
        Check("VALIDITY", "CURRENCY_ISO4217", ~F.col("currency_code").isin(VALID_CURRENCIES), "failed"),
        Check("VALIDITY", "ORDER_DATE_RANGE", (day < F.lit(floor)) | (day > F.lit(run_date)), "failed"),
        Check("VALIDITY", "AMOUNT_NON_NEGATIVE", F.col("net_amount_usd") < 0),
    ]


def timeliness(max_lag_hours: float = 4) -> list[Check]:
    lag = boundaries("hour", F.col("order_date").cast("timestamp"), F.col("load_timestamp"))
    return [Check("TIMELINESS", "LOAD_LAG_CHECK", lag > max_lag_hours)]


def consistency() -> list[Check]:
    mismatch = (F.col("source_region") == "EUROPE") & ~F.col("currency_code").isin(EUROPE_CURRENCIES)
    return [Check("CONSISTENCY", "EUR_REGION_CURRENCY_MATCH", mismatch)]


def _with_limits(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Attach mean, spread and row count of the group to every row.

    The statistics have one row per group and are stored first: their size is
    then known, and as long as they are small the rows of a group stay where
    they are, even when one group holds a third of them.
    """
    spread = F.stddev_samp(amount)
    stats = df.groupBy(*by).agg(
        F.avg(F.col(amount).cast("double")).alias("_mu"),
        F.when(spread.isNull() | (spread == 0), F.lit(1.0)).otherwise(spread).alias("_sigma"),
        F.count("*").alias("_rows"),
    )
    if by:
        # A group may have NULL in its name, and its rows are checked like any other.
        limits = stored(stats, "sigma-limits").withColumnsRenamed({c: f"_by_{c}" for c in by})
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
        return df.join(limits, same).drop(*[f"_by_{c}" for c in by])
    single = stats.select(F.struct("_mu", "_sigma", "_rows").alias("s")).scalar()
    return df.withColumn("_s", single).select("*", "_s._mu", "_s._sigma", "_s._rows").drop("_s")


def sigma_check(amount: str) -> Check:
    value = F.col(amount).cast("double")
    far = F.abs(value - F.coalesce("_mu", F.lit(0.0))) > 3 * F.col("_sigma")
    return Check("ACCURACY", "AMOUNT_3SIGMA_OUTLIER", far)


def accuracy(
    df: DataFrame, by: list[str], table: str, amount: str = "net_amount_usd", min_rows: int = MIN_ROWS_FOR_SIGMA
) -> DataFrame:
    """Rows further than three sample deviations from the group's mean, for groups of more than ``min_rows`` rows."""
    limited = _with_limits(df.select(*by, amount), by, amount)
    return evaluate(limited, by, table, [sigma_check(amount)]).where(
        F.col("records_checked") > min_rows
    )


def not_checked(df: DataFrame, by: list[str], min_rows: int = MIN_ROWS_FOR_SIGMA) -> DataFrame:
    """Groups too small for three-sigma limits, with their rows: what ``accuracy`` gives no result for."""
    return df.groupBy(*by).agg(F.count("*").alias("records_not_checked")).where(F.col("records_not_checked") <= min_rows)


def unique_check(key: list[str]) -> Check:
    """The check that ``uniqueness`` counts: not one of single rows."""
    return Check("UNIQUENESS", f"PK_UNIQUE({'_'.join(k.upper() for k in key)})", F.lit(None), "failed")


def uniqueness(df: DataFrame, by: list[str], table: str, key: list[str]) -> DataFrame:
    """Key values used more than once; each counts as one failure."""
    per_key = df.groupBy(*by, *key).agg(F.count("*").alias("_n"))
    wide = per_key.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"),
        F.count_if(F.col("_n") > 1).alias("_failed"),
    )
    return outcome(wide.withColumns(labels(unique_check(key))), by, table)


ORDER_COLUMNS = ["order_hk", "original_id", "customer_hk", "order_date", "net_amount_usd"]
ORDER_KEY = ["order_hk", "effective_from"]


def run_all(
    orders: DataFrame,
    by: list[str],
    run_date: date,
    floor: date = DATE_FLOOR,
    table: str = "SALES_ORDER",
    key: list[str] | None = None,
    min_rows: int = MIN_ROWS_FOR_SIGMA,
) -> DataFrame:
    """All six dimensions of an order frame, per group; empty groups give no rows.

    The narrow columns are stored once; limits, row checks and keys are passes over these, not over the joins
    that made them.
    """
    amount, key = "net_amount_usd", key or ORDER_KEY
    needed = dict.fromkeys([*by, *ORDER_COLUMNS, *key, "currency_code", "load_timestamp", "source_region"])
    orders = stored(orders.select(*needed), "checked-orders")
    row_level = [*completeness(ORDER_COLUMNS), *validity(run_date, floor), *timeliness(), *consistency()]
    checked = evaluate(_with_limits(orders, by, amount), by, table, [*row_level, sigma_check(amount)])
    enough = (F.col("dama_dimension") != "ACCURACY") | (F.col("records_checked") > min_rows)
    return checked.where(enough).unionByName(uniqueness(orders, by, table, key))


def log_rows(results: DataFrame, run_timestamp: Column) -> DataFrame:
    """Results in the layout of the append-only batch log."""
    return results.withColumn("run_timestamp", run_timestamp)


def since(log: DataFrame, now: datetime, days: int, sources: list[str] | None = None) -> DataFrame:
    """Log rows of the look-back window, optionally of some sources."""
    start = F.lit(now) - F.make_dt_interval(days=F.lit(days))
    recent = log.where(F.col("run_timestamp") >= start)
    return recent.where(F.col("source_system").isin(sources)) if sources else recent
