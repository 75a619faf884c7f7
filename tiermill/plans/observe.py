"""Observability plans: lineage counts, run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.operators import observe, rules
from tiermill.plans.gold import fact
from tiermill.plans.quality import RULES
from tiermill.plans.registry import plan
from tiermill.plans.silver import orders
from tiermill.session import shared_dir
from tiermill.sources.bridge import RUN_TS, Bronze


@plan(
    "lineage_reconcile",
    """SELECT batch_id, source_system, coalesce(b.n, 0) AS rows_bronze, coalesce(s.clean, 0) AS rows_silver,
      coalesce(s.held, 0) AS quarantined, coalesce(f.n, 0) AS rows_gold, coalesce(b.n, 0) - coalesce(s.clean, 0) - coalesce(s.held, 0) AS lost
      FROM (SELECT DISTINCT batch_id, source_system FROM bronze_orders) k
      LEFT JOIN (SELECT batch_id AS bb, source_system AS bs, count(*) AS n FROM bronze_orders GROUP BY 1, 2) b
        ON b.bb IS NOT DISTINCT FROM k.batch_id AND b.bs = k.source_system
      LEFT JOIN (SELECT source_batch_id AS sb, source_system AS ss, count(*) FILTER (WHERE NOT is_quarantined) AS clean,
          count(*) FILTER (WHERE is_quarantined) AS held FROM silver_orders GROUP BY 1, 2) s
        ON s.sb IS NOT DISTINCT FROM k.batch_id AND s.ss = k.source_system
      LEFT JOIN (SELECT source_batch_id AS fb, source_system AS fs, count(*) AS n FROM facts GROUP BY 1, 2) f
        ON f.fb IS NOT DISTINCT FROM k.batch_id AND f.fs = k.source_system""",
)
def lineage_reconcile(b: Bronze) -> DataFrame:
    conformed = orders(b).withColumnRenamed("source_batch_id", "batch_id")
    return observe.reconcile(b.orders(), conformed, fact(b).withColumnRenamed("source_batch_id", "batch_id"))


def _digest_sql(*columns: str, where: str = "TRUE") -> str:
    text = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '?')" for c in columns)
    return f"coalesce(sum(CAST(concat('0x', substr(md5({text}), 1, 15)) AS BIGINT)) FILTER (WHERE {where}), 0)"


TRACED = ["order_id", "source_system", "net_amount", "currency_code"], ["original_id", "source_system", "net_amount_orig", "currency_code"]
PUBLISHED = ["order_hk", "order_date", "net_amount_usd"]


@plan(
    "lineage_digest",
    f"""SELECT batch_id, source_system, b.d = coalesce(s.d, 0) AS digest_matches, CAST(b.d AS VARCHAR) AS digest, coalesce(s.c, 0) = coalesce(f.d, 0) AS gold_matches
      FROM (SELECT batch_id, source_system, {_digest_sql(*TRACED[0])} AS d FROM bronze_orders GROUP BY 1, 2) b
      LEFT JOIN (SELECT source_batch_id AS sb, source_system AS ss, {_digest_sql(*TRACED[1])} AS d,
          {_digest_sql(*PUBLISHED, where="NOT is_quarantined")} AS c FROM silver_orders GROUP BY 1, 2) s
        ON s.sb IS NOT DISTINCT FROM b.batch_id AND s.ss = b.source_system
      LEFT JOIN (SELECT source_batch_id AS fb, source_system AS fs, {_digest_sql(*PUBLISHED)} AS d FROM facts GROUP BY 1, 2) f
        ON f.fb IS NOT DISTINCT FROM b.batch_id AND f.fs = b.source_system""",
)
def lineage_digest(b: Bronze) -> DataFrame:
    """Whether each batch's rows came through unchanged, by order-free digests of the layers' rows."""
    conformed = orders(b).withColumnRenamed("source_batch_id", "batch_id")
    gold = fact(b).withColumnRenamed("source_batch_id", "batch_id")
    found = observe.reconcile(b.orders(), conformed, gold, TRACED, PUBLISHED)
    return found.select("batch_id", "source_system", "digest_matches", "digest", "gold_matches")


@plan(
    "batch_run_log",
    """SELECT 'ALL' AS batch_id, 'conform orders' AS process_name, 'SILVER' AS target_layer, 'SUCCESS' AS status, count(*) AS records_read,
      count(*) FILTER (WHERE route <> 'REJECTED') AS records_loaded, count(*) FILTER (WHERE route = 'REJECTED') AS records_rejected FROM judged_orders""",
)
def batch_run_log(b: Bronze) -> DataFrame:
    judged = rules.judge(b.orders(), RULES)
    target = shared_dir(b.spark, "silver-orders")
    return observe.logged_write(judged, target, "ALL", "conform orders", RUN_TS).drop("start_time", "end_time", "duration_seconds", "error_message")


@plan(
    "lineage_log",
    """SELECT 'ALL' AS batch_id, 'BRONZE.ORDERS' AS source_table, 'SILVER.SALES_ORDERS' AS target_table, count(*) AS rows_in,
      count(*) FILTER (WHERE route <> 'REJECTED') AS rows_out, count(*) FILTER (WHERE route = 'REJECTED') AS rows_rejected FROM judged_orders""",
)
def lineage_log(b: Bronze) -> DataFrame:
    """One hop of a batch, from the counts its write observed."""
    judged = rules.judge(b.orders(), RULES)
    run = observe.logged_write(judged, shared_dir(b.spark, "silver-orders"), "ALL", "conform orders", RUN_TS).first()
    return observe.lineage_row(b.spark, "ALL", "BRONZE.ORDERS", "SILVER.SALES_ORDERS", run.asDict(), RUN_TS).drop("logged_at")
