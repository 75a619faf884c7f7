"""Quality plans: the six dimensions, the log, rules and routing, dashboards."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.operators import dashboards, quality, rules, states
from tiermill.plans import oracle as q
from tiermill.plans.registry import plan
from tiermill.plans.silver import lines, orders
from tiermill.reference import DIMENSIONS, EUROPE_CURRENCIES, VALID_CURRENCIES
from tiermill.session import shared_dir, stored, stored_once
from tiermill.sources.bridge import ORDER_DATE_FLOOR, RUN_TS, Bronze

SOURCE = ["source_system", "source_region"]
BATCH = ["batch_id", *SOURCE]
NEEDED = [
    "source_batch_id", "source_system", "source_region", "order_hk", "original_id", "customer_hk", "order_date",
    "net_amount_usd", "currency_code", "effective_from", "load_timestamp",
]
RUN_DATE = RUN_TS.date()

# -- checking SQL --------------------------------------------------------------

q.RELATIONS["dq_orders"] = "SELECT *, source_batch_id AS batch_id FROM silver_orders"


def result_sql(by: str, table: str, dimension: str, rule: str, failed: str, quarantine: str, empty: int, relation: str = "dq_orders") -> str:
    quarantined = {
        "none": "0",
        "failed": "f",
        "failed_below_99": "CASE WHEN (n - f) * 100 < n * 99 THEN f ELSE 0 END",
    }[quarantine]
    return f"""SELECT {by}, '{table}' AS target_table, '{dimension}' AS dama_dimension, '{rule}' AS rule_name, n AS records_checked,
      n - f AS records_passed, f AS records_failed, CAST({quarantined} AS BIGINT) AS records_quarantined,
      {q.percent('(n - f)', 'n', empty)} AS pass_rate
      FROM (SELECT {by}, count(*) AS n, count(*) FILTER (WHERE {failed}) AS f FROM {relation} GROUP BY {by})"""


def completeness_sql(by: str) -> str:
    return " UNION ALL ".join(
        result_sql(by, "SALES_ORDER", "COMPLETENESS", f"{c.upper()}_NOT_NULL", f"{c} IS NULL", "failed_below_99", 0)
        for c in quality.ORDER_COLUMNS
    )


def validity_sql(by: str) -> str:
    args = (by, "SALES_ORDER", "VALIDITY")
    return " UNION ALL ".join(
        [
            result_sql(*args, "CURRENCY_ISO4217", f"currency_code NOT IN ({q.sql_list(VALID_CURRENCIES)})", "failed", 100),
            result_sql(*args, "ORDER_DATE_RANGE", f"order_date < DATE '{ORDER_DATE_FLOOR}' OR order_date > DATE '{RUN_DATE}'", "failed", 100),
            result_sql(*args, "AMOUNT_NON_NEGATIVE", "net_amount_usd < 0", "none", 100),
        ]
    )


def accuracy_sql(by: str) -> str:
    relation = (
        f"(SELECT *, avg(CAST(net_amount_usd AS DOUBLE)) OVER w AS mu, stddev_samp(CAST(net_amount_usd AS DOUBLE)) OVER w AS sd "
        f"FROM dq_orders WINDOW w AS (PARTITION BY {by}))"
    )
    failed = "abs(CAST(net_amount_usd AS DOUBLE) - mu) > 3 * CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END"
    return (
        "SELECT * FROM ("
        + result_sql(by, "SALES_ORDER", "ACCURACY", "AMOUNT_3SIGMA_OUTLIER", failed, "none", 100, relation)
        + ") WHERE records_checked > 30"
    )


def timeliness_sql(by: str) -> str:
    late = "date_diff('hour', CAST(order_date AS TIMESTAMP), load_timestamp) > 4"
    return result_sql(by, "SALES_ORDER", "TIMELINESS", "LOAD_LAG_CHECK", late, "none", 100)


def consistency_sql(by: str) -> str:
    wrong = f"source_region = 'EUROPE' AND currency_code NOT IN ({q.sql_list(EUROPE_CURRENCIES)})"
    return result_sql(by, "SALES_ORDER", "CONSISTENCY", "EUR_REGION_CURRENCY_MATCH", wrong, "none", 100)


def uniqueness_sql(by: str, table: str, key: list[str], relation: str) -> str:
    rule = f"PK_UNIQUE({'_'.join(k.upper() for k in key)})"
    return f"""SELECT {by}, '{table}' AS target_table, 'UNIQUENESS' AS dama_dimension, '{rule}' AS rule_name, n AS records_checked,
      n - f AS records_passed, f AS records_failed, f AS records_quarantined, {q.percent('(n - f)', 'n', 100)} AS pass_rate
      FROM (SELECT {by}, CAST(sum(c) AS BIGINT) AS n, count(*) FILTER (WHERE c > 1) AS f
        FROM (SELECT {by}, {', '.join(key)}, count(*) AS c FROM {relation} GROUP BY {by}, {', '.join(key)}) GROUP BY {by})"""


def run_all_sql(by: str) -> str:
    return " UNION ALL ".join(
        [
            completeness_sql(by), validity_sql(by), accuracy_sql(by), timeliness_sql(by), consistency_sql(by),
            uniqueness_sql(by, "SALES_ORDER", quality.ORDER_KEY, "dq_orders"),
        ]
    )


BY_SOURCE, BY_BATCH = ", ".join(SOURCE), ", ".join(BATCH)


def widened(sql: str) -> str:
    return f"SELECT * REPLACE (CAST(pass_rate AS DOUBLE) AS pass_rate) FROM ({sql})"


def report(df: DataFrame) -> DataFrame:
    return df.withColumn("pass_rate", F.col("pass_rate").cast("double"))


def checked_orders(b: Bronze) -> DataFrame:
    return orders(b).select(NEEDED).withColumnRenamed("source_batch_id", "batch_id")


# -- one plan per dimension ---------------------------------------------------------


@plan("dq_completeness", widened(completeness_sql(BY_SOURCE)))
def dq_completeness(b: Bronze) -> DataFrame:
    checks = quality.completeness(quality.ORDER_COLUMNS)
    return report(quality.evaluate(checked_orders(b), SOURCE, "SALES_ORDER", checks))


@plan(
    "dq_uniqueness",
    widened(
        uniqueness_sql("source_system", "SALES_ORDER", quality.ORDER_KEY, "dq_orders")
        + " UNION ALL "
        + uniqueness_sql("source_system", "ORDER_LINE", ["line_hk", "effective_from"], "silver_lines")
    ),
)
def dq_uniqueness(b: Bronze) -> DataFrame:
    heads = quality.uniqueness(checked_orders(b), ["source_system"], "SALES_ORDER", quality.ORDER_KEY)
    items = quality.uniqueness(lines(b), ["source_system"], "ORDER_LINE", ["line_hk", "effective_from"])
    return report(heads.unionByName(items))


@plan("dq_validity", widened(validity_sql(BY_SOURCE)))
def dq_validity(b: Bronze) -> DataFrame:
    checks = quality.validity(RUN_DATE, ORDER_DATE_FLOOR)
    return report(quality.evaluate(checked_orders(b), SOURCE, "SALES_ORDER", checks))


@plan("dq_accuracy", widened(accuracy_sql(BY_SOURCE)))
def dq_accuracy(b: Bronze) -> DataFrame:
    return report(quality.accuracy(checked_orders(b), SOURCE, "SALES_ORDER"))


@plan(
    "dq_not_checked",
    f"SELECT {BY_BATCH}, count(*) AS records_not_checked FROM dq_orders GROUP BY {BY_BATCH} HAVING count(*) <= 30",
)
def dq_not_checked(b: Bronze) -> DataFrame:
    """Groups that are too small for three-sigma limits, and so have no accuracy row."""
    return quality.not_checked(checked_orders(b), BATCH)


@plan("dq_timeliness", widened(timeliness_sql(BY_SOURCE)))
def dq_timeliness(b: Bronze) -> DataFrame:
    return report(quality.evaluate(checked_orders(b), SOURCE, "SALES_ORDER", quality.timeliness()))


@plan("dq_consistency", widened(consistency_sql(BY_SOURCE)))
def dq_consistency(b: Bronze) -> DataFrame:
    return report(quality.evaluate(checked_orders(b), SOURCE, "SALES_ORDER", quality.consistency()))


@plan("dq_run_all", widened(run_all_sql(BY_SOURCE)))
def dq_run_all(b: Bronze) -> DataFrame:
    return report(quality.run_all(checked_orders(b), SOURCE, RUN_DATE, ORDER_DATE_FLOOR))


@plan("dq_states", widened(run_all_sql(BY_SOURCE)))
def dq_states(b: Bronze) -> DataFrame:
    """All checks from the states of three batches, each read once when it came."""
    root, orders_ = shared_dir(b.spark, "dq-states"), stored(checked_orders(b), "dq-orders")
    for number in range(3):
        batch = orders_.where(F.coalesce(F.pmod(F.xxhash64("batch_id"), F.lit(3)), F.lit(0)) == number)
        states.add_batch(batch, root, number, SOURCE, RUN_DATE, ORDER_DATE_FLOOR)
    return report(states.results(b.spark, root, SOURCE))


# -- the log and what reads it ---------------------------------------------------------

q.RELATIONS["dq_log_rows"] = (
    f"SELECT *, {q.RUN_TS} - to_hours(12 * CAST(substr(batch_id, 2) AS INT)) AS run_timestamp FROM ({run_all_sql(BY_BATCH)})"
)


def log(b: Bronze) -> DataFrame:
    """Batch log: every batch of every source, batch Bn run 12·n hours ago. The run writes it once; its readers check nothing."""

    def run(path: str) -> None:
        age = F.expr("make_dt_interval(0, 12 * CAST(substring(batch_id, 2) AS INT))")
        results = quality.run_all(checked_orders(b), BATCH, RUN_DATE, ORDER_DATE_FLOOR)
        quality.log_rows(results, F.lit(RUN_TS) - age).write.parquet(path)

    return b.spark.read.parquet(stored_once(b.spark, f"dq-log:{b.folder}", run))


@plan(
    "dq_log",
    "SELECT * EXCLUDE (run_timestamp) REPLACE (CAST(pass_rate AS DOUBLE) AS pass_rate), CAST(run_timestamp AS VARCHAR) AS run_timestamp FROM dq_log_rows".replace(
        "CAST(run_timestamp AS VARCHAR)", "strftime(run_timestamp, '%Y-%m-%d %H:%M:%S')"
    ),
)
def dq_log(b: Bronze) -> DataFrame:
    return report(log(b)).withColumn("run_timestamp", F.date_format("run_timestamp", "yyyy-MM-dd HH:mm:ss"))


DAYS = 3
WINDOW_SQL = f"run_timestamp >= {q.RUN_TS} - INTERVAL {DAYS} DAY"
MEAN_SQL = q.mean_2dp("sum(pass_rate)", "count(*)")


def recent(b: Bronze) -> DataFrame:
    return quality.since(log(b), RUN_TS, DAYS, ["SAP", "JDE", "QAD"])


@plan(
    "dq_kpi",
    f"""SELECT count(DISTINCT batch_id) AS total_batches, CAST(sum(records_checked) AS BIGINT) AS total_checked,
      CAST(sum(records_failed) AS BIGINT) AS total_failed, CAST(sum(records_quarantined) AS BIGINT) AS total_quarantined,
      {MEAN_SQL} AS avg_pass_rate FROM dq_log_rows WHERE {WINDOW_SQL}""",
)
def dq_kpi(b: Bronze) -> DataFrame:
    return dashboards.kpi(recent(b))


def _pivot_sql() -> str:
    cells = ", ".join(
        q.mean_2dp(
            f"sum(pass_rate) FILTER (WHERE dama_dimension = '{d}')", f"count(*) FILTER (WHERE dama_dimension = '{d}')"
        )
        + f" AS {d.lower()}"
        for d in DIMENSIONS
    )
    return f"SELECT source_system, {cells} FROM dq_log_rows WHERE {WINDOW_SQL} GROUP BY source_system"


@plan("dq_heatmap", _pivot_sql())
def dq_heatmap(b: Bronze) -> DataFrame:
    return dashboards.heatmap(recent(b))


@plan(
    "dq_trend",
    f"""SELECT CAST(run_timestamp AS DATE) AS run_date, dama_dimension, {MEAN_SQL} AS daily_pass_rate
      FROM dq_log_rows WHERE {WINDOW_SQL} GROUP BY ALL ORDER BY run_date""",
)
def dq_trend(b: Bronze) -> DataFrame:
    return dashboards.trend(recent(b))


@plan(
    "dq_failures",
    f"""SELECT dama_dimension, CAST(sum(records_failed) AS BIGINT) AS failures FROM dq_log_rows WHERE {WINDOW_SQL}
      GROUP BY dama_dimension ORDER BY failures DESC""",
)
def dq_failures(b: Bronze) -> DataFrame:
    return dashboards.failures(recent(b))


q.RELATIONS["dq_last_day"] = f"SELECT * FROM dq_log_rows WHERE run_timestamp >= {q.RUN_TS} - INTERVAL 24 HOUR"


def _average_sql(dimension: str) -> str:
    when = f"FILTER (WHERE dama_dimension = '{dimension}')"
    return f"CAST(sum(pass_rate) {when} AS DOUBLE) / count(*) {when}"


@plan(
    "dq_dimension_avg",
    "SELECT "
    + ", ".join(f"{_average_sql(d)} AS {d.lower()}" for d in DIMENSIONS)
    + ", CAST(sum(pass_rate) AS DOUBLE) / count(*) AS overall FROM dq_last_day",
)
def dq_dimension_avg(b: Bronze) -> DataFrame:
    return dashboards.dimension_averages(log(b).where(F.col("run_timestamp") >= F.lit(RUN_TS - timedelta(hours=24))))


@plan(
    "dq_latest_score",
    """SELECT batch_id, source_system, CAST(run_timestamp AS DATE) AS run_date, CAST(sum(pass_rate) AS DOUBLE) / count(*) AS score
      FROM dq_log_rows WHERE source_system = 'SAP' GROUP BY batch_id, source_system, run_timestamp
      ORDER BY run_timestamp DESC LIMIT 1""",
)
def dq_latest_score(b: Bronze) -> DataFrame:
    return dashboards.latest_score(log(b), "SAP")


# -- declarative rules --------------------------------------------------------------------

RULES = [
    rules.Rule("CUSTOMER_PRESENT", "COMPLETENESS", "customer_id IS NOT NULL", "ERROR", "QUARANTINE", "order without a customer"),
    rules.Rule("AMOUNT_NON_NEGATIVE", "VALIDITY", "net_amount >= 0", "CRITICAL", "REJECT", "negative net amount"),
    rules.Rule("CURRENCY_KNOWN", "VALIDITY", f"currency_code IN ({q.sql_list(VALID_CURRENCIES)})", "ERROR", "REJECT", "currency code is not in the list of valid codes"),
    rules.Rule("CURRENCY_PRESENT", "COMPLETENESS", "currency_code IS NOT NULL", "ERROR", "QUARANTINE", "order without a currency"),
    rules.Rule("FX_RATE_PRESENT", "CONSISTENCY", "currency_code NOT IN ('SEK', 'DKK')", "WARNING", "FLAG", "no conversion rate, amount kept at 1"),
]

q.RELATIONS["judged_orders"] = (
    "SELECT *, CASE WHEN "
    + " OR ".join(f"NOT coalesce({r.expression}, TRUE)" for r in RULES if r.action == "REJECT")
    + " THEN 'REJECTED' WHEN "
    + " OR ".join(f"NOT coalesce({r.expression}, TRUE)" for r in RULES if r.action == "QUARANTINE")
    + " THEN 'QUARANTINED' ELSE 'PASSED' END AS route, concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT coalesce({r.expression}, TRUE) THEN '{r.name}' END" for r in RULES)
    + ") AS dq_flags FROM bronze_orders"
)
q.RELATIONS["rejected_rows"] = " UNION ALL ".join(
    f"SELECT *, '{r.name}' AS rule_violated, '{r.dimension}' AS dama_dimension, '{r.severity}' AS severity, '{r.message}' AS reason "
    f"FROM judged_orders WHERE NOT coalesce({r.expression}, TRUE)"
    for r in RULES
    if r.action == "REJECT"
)


@plan(
    "dq_rules",
    " UNION ALL ".join(
        f"SELECT source_system, '{r.name}' AS rule_name, '{r.dimension}' AS dama_dimension, '{r.severity}' AS severity, "
        f"'{r.action}' AS action_on_fail, count(*) AS records_checked, "
        f"count(*) FILTER (WHERE NOT coalesce({r.expression}, TRUE)) AS records_failed FROM bronze_orders GROUP BY source_system"
        for r in RULES
    ),
)
def dq_rules(b: Bronze) -> DataFrame:
    return rules.tally(b.orders(), ["source_system"], RULES)


@plan("dq_route", "SELECT order_id, source_system, batch_id, route, dq_flags FROM judged_orders")
def dq_route(b: Bronze) -> DataFrame:
    judged = rules.judge(b.orders(), RULES)
    return judged.select("order_id", "source_system", "batch_id", "route", F.array_join("dq_flags", ",").alias("dq_flags"))


RECORD = ["order_id", "customer_id", "currency_code", "net_amount"]


def newest_first(frame: DataFrame, at: str, limit: int, *ties: str) -> DataFrame:
    """Top rows by time; planned as a per-partition top-k, never a full sort."""
    return frame.orderBy(F.desc(at), *ties).limit(limit)


@plan(
    "rejected_recent",
    """SELECT strftime(load_timestamp, '%Y-%m-%d %H:%M') AS rejected_at, source_system, 'SALES_ORDERS' AS source_table,
      dama_dimension, severity, rule_violated, left(reason, 100) AS reason, order_id
      FROM rejected_rows ORDER BY load_timestamp DESC, order_id, rule_violated LIMIT 50""",
)
def rejected_recent(b: Bronze) -> DataFrame:
    log_ = rules.rejected(rules.judge(b.orders(), RULES), "SALES_ORDERS", RECORD)
    order_id = F.get_json_object("record_data", "$.order_id")
    top = newest_first(log_.withColumn("order_id", order_id), "load_timestamp", 50, "order_id", "rule_violated")
    return top.select(
        F.date_format("load_timestamp", "yyyy-MM-dd HH:mm").alias("rejected_at"), "source_system", "source_table",
        "dama_dimension", "severity", "rule_violated", F.left("rejection_reason", F.lit(100)).alias("reason"), "order_id",
    )


@plan(
    "quarantine_sample",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT order_id, source_system, batch_id, CAST(load_timestamp AS DATE) AS load_date, 'OPEN' AS status, "
        f"'{r.name}' AS rule_violated FROM judged_orders WHERE route = 'QUARANTINED' AND NOT coalesce({r.expression}, TRUE)"
        for r in RULES
        if r.action == "QUARANTINE"
    )
    + ") ORDER BY load_date DESC, order_id, rule_violated LIMIT 10",
)
def quarantine_sample(b: Bronze) -> DataFrame:
    waiting = rules.quarantined(rules.judge(b.orders(), RULES), "SALES_ORDERS", RECORD).select(
        F.get_json_object("record_data", "$.order_id").alias("order_id"), "source_system", "batch_id",
        F.to_date("load_timestamp").alias("load_date"), "status", "rule_violated",
    )
    return newest_first(waiting, "load_date", 10, "order_id", "rule_violated")
