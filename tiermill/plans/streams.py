"""Streaming plans. Each runs its flow over landed files until nothing is left."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.functions.exact import money
from tiermill.operators import gold, silver
from tiermill.plans import oracle as q
from tiermill.plans.registry import plan
from tiermill.plans.silver import sql_stamp, stamp
from tiermill.session import shared_dir
from tiermill.sources.bridge import Bronze
from tiermill.sources.tables import VersionedTable
from tiermill.streaming import flows

# Orders that come once more, a day later and with another status.
UPDATED = "o_orderkey % 20 = 0"
UPDATED_SQL = "CAST(original_id AS BIGINT) % 20 = 0"


def landed(spark: SparkSession, parts: list[DataFrame]) -> Iterator[DataFrame]:
    """A stream over a folder, once after each landing of a part. A landing has as many files as Spark writes; a run of the flow
    takes all that are new, so the number of runs, each of which reads what is stored, is that of the landings."""
    folder = shared_dir(spark, "landing")
    for part in parts:
        part.write.mode("append").parquet(folder)
        yield flows.file_stream(spark, folder, part.schema)


def landed_orders(b: Bronze) -> Iterator[DataFrame]:
    """The raw orders in three landings: the even keys, updates of some of these and then the odd, late ones."""
    raw = b.table("orders")
    later = raw.where(UPDATED).withColumns(
        {"o_orderstatus": F.lit("U"), "o_orderdate": F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")}
    )
    return landed(b.spark, [raw.where("o_orderkey % 2 = 0"), later, raw.where("o_orderkey % 2 = 1")])


def run_orders(b: Bronze) -> tuple[VersionedTable, DataFrame]:
    """Versioned orders and the fact that follows them, in parts of up to 50,000 orders; a run of the flow after each landing."""
    b, root, facts = b.with_stored_geography(), shared_dir(b.spark, "stream-silver"), shared_dir(b.spark, "stream-fact")
    versions = VersionedTable(b.spark, root, "order_hk", 50_000, silver.order_hashes())
    conform = lambda batch: silver.orders(b.orders(orders=batch))
    derive = lambda rows: gold.fact_sales(rows, b.regions())
    checkpoint = shared_dir(b.spark, "checkpoint")
    for stream in landed_orders(b):
        flow = flows.refresh_versions(stream, conform, versions, checkpoint, every=None, derive=(derive, facts), row_by_row=True)
        flow.awaitTermination()
    return versions, b.spark.read.parquet(facts)


q.RELATIONS["versioned_orders"] = f"""
SELECT *, 1 AS record_version, NOT ({UPDATED_SQL}) AS is_current FROM silver_orders
UNION ALL
SELECT * REPLACE (effective_from + INTERVAL 1 DAY AS effective_from, order_date + 1 AS order_date,
    {q.digest("'U'", 'net_amount_orig', 'customer_id')} AS hash_diff), 2, TRUE FROM silver_orders WHERE {UPDATED_SQL}"""


@plan(
    "stream_silver",
    f"""SELECT order_hk, source_system, CAST(net_amount_usd AS DOUBLE) AS net_amount_usd, hash_diff,
      {sql_stamp('effective_from')} AS effective_from, is_current, record_version FROM versioned_orders""",
)
def stream_silver(b: Bronze) -> DataFrame:
    """Orders streamed into a versioned Silver table, some of them updated, some late; its newest version."""
    table, _ = run_orders(b)
    return table.read().select(
        "order_hk", "source_system", F.col("net_amount_usd").cast("double").alias("net_amount_usd"), "hash_diff",
        stamp("effective_from").alias("effective_from"), "is_current", "record_version",
    )


@plan(
    "stream_fact",
    f"""SELECT source_system, CAST(strftime(order_date, '%Y%m%d') AS INT) AS date_key, count(*) AS orders,
      {q.money('sum(coalesce(net_amount_usd, 0) + coalesce(tax_amount_usd, 0))')} AS billed
      FROM versioned_orders WHERE is_current AND NOT is_quarantined GROUP BY ALL""",
)
def stream_fact(b: Bronze) -> DataFrame:
    """The fact that follows the versions: an updated order is one fact, with its newest values."""
    _, facts = run_orders(b)
    return facts.groupBy("source_system", "date_key").agg(
        F.count("*").alias("orders"), money(F.sum("total_amount_usd")).alias("billed")
    )


@plan(
    "event_counts",
    """SELECT CAST(d AS DATE) AS event_date, event_type, count(*) AS n_events
      FROM (SELECT DISTINCT event_id, event_type, CASE WHEN event_id % 50 <> 7 THEN date_trunc('day', ts) END AS d FROM events)
      GROUP BY ALL""",
)
def event_counts(b: Bronze) -> DataFrame:
    """Daily counts of all days, from landings out of time order, one of which comes twice; some rows have no timestamp."""
    raw = b.table("events")
    raw = raw.withColumn("ts", F.when(F.col("event_id") % 50 != 7, F.col("ts")))
    root, checkpoint = shared_dir(b.spark, "event-counts"), shared_dir(b.spark, "checkpoint")
    for stream in landed(b.spark, [raw.where(f"event_id % 3 = {part}") for part in (1, 0, 1, 2)]):
        flows.refresh_daily_counts(b.order_events(stream), root, checkpoint, every=None).awaitTermination()
    return flows.read_daily_counts(b.spark, root).select("event_date", "event_type", "n_events")
