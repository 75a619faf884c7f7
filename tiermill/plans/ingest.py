"""Landing plans: scans, lenient loads, alignment, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.functions import keys
from tiermill.plans.registry import plan
from tiermill.plans import oracle as q
from tiermill.reference import INDUSTRY_CODES, ORDER_TYPE_CODES
from tiermill.schemas import BRONZE, ORDER_FILE
from tiermill.session import shared_dir
from tiermill.sources import files, tables
from tiermill.sources.bridge import RUN_TS, Bronze
from tiermill.streaming import flows

@plan(
    "scan",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
      WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND o_orderstatus NOT IN ('P')""",
)
def scan(b: Bronze) -> DataFrame:
    """Pruned columns and pushed filters on the raw table."""
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    inside = F.col("o_orderdate").between(day("1997-01-01"), day("1997-12-31"))
    return b.table("orders").where(inside & ~F.col("o_orderstatus").isin("P")).select(
        "o_orderkey", "o_orderstatus", "o_totalprice"
    )


@plan(
    "ingest_csv",
    "SELECT order_id, order_date, customer_id, currency_code, CAST(net_amount AS DOUBLE) AS net_amount, order_status FROM bronze_orders",
)
def ingest_csv(b: Bronze) -> DataFrame:
    """Orders written as quoted CSV with several null tokens, then read back."""
    folder = shared_dir(b.spark, "orders-csv")
    text = b.orders().select(
        "order_id",
        F.col("order_date").cast("string").alias("order_date"),
        F.coalesce("customer_id", F.lit("N/A")).alias("customer_id"),
        F.coalesce("currency_code", F.lit("null")).alias("currency_code"),
        F.col("net_amount").cast("string").alias("net_amount"),
        "order_status",
    )
    text.write.option("header", True).option("quoteAll", True).csv(folder)
    return files.read_csv(b.spark, folder, ORDER_FILE).withColumn("net_amount", F.col("net_amount").cast("double"))


BAD_DATE, BAD_AMOUNT, SHORT_LINE = "CAST(order_id AS BIGINT) % 53 = 0", "CAST(order_id AS BIGINT) % 59 = 0", "CAST(order_id AS BIGINT) % 61 = 0"


@plan(
    "ingest_lenient",
    f"""SELECT order_id, CASE WHEN NOT ({SHORT_LINE} OR {BAD_DATE}) THEN order_date END AS order_date,
      CASE WHEN NOT ({SHORT_LINE}) THEN customer_id END AS customer_id,
      CASE WHEN NOT ({SHORT_LINE} OR {BAD_AMOUNT}) THEN CAST(net_amount AS DOUBLE) END AS net_amount, TRUE AS has_file_name,
      {SHORT_LINE} AS is_rejected FROM bronze_orders""",
)
def ingest_lenient(b: Bronze) -> DataFrame:
    """A damaged file: wrong dates, wrong numbers, lines cut short."""
    folder = shared_dir(b.spark, "orders-damaged")
    damaged = b.orders().select(
        F.when(F.expr(SHORT_LINE), F.concat_ws(",", "order_id", F.lit("cut")))
        .otherwise(
            F.concat_ws(
                ",",
                "order_id",
                F.when(F.expr(BAD_DATE), "not a date").otherwise(F.col("order_date").cast("string")),
                F.coalesce("customer_id", F.lit("NULL")),
                F.coalesce("currency_code", F.lit("N/A")),
                F.when(F.expr(BAD_AMOUNT), "abc").otherwise(F.col("net_amount").cast("string")),
                "order_status",
            )
        )
        .alias("value")
    )
    damaged.write.text(folder)
    loaded, bad = files.load_lenient(b.spark, folder, ORDER_FILE)
    none = F.lit(None)
    return loaded.select(
        "order_id", "order_date", "customer_id", F.col("net_amount").cast("double").alias("net_amount"),
        F.col("file_name").isNotNull().alias("has_file_name"), F.lit(False).alias("is_rejected"),
    ).unionByName(
        bad.select(
            F.get_json_object("parsed_fields", "$.order_id").alias("order_id"), none.cast("date").alias("order_date"),
            none.cast("string").alias("customer_id"), none.cast("double").alias("net_amount"),
            F.col("file_name").isNotNull().alias("has_file_name"), F.lit(True).alias("is_rejected"),
        )
    )


INDUSTRY_SQL = "CASE c_mktsegment WHEN 'MACHINERY' THEN 'MANUFACTURING' WHEN 'BUILDING' THEN 'DATA_CENTER' WHEN 'HOUSEHOLD' THEN 'COLOCATION' ELSE c_mktsegment || ' SEGMENT' END"


@plan(
    "align_recode",
    "SELECT CAST(c_custkey AS VARCHAR) AS CUSTOMER_ID, c_name AS CUSTOMER_NAME, left(CASE x "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INDUSTRY_CODES.items())
    + f" ELSE x END, 10) AS INDUSTRY_CODE FROM (SELECT *, {INDUSTRY_SQL} AS x FROM customer)",
)
def align_recode(b: Bronze) -> DataFrame:
    """A file with foreign columns and long codes fitted to the customer table."""
    incoming = b.table("customer").select(
        F.expr(INDUSTRY_SQL).alias("industry_code"), F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("customer_name"), F.col("c_nationkey").alias("not_in_target"),
    )
    target = BRONZE["sap_customers"].names + ["load_timestamp", "raw_record"]
    return files.align(incoming, target, {"industry_code": (INDUSTRY_CODES, 10)})


@plan(
    "align_cut",
    """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, 'CUSTOMER_NAME' AS column_name, c_name AS value, left(c_name, 12) AS kept
      FROM customer WHERE length(c_name) > 12""",
)
def align_cut(b: Bronze) -> DataFrame:
    """What fitting to narrower columns cuts off is reported, not lost."""
    incoming = b.table("customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_name"))
    return files.cut_values(incoming, "customer_id", BRONZE["sap_customers"].names, max_width=12)


@plan(
    "order_type_recode",
    "SELECT order_id, CASE x "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ORDER_TYPE_CODES.items())
    + " ELSE x END AS order_type FROM (SELECT order_id, CASE CAST(order_id AS BIGINT) % 4 "
    + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(ORDER_TYPE_CODES))
    + " ELSE order_type END AS x FROM bronze_orders)",
)
def order_type_recode(b: Bronze) -> DataFrame:
    """Long order types of a file replaced by the codes of the order table."""
    number = F.col("order_id").cast("bigint") % 4
    long = F.col("order_type")
    for i, name in enumerate(ORDER_TYPE_CODES):
        long = F.when(number == i, F.lit(name)).otherwise(long)
    return b.orders().select("order_id", files.recode(long, ORDER_TYPE_CODES, 200).alias("order_type"))


@plan(
    "ingest_json",
    "SELECT order_id, order_date, customer_id, currency_code, CAST(net_amount AS DOUBLE) AS net_amount, order_status FROM bronze_orders",
)
def ingest_json(b: Bronze) -> DataFrame:
    """Orders written as one object per line, then read back."""
    folder = shared_dir(b.spark, "orders-json")
    b.orders().select(ORDER_FILE.names).write.json(folder)
    read = files.read_json(b.spark, folder, ORDER_FILE, multi_line=False)
    return read.withColumn("net_amount", F.col("net_amount").cast("double"))


@plan(
    "ingest_json_array",
    "SELECT order_id, order_date, customer_id, currency_code, CAST(net_amount AS DOUBLE) AS net_amount, order_status FROM bronze_orders",
)
def ingest_json_array(b: Bronze) -> DataFrame:
    """Orders landed as files that are each one array of objects, a few hundred orders a file, then read back."""
    folder = shared_dir(b.spark, "orders-json-arrays")
    orders = b.orders().select(ORDER_FILE.names)
    part = F.pmod(F.xxhash64("order_id"), F.lit(64))
    arrays = orders.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct(*ORDER_FILE.names))).alias("value"))
    # A file of an outer array is one task, so data land as many files.
    arrays.repartition(64, "part").sortWithinPartitions("part").write.partitionBy("part").text(folder)
    read = files.read_json(b.spark, folder, ORDER_FILE, multi_line=True).drop("part")
    return read.withColumn("net_amount", F.col("net_amount").cast("double"))


@plan(
    "append_layout",
    """SELECT CAST(year(order_date) AS INT) AS order_year, count(*) AS orders, count(DISTINCT order_id) AS ids FROM bronze_orders GROUP BY 1""",
)
def append_layout(b: Bronze) -> DataFrame:
    """Two appends to a table clustered by year."""
    folder = shared_dir(b.spark, "orders-appended")
    rows = b.orders().select("order_id", "order_status", F.year("order_date").alias("order_year"))
    for half in (0, 1):
        tables.append(rows.where(F.col("order_id").cast("bigint") % 2 == half), folder, ["order_year"], ["order_id"])
    stored = b.spark.read.schema("order_id string, order_status string, order_year int").parquet(folder)
    return stored.groupBy("order_year").agg(F.count("*").alias("orders"), F.countDistinct("order_id").alias("ids"))


@plan(
    "sql_functions",
    f"""SELECT order_id, {q.hk('source_system', 'order_id')} AS order_hk, sha256(upper(trim(coalesce(customer_id, 'EMPTY')))) AS digest
      FROM bronze_orders""",
)
def sql_functions(b: Bronze) -> DataFrame:
    """The key functions as SQL users call them."""
    keys.register_sql(b.spark)
    return b.orders().selectExpr(
        "order_id", "generate_hash_key(source_system, order_id) AS order_hk", "generate_hash_diff(customer_id) AS digest"
    )


@plan(
    "bronze_stamp",
    f"""SELECT order_id, batch_id, CAST({q.RUN_TS} AS DATE) AS load_date, FALSE AS is_deleted, 'INSERT' AS change_type,
      36 AS load_id_length, order_id AS raw_order_id, currency_code AS raw_currency FROM bronze_orders""",
)
def bronze_stamp(b: Bronze) -> DataFrame:
    stamped = files.stamp(b.orders().drop("load_timestamp"), RUN_TS)
    raw = lambda name: F.try_variant_get(F.parse_json("raw_record"), f"$.{name}", "string")
    return stamped.select(
        "order_id", "batch_id", "load_date", "is_deleted", "change_type", F.length("load_id").alias("load_id_length"),
        raw("order_id").alias("raw_order_id"), raw("currency_code").alias("raw_currency"),
    )


@plan(
    "event_parse",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS DATE) AS event_date, event_type,
      CASE WHEN event_id % 97 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, event_id % 97 = 0 AS is_rejected FROM events""",
)
def event_parse(b: Bronze) -> DataFrame:
    """Event payloads, some of them written with quotes JSON does not allow."""
    spoiled = F.when(F.col("event_id") % 97 == 0, F.translate("props", '"', "'")).otherwise(F.col("props"))
    events = b.order_events(b.table("events").withColumn("props", spoiled))
    parsed = flows.parse_events(events, {"k": "int $.k"})
    return parsed.select("event_id", F.to_date("event_timestamp").alias("event_date"), "event_type", "k", "is_rejected")
