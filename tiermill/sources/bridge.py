"""Driver tables reshaped to the landing (Bronze) schemas.

``FIXTURES.md`` fixes the rules. Short CASE expressions are shared with the
oracle as SQL text so both sides read the same definition.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tiermill.reference import SOURCE_REGION
from tiermill.session import stored

RUN_TS = datetime(2001, 8, 2)
AS_OF = date(2000, 1, 1)
AS_OF_LIST = [date(1999, 12, 30), date(1999, 12, 31), date(2000, 1, 1)]
ORDER_DATE_FLOOR = date(1996, 1, 1)
CUSTOMER_LOADS = [datetime(2000, 1, 1), datetime(2000, 1, 2), datetime(2000, 1, 3)]

SOURCE_SQL = "CASE r_name WHEN 'EUROPE' THEN 'SAP' WHEN 'AMERICA' THEN 'JDE' ELSE 'QAD' END"
REGION_SQL = "CASE r_name WHEN 'EUROPE' THEN 'EUROPE' WHEN 'AMERICA' THEN 'AMERICAS' ELSE 'EMEA' END"
CURRENCY_SQL = (
    "CASE WHEN o_orderkey % 89 = 0 THEN 'XXX' WHEN o_orderkey % 83 = 0 THEN NULL "
    "WHEN o_orderkey % 71 = 0 THEN 'USD' "
    "WHEN r_name = 'EUROPE' THEN CASE n_nationkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'SEK' END "
    "WHEN r_name = 'AMERICA' THEN CASE n_nationkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'CAD' ELSE 'BRL' END "
    "ELSE CASE n_nationkey % 3 WHEN 0 THEN 'AED' WHEN 1 THEN 'ZAR' ELSE 'INR' END END"
)
CUSTOMER_ID_SQL = "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END"
NET_SQL = (
    "CAST(CAST(o_totalprice AS DECIMAL(18,4)) * "
    "CASE WHEN o_orderkey % 79 = 0 THEN -1 WHEN o_orderkey % 101 = 0 THEN 20 ELSE 1 END AS DECIMAL(18,4))"
)
# Rows that ordinary data has: customers without a name, batches without a number, items without a family or a header.
NAME_SQL = "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END"
BATCH_SQL = "CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE 'B' || CAST(o_orderkey % 10 AS STRING) END"
FAMILY_SQL = "CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE p_type END"
ITEM_ORDER_SQL = "CASE WHEN l_orderkey % 67 = 0 THEN 'X' ELSE '' END || CAST(l_orderkey AS STRING)"
CITY_SQL = "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'CITY ' || CAST(c_custkey % 50 AS STRING) END"
POSTAL_SQL = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'P' || CAST(10000 + c_custkey % 900 AS STRING) END"
PHONE_SQL = "'+1-555-' || CAST(1000000 + c_custkey AS STRING)"
EMAIL_SQL = "c_name || '@example.com'"
CREDIT_SQL = "CAST(c_acctbal AS DECIMAL(18,2))"
ANNUAL_REVENUE_SQL = "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_acctbal * 200 AS DECIMAL(18,2)) END"
REQUEST_STATUS_SQL = (
    "CASE event_type WHEN 'purchase' THEN 'APPROVED' WHEN 'error' THEN 'REJECTED' ELSE 'PENDING' END"
)
STAGE_SQL = (
    "CASE event_type WHEN 'purchase' THEN 'CLOSED_WON' WHEN 'error' THEN 'CLOSED_LOST' "
    "WHEN 'click' THEN 'NEGOTIATION' ELSE 'PROSPECTING' END"
)


class Bronze:
    """Landing tables over one driver folder. Every method is lazy.

    A table's schema is read once for each instance: naming it spares a footer-reading job each time the table is opened.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._schemas: dict[str, StructType] = {}
        self._places: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if path not in self._schemas:
            self._schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[path]).parquet(path)

    def with_stored_geography(self) -> Bronze:
        """The same tables, the few rows of their nations written first: Spark knows their size then and moves no large side."""
        found = Bronze(self.spark, self.folder)
        found._schemas, found._places = self._schemas, stored(self._geography(), "geography")
        return found

    def _geography(self) -> DataFrame:
        if self._places is not None:
            return self._places
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", "n_name", "r_name"
        )

    # -- orders ---------------------------------------------------------

    def orders(self, before: date | None = None, orders: DataFrame | None = None) -> DataFrame:
        """Order headers of every source in one scan.

        ``before`` repeats the point-in-time bound on the raw timestamp, so
        that it reaches the Parquet scan; ``orders`` replaces the scan, e.g.
        by a micro-batch.
        """
        raw = self.table("orders") if orders is None else orders
        if before is not None:
            raw = raw.where(F.col("o_orderdate") < F.lit(before.isoformat()).cast("timestamp_ntz"))
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        placed = raw.join(customer, raw.o_custkey == customer.c_custkey).join(
            self._geography(), F.col("c_nationkey") == F.col("n_nationkey")
        )
        net = F.expr(NET_SQL)
        ordered_at = F.col("o_orderdate").cast("timestamp")
        loaded_at = ordered_at + F.expr("make_dt_interval(0, CAST(o_orderkey % 8 AS INT))")
        return placed.select(
            F.expr(SOURCE_SQL).alias("source_system"),
            F.expr(REGION_SQL).alias("source_region"),
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("o_orderpriority").alias("order_type"),
            F.to_date(ordered_at).alias("order_date"),
            F.lit(None).cast("date").alias("delivery_date"),
            F.expr(CUSTOMER_ID_SQL).alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.expr(CURRENCY_SQL).alias("currency_code"),
            net.alias("net_amount"),
            F.when(F.col("r_name") == "EUROPE", (net * F.lit("0.08").cast("decimal(3,2)")))
            .cast("decimal(18,4)")
            .alias("tax_amount"),
            F.lit(None).cast("decimal(5,2)").alias("discount_pct"),
            F.col("n_name").alias("country_code"),
            loaded_at.alias("load_timestamp"),
            F.expr(BATCH_SQL).alias("batch_id"),
        )

    def sap_orders(self) -> DataFrame:
        return self.orders().where("source_system = 'SAP'").drop("source_system", "source_region")

    def jde_order_lines(self) -> DataFrame:
        """Line-level feed: each header's amount split a quarter / the rest."""
        head = self.orders().where("source_system = 'JDE'")
        quarter = (F.col("net_amount") * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(18,4)")
        return head.withColumn("line_number", F.explode(F.array(F.lit(1), F.lit(2)))).select(
            "order_id",
            "line_number",
            "order_type",
            "order_date",
            "customer_id",
            F.col("order_status").alias("status_code"),
            F.when(F.col("line_number") == 1, quarter)
            .otherwise(F.col("net_amount") - quarter)
            .cast("decimal(18,4)")
            .alias("extended_price"),
            "currency_code",
            "country_code",
            "load_timestamp",
            "batch_id",
        )

    def qad_orders(self) -> DataFrame:
        return (
            self.orders()
            .where("source_system = 'QAD'")
            .withColumnRenamed("net_amount", "total_amount")
            .drop("source_system", "source_region", "tax_amount", "delivery_date")
        )

    def order_items(self) -> DataFrame:
        """Order lines with the product's family; header fields come by join."""
        line, part = self.table("lineitem"), self.table("part").select("p_partkey", F.expr(FAMILY_SQL).alias("p_type"))
        gross = F.col("l_extendedprice").cast("decimal(18,4)")
        kept = F.lit(1).cast("decimal(5,2)") - F.col("l_discount").cast("decimal(5,2)")
        return line.join(part, line.l_partkey == part.p_partkey, "left").select(
            F.expr(ITEM_ORDER_SQL).alias("order_id"),
            F.col("l_linenumber").alias("line_item"),
            F.col("l_partkey").cast("string").alias("product_code"),
            F.col("p_type").alias("product_family"),
            F.col("l_quantity").cast("decimal(15,3)").alias("quantity"),
            gross.alias("unit_price"),
            (gross * kept).cast("decimal(18,4)").alias("line_amount"),
            (F.col("l_discount") * 100).cast("decimal(5,2)").alias("discount_pct"),
            F.col("l_linestatus").alias("item_status"),
        )

    # -- customers ------------------------------------------------------

    def customers(self) -> DataFrame:
        """Customer masters of the three order systems in one scan."""
        customer = self.table("customer")
        return customer.join(
            self._geography(), customer.c_nationkey == F.col("n_nationkey")
        ).select(
            F.expr(SOURCE_SQL).alias("source_system"),
            F.expr(REGION_SQL).alias("source_region"),
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.expr(NAME_SQL).alias("customer_name"),
            F.expr(CITY_SQL).alias("city"),
            F.expr(POSTAL_SQL).alias("postal_code"),
            F.col("n_name").alias("country_code"),
            F.expr(PHONE_SQL).alias("phone"),
            F.expr(EMAIL_SQL).alias("email"),
            F.expr(CREDIT_SQL).alias("credit_limit"),
            F.lit("NET30").alias("payment_terms"),
            F.col("c_mktsegment").alias("industry_code"),
            F.lit(CUSTOMER_LOADS[0]).alias("load_timestamp"),
            F.concat(F.lit("B"), (F.col("c_custkey") % 10).cast("string")).alias("batch_id"),
        )

    def customer_load(self, load: int) -> DataFrame:
        """One of three successive full loads, differing in the city."""
        moved = {1: F.lit(False), 2: F.col("customer_id") % 5 == 0, 3: F.col("customer_id") % 5 == 0}[load]
        again = F.col("customer_id") % 15 == 0 if load == 3 else F.lit(False)
        return (
            self.customers()
            .withColumn(
                "city",
                F.when(again, F.lit("THIRD CITY")).when(moved, F.lit("SECOND CITY")).otherwise(F.col("city")),
            )
            .withColumn("load_timestamp", F.lit(CUSTOMER_LOADS[load - 1]))
            .withColumn("batch_id", F.lit(f"LOAD-{load}"))
        )

    def accounts(self) -> DataFrame:
        """CRM accounts: every customer once more, with yearly revenue."""
        customer = self.table("customer")
        return customer.join(
            self._geography(), customer.c_nationkey == F.col("n_nationkey")
        ).select(
            F.concat(F.lit("ACC-"), F.col("c_custkey").cast("string")).alias("account_id"),
            F.expr(NAME_SQL).alias("account_name"),
            F.col("c_mktsegment").alias("industry"),
            F.expr(ANNUAL_REVENUE_SQL).alias("annual_revenue"),
            F.col("n_name").alias("billing_country"),
            F.expr(REGION_SQL).alias("region"),
            F.lit(CUSTOMER_LOADS[0]).alias("load_timestamp"),
        )

    def opportunities(self) -> DataFrame:
        """CRM deals, one per event of an account."""
        day = F.to_date(F.col("ts").cast("timestamp"))
        return self.table("events").select(
            F.concat(F.lit("OPP-"), F.col("event_id").cast("string")).alias("opp_id"),
            F.concat(F.lit("Deal "), F.col("event_id").cast("string")).alias("opp_name"),
            F.concat(F.lit("ACC-"), F.col("user_id").cast("string")).alias("account_id"),
            F.expr(STAGE_SQL).alias("stage_name"),
            F.col("value").cast("decimal(18,2)").alias("amount"),
            F.when(F.col("event_type") == "purchase", 100).when(F.col("event_type") == "error", 0)
            .otherwise(40).cast("decimal(5,2)").alias("probability"),
            F.date_add(day, 30).alias("close_date"),
            (F.col("event_type") == "purchase").alias("is_won"),
            F.col("event_type").isin("purchase", "error").alias("is_closed"),
            F.lit("GLOBAL").alias("region"),
            F.col("ts").cast("timestamp").alias("load_timestamp"),
        )

    # -- products, geography, events, texts --------------------------------

    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("product_code"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("product_family"),
            F.col("p_brand").alias("product_line"),
            F.lit("EA").alias("unit_of_measure"),
            F.col("p_retailprice").cast("decimal(18,4)").alias("list_price"),
        )

    def regions(self) -> DataFrame:
        return self._geography().select(
            (F.col("n_nationkey") + 1).alias("region_sk"),
            F.expr(REGION_SQL).alias("region_name"),
            F.col("n_name").alias("sub_region"),
            F.col("n_name").alias("country_code"),
            F.col("n_name").alias("country_name"),
            F.expr(SOURCE_SQL).alias("erp_system"),
        )

    def order_events(self, events: DataFrame | None = None) -> DataFrame:
        raw = self.table("events") if events is None else events
        return raw.select(
            F.col("event_id").cast("string").alias("event_id"),
            F.col("ts").cast("timestamp").alias("event_timestamp"),
            "event_type",
            F.col("props").alias("event_payload"),
        )

    def access_requests(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("REQ-"), F.col("event_id").cast("string")).alias("ticket_id"),
            F.concat(F.lit("DP-00"), (F.col("user_id") % 4 + 1).cast("string")).alias("product_id"),
            F.expr(REQUEST_STATUS_SQL).alias("status"),
            F.col("ts").cast("timestamp").alias("requested_at"),
        )

    def documents(self) -> DataFrame:
        return self.table("documents")

    def embeddings(self) -> DataFrame:
        return self.table("embeddings")


def region_of(source: str) -> str:
    return SOURCE_REGION.get(source, "GLOBAL")
