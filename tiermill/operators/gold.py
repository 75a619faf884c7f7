"""Gold layer: dimensions, the sales fact, revenue summaries."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiermill.functions.dates import date_key
from tiermill.functions.keys import packed, unpacked
from tiermill.reference import DIM_DATE_DAYS, DIM_DATE_START, OPEN_END, REGION_ROWS, inline_table

# Which source wins when several know an attribute.
SOURCE_PRIORITY = {"SAP": 1, "JDE": 2, "QAD": 3, "SALESFORCE": 4}
ENTERPRISE_ABOVE, MID_MARKET_ABOVE = 1_000_000, 100_000


def revenue_band(amount: Column) -> Column:
    return (
        F.when(amount > ENTERPRISE_ABOVE, "ENTERPRISE")
        .when(amount > MID_MARKET_ABOVE, "MID_MARKET")
        .otherwise("SMB")
    )


# -- date -----------------------------------------------------------------


def calendar(days: DataFrame, day: str = "calendar_date") -> DataFrame:
    """Calendar attributes of each date in a one-column frame."""
    d = F.col(day)
    weekday = F.dayofweek(d) - 1
    return days.select(
        date_key(d).alias("date_key"),
        d.alias("calendar_date"),
        weekday.alias("day_of_week"),
        F.dayname(d).alias("day_name"),
        F.day(d).alias("day_of_month"),
        F.weekofyear(d).alias("week_of_year"),
        F.month(d).alias("month_number"),
        F.monthname(d).alias("month_name"),
        F.quarter(d).alias("quarter_number"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_name"),
        F.year(d).alias("year_number"),
        weekday.isin(0, 6).alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
        F.quarter(d).alias("fiscal_quarter"),
        F.year(d).alias("fiscal_year"),
    )


def dim_date(spark: SparkSession, start: date = DIM_DATE_START, days: int = DIM_DATE_DAYS) -> DataFrame:
    last = start + timedelta(days=days - 1)
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(last))).alias("calendar_date"))
    return calendar(spine)


def dim_date_of(facts: DataFrame, day: str) -> DataFrame:
    """Calendar covering the whole years in which ``facts`` has rows."""
    bounds = facts.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    spine = bounds.select(
        F.explode(
            F.sequence(
                F.trunc("lo", "year"),
                F.date_sub(F.add_months(F.trunc("hi", "year"), 12), 1),
            )
        ).alias("calendar_date")
    )
    return calendar(spine)


# -- region and product ------------------------------------------------------


def dim_region_seed(spark: SparkSession) -> DataFrame:
    """The ten fixed region rows, numbered in their given order."""
    rows = [(i, *row) for i, row in enumerate(REGION_ROWS, start=1)]
    seed = inline_table(
        spark,
        rows,
        "region_sk int; hash_text string; region_name string; sub_region string; "
        "country_code string; country_name string; erp_system string",
    )
    return seed.withColumn("region_hk", F.sha2("hash_text", 256)).drop("hash_text")


def dim_region(regions: DataFrame) -> DataFrame:
    return regions.withColumn("region_hk", F.sha2(F.concat_ws("|", "region_name", "sub_region"), 256)).select(
        "region_sk", "region_hk", "region_name", "sub_region", "country_code", "country_name", "erp_system"
    )


def dim_product(products: DataFrame, loaded_at: datetime) -> DataFrame:
    """Products keyed by the hash of their code (no source prefix), valid from their load on."""
    return products.select(
        F.sha2("product_code", 256).alias("product_hk"),
        "product_code",
        "product_name",
        "product_family",
        "product_line",
        "unit_of_measure",
        F.col("list_price").alias("list_price_usd"),
        F.lit(False).alias("is_discontinued"),
        F.lit(True).alias("is_current"),
        F.lit(loaded_at).alias("effective_from"),
        F.lit(OPEN_END).alias("effective_to"),
    )


# -- customer -----------------------------------------------------------------


def match_key(name: Column, country: Column, own: Column) -> Column:
    """What customers of one master share: name and country. Without a name nothing is known, so the row keeps its own key."""
    clean = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(clean(name) == "", own).otherwise(F.concat_ws("|", clean(name), clean(country)))


def identity(customers: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """One row per source customer with the hash of its master customer."""
    from tiermill.functions.keys import hash_key

    base = customers.select(
        "source_system",
        "original_id",
        "customer_hk",
        "customer_name",
        "country_code",
        F.col("source_region").alias("region"),
        F.col("industry_code").alias("industry"),
        F.lit(None).cast("decimal(18,2)").alias("annual_revenue"),
    )
    if accounts is not None:
        crm = F.lit("SALESFORCE")
        base = base.unionByName(
            accounts.select(
                crm.alias("source_system"),
                F.col("account_id").alias("original_id"),
                hash_key(crm, F.col("account_id")).alias("customer_hk"),
                F.col("account_name").alias("customer_name"),
                F.col("billing_country").alias("country_code"),
                "region",
                "industry",
                "annual_revenue",
            )
        )
    return base.withColumn(
        "master_customer_hk", F.sha2(match_key(F.col("customer_name"), F.col("country_code"), F.col("customer_hk")), 256)
    )


def dim_customer(identified: DataFrame) -> DataFrame:
    """One row per master customer; the best source that knows a value wins."""
    rank = F.create_map(*[F.lit(x) for pair in SOURCE_PRIORITY.items() for x in pair])[F.col("source_system")]
    ranked = identified.withColumn("_order", F.struct(rank.alias("rank"), F.col("original_id")))

    def best(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("_order"))).alias(column)

    def key_of(source: str, alias: str) -> Column:
        return F.min(F.when(F.col("source_system") == source, F.col("customer_hk"))).alias(alias)

    merged = ranked.groupBy("master_customer_hk").agg(
        key_of("SAP", "sap_customer_hk"),
        key_of("JDE", "jde_customer_hk"),
        key_of("QAD", "qad_customer_hk"),
        key_of("SALESFORCE", "sfdc_account_hk"),
        best("customer_name"),
        best("industry"),
        best("country_code"),
        best("region"),
        best("annual_revenue"),
    )
    segment = F.when(F.col("annual_revenue").isNotNull(), revenue_band(F.col("annual_revenue")))
    return merged.select(
        "master_customer_hk", "sap_customer_hk", "jde_customer_hk", "qad_customer_hk", "sfdc_account_hk",
        "customer_name",
        F.lit(None).cast("string").alias("customer_type"),
        "industry", "country_code",
        F.col("country_code").alias("country_name"),
        "region",
        F.coalesce(segment == "ENTERPRISE", F.lit(False)).alias("is_key_account"),
        segment.alias("segment"),
        F.lit(True).alias("is_current"),
    )


# -- fact and summaries ----------------------------------------------------------


def fact_sales(silver_orders: DataFrame, regions: DataFrame) -> DataFrame:
    """Current, clean orders with their date and region keys."""
    clean = silver_orders.where(F.col("is_current") & ~F.col("is_quarantined"))
    lookup = regions.select("country_code", "region_sk")
    zero = F.lit(0).cast("decimal(18,4)")
    return clean.join(lookup, "country_code", "left").select(
        "order_hk",
        "customer_hk",
        F.lit(None).cast("int").alias("product_sk"),
        date_key(F.col("order_date")).alias("date_key"),
        "region_sk",
        "order_date",
        "order_type",
        "order_status",
        "currency_code",
        "net_amount_orig",
        "net_amount_usd",
        "tax_amount_usd",
        (F.coalesce("net_amount_usd", zero) + F.coalesce("tax_amount_usd", zero)).alias("total_amount_usd"),
        F.coalesce("discount_pct", F.lit(0).cast("decimal(5,2)")).alias("discount_pct"),
        "source_system",
        "source_region",
        F.col("source_batch_id"),
        F.col("effective_from").alias("order_loaded_at"),
    )


def per_customer(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Orders, sums and counts of each customer within a group.

    Rows move once, to their group's customer. An order has one customer, so orders are counted there, and a customer is one
    row from then on. The result can be stored by day and added up to longer periods, unlike counts of distinct customers.
    Hash keys, the most of a row, move as bytes.
    """
    parts = [f(c).alias(f"{p}_{c}") for c in sums for f, p in ((F.sum, "sum"), (F.count, "n"))]
    short = [packed(F.col(c)).alias(c) for c in ("customer_hk", "order_hk")]
    dealt = rows.select(*keys, *short, *sums).repartition(*keys, "customer_hk")
    orders = dealt.groupBy(*keys, "customer_hk", "order_hk").agg(*parts)
    counted = added_up(orders.withColumn("order_count", F.col("order_hk").isNotNull().cast("long")), keys, sums)
    return counted.withColumn("customer_hk", unpacked(F.col("customer_hk")))


def added_up(parts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows of ``per_customer`` for coarser keys."""
    names = ["order_count", *[f"{p}_{c}" for c in sums for p in ("sum", "n")]]
    return parts.groupBy(*keys, "customer_hk").agg(*[F.sum(n).alias(n) for n in names])


def _mean(column: str) -> Column:
    return F.sum(f"sum_{column}").cast("double") / F.sum(f"n_{column}")


def regional_sales_daily(fact: DataFrame) -> DataFrame:
    keys = ["source_system", "source_region", "date_key", "region_sk"]
    customers = per_customer(fact, keys, ["net_amount_usd", "tax_amount_usd", "total_amount_usd", "discount_pct"])
    return customers.groupBy(*keys).agg(
        F.sum("order_count").alias("order_count"),
        F.sum("sum_net_amount_usd").alias("total_revenue_usd"),
        F.sum("sum_tax_amount_usd").alias("total_tax_usd"),
        F.sum("sum_total_amount_usd").alias("total_billed_usd"),
        _mean("net_amount_usd").alias("avg_order_value_usd"),
        _mean("discount_pct").alias("avg_discount_pct"),
        F.count("customer_hk").alias("unique_customers"),
    )


REVENUE_SUMS = ["line_amount_usd", "discount_pct"]


def product_customer_days(lines: DataFrame) -> DataFrame:
    """Revenue and orders of each customer per product, source and day: the daily part that summaries are added up from."""
    d = F.col("order_date")
    dated = lines.where(~F.col("is_quarantined")).withColumn("date_key", date_key(d))
    return per_customer(dated, ["product_code", "source_system", "date_key"], REVENUE_SUMS)


def product_summary(customers: DataFrame, period: str) -> DataFrame:
    """Summary of customer rows of one period column."""
    return customers.groupBy("product_code", "source_system", period).agg(
        F.sum("sum_line_amount_usd").alias("total_revenue_usd"),
        F.sum("order_count").alias("order_count"),
        F.count("customer_hk").alias("unique_customers"),
        _mean("discount_pct").alias("avg_discount_pct"),
    )


def product_revenue(lines: DataFrame, grain: str = "day") -> DataFrame:
    """Revenue per product and source, by day or by calendar month."""
    if grain == "day":
        return product_summary(product_customer_days(lines), "date_key")
    month = F.year("order_date") * 100 + F.month("order_date")
    dated = lines.where(~F.col("is_quarantined")).withColumn("month_key", month)
    return product_summary(per_customer(dated, ["product_code", "source_system", "month_key"], REVENUE_SUMS), "month_key")


def product_revenue_from_days(days: DataFrame) -> DataFrame:
    """The monthly summary from stored daily parts: a customer of several days is one customer of the month."""
    month = F.floor(F.col("date_key") / 100).cast("int")
    monthly = days.withColumns({"month_key": month, "customer_hk": packed(F.col("customer_hk"))})
    return product_summary(added_up(monthly, ["product_code", "source_system", "month_key"], REVENUE_SUMS), "month_key")


def number_rows(df: DataFrame, order_by: str, name: str) -> DataFrame:
    """Surrogate keys 1..n in the order of ``order_by``, without one big sort task.

    Meant for hash keys: the first three hex digits cut the rows in at most
    4,096 even slices. Counts per slice become offsets, and rows are numbered
    inside their slice.
    """
    slice_ = F.substring(order_by, 1, 3)
    sliced = df.withColumn("_slice", slice_)
    offsets = (
        sliced.groupBy("_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_offset",
            F.coalesce(
                F.sum("_n").over(
                    Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(order_by))
    return (
        sliced.withColumn("_within", within)
        .join(offsets, "_slice")
        .withColumn(name, (F.col("_offset") + F.col("_within")).cast("bigint"))
        .drop("_slice", "_offset", "_within")
    )
