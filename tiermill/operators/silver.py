"""Bronze to Silver: conformed, hash-keyed, priced in USD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermill.functions.keys import attributes_text, hash_diff, hash_key
from tiermill.reference import OPEN_END, SOURCE_REGION, currency_table


def with_fx(df: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Add ``fx_rate``; a currency without a rate converts at 1.

    The default table has fifteen rows and is broadcast. A caller's table is
    joined without a hint, so Spark broadcasts it only if its size allows.
    """
    fixed = rates is None
    table = (currency_table(df.sparkSession) if fixed else rates).select(
        F.col("currency_code").alias("_fx_code"), "fx_to_usd"
    )
    joined = df.join(F.broadcast(table) if fixed else table, F.col("currency_code") == F.col("_fx_code"), "left")
    one = F.lit("1.000000").cast("decimal(10,6)")
    return joined.withColumn("fx_rate", F.coalesce("fx_to_usd", one)).drop("_fx_code", "fx_to_usd")


def _usd(amount: str) -> Column:
    return (F.col(amount) * F.col("fx_rate")).cast("decimal(18,4)")


# -- orders ---------------------------------------------------------------

HEADER = [
    "source_system", "source_region", "order_id", "order_type", "order_date", "delivery_date",
    "customer_id", "order_status", "currency_code", "net_amount", "tax_amount", "discount_pct",
    "country_code", "load_timestamp", "batch_id",
]


def _sourced(df: DataFrame, source: str) -> DataFrame:
    return df.withColumns(
        {"source_system": F.lit(source), "source_region": F.lit(SOURCE_REGION[source])}
    )


def conform_sap_orders(bronze: DataFrame) -> DataFrame:
    return _sourced(bronze, "SAP").select(HEADER)


def conform_jde_orders(lines: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Line-level source to headers: amounts add up, first date, last status.

    Amounts of several currencies cannot be added, so the lines of such an order are converted one by one and its header is
    in USD; ``mixed_currency_orders`` lists them.
    """
    one = F.min("currency_code").eqNullSafe(F.max("currency_code"))
    head = with_fx(lines, rates).withColumn("_usd", _usd("extended_price")).groupBy("order_id").agg(
        F.max("order_type").alias("order_type"),
        F.min("order_date").alias("order_date"),
        F.max("customer_id").alias("customer_id"),
        F.max("status_code").alias("order_status"),
        F.when(one, F.max("currency_code")).otherwise(F.lit("USD")).alias("currency_code"),
        F.when(one, F.sum("extended_price")).otherwise(F.sum("_usd")).cast("decimal(18,4)").alias("net_amount"),
        F.max("country_code").alias("country_code"),
        F.max("load_timestamp").alias("load_timestamp"),
        F.max("batch_id").alias("batch_id"),
    )
    blank = {
        "delivery_date": F.lit(None).cast("date"),
        "tax_amount": F.lit(None).cast("decimal(18,4)"),
        "discount_pct": F.lit(None).cast("decimal(5,2)"),
    }
    return _sourced(head.withColumns(blank), "JDE").select(HEADER)


def mixed_currency_orders(lines: DataFrame) -> DataFrame:
    """Orders whose lines name several currencies, with these."""
    named = lines.groupBy("order_id").agg(F.array_sort(F.collect_set("currency_code")).alias("currencies"))
    return named.where(F.size("currencies") > 1)


def conform_qad_orders(bronze: DataFrame) -> DataFrame:
    blank = {
        "delivery_date": F.lit(None).cast("date"),
        "net_amount": F.col("total_amount"),
        "tax_amount": F.lit(None).cast("decimal(18,4)"),
    }
    return _sourced(bronze.withColumns(blank), "QAD").select(HEADER)


def union_orders(*headers: DataFrame) -> DataFrame:
    merged = headers[0]
    for other in headers[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


def order_hashes(order_id: str = "original_id", net_amount: str = "net_amount_orig") -> dict[str, Column]:
    """Hash columns of an order, from the columns they are made of."""
    src = F.col("source_system")
    return {
        "order_hk": hash_key(src, F.col(order_id)),
        "customer_hk": hash_key(src, F.col("customer_id")),
        "hash_diff": hash_diff(
            attributes_text(F.col("order_status"), F.col(net_amount).cast("decimal(18,4)"), F.col("customer_id"))
        ),
    }


def orders(headers: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Silver orders from conformed headers of any number of sources."""
    hashes = order_hashes("order_id", "net_amount")
    return with_fx(headers.where(F.col("order_id").isNotNull()), rates).select(
        hashes["order_hk"].alias("order_hk"),
        "source_system",
        "source_region",
        F.col("order_id").alias("original_id"),
        "customer_id",
        hashes["customer_hk"].alias("customer_hk"),
        F.lit(None).cast("string").alias("salesperson_hk"),
        "order_date",
        "delivery_date",
        "order_type",
        "order_status",
        "currency_code",
        F.col("net_amount").alias("net_amount_orig"),
        _usd("net_amount").alias("net_amount_usd"),
        _usd("tax_amount").alias("tax_amount_usd"),
        F.coalesce("discount_pct", F.lit(0).cast("decimal(5,2)")).alias("discount_pct"),
        "country_code",
        F.array().cast("array<string>").alias("dq_flags"),
        (F.col("order_id").isNull() | F.col("customer_id").isNull()).alias("is_quarantined"),
        hashes["hash_diff"].alias("hash_diff"),
        F.col("load_timestamp").alias("effective_from"),
        F.lit(OPEN_END).alias("effective_to"),
        F.lit(True).alias("is_current"),
        F.col("batch_id").alias("source_batch_id"),
        "load_timestamp",
    )


# -- customers --------------------------------------------------------------

MANDATORY_CUSTOMER = ["customer_id", "customer_name", "country_code", "city", "postal_code"]


CUSTOMER_SHAPE = {
    "source_system": "string", "source_region": "string", "customer_id": "string", "customer_name": "string", "city": "string",
    "postal_code": "string", "country_code": "string", "phone": "string", "credit_limit": "decimal(18,2)",
    "payment_terms": "string", "industry_code": "string", "load_timestamp": "timestamp", "batch_id": "string",
}


def _customer_shape(landed: DataFrame, source: str, **renamed: str) -> DataFrame:
    """A source's own landing columns as the shape that ``customers`` takes; what the source has not is NULL."""
    named = landed.withColumnsRenamed(renamed).withColumns(
        {"source_system": F.lit(source), "source_region": F.lit(SOURCE_REGION[source])}
    )
    return named.select(
        *[(F.col(c) if c in named.columns else F.lit(None)).cast(kind).alias(c) for c, kind in CUSTOMER_SHAPE.items()]
    )


def conform_sap_customers(landed: DataFrame) -> DataFrame:
    return _customer_shape(landed, "SAP")


def conform_jde_customers(landed: DataFrame) -> DataFrame:
    return _customer_shape(landed, "JDE", zip_code="postal_code")


def conform_qad_customers(landed: DataFrame) -> DataFrame:
    """This source knows neither a postal code nor an industry."""
    return _customer_shape(landed, "QAD")


def customers(bronze: DataFrame) -> DataFrame:
    """Silver customers with a completeness score, 20 points per filled field."""
    src = F.col("source_system")
    score = sum(F.when(F.col(c).isNotNull(), 20).otherwise(0) for c in MANDATORY_CUSTOMER)
    missing = F.col("customer_id").isNull()
    return bronze.where(~missing).select(
        hash_key(src, F.col("customer_id")).alias("customer_hk"),
        "source_system",
        "source_region",
        F.col("customer_id").alias("original_id"),
        "customer_name",
        F.lit(None).cast("string").alias("customer_type"),
        "industry_code",
        "country_code",
        F.lit(None).cast("string").alias("region_code"),
        "city",
        "postal_code",
        "payment_terms",
        F.col("credit_limit").alias("credit_limit_usd"),
        score.alias("dq_completeness_score"),
        F.array().cast("array<string>").alias("dq_flags"),
        missing.alias("is_quarantined"),
        F.when(missing, "CUSTOMER_ID_NOT_NULL").alias("quarantine_reason"),
        hash_diff(
            attributes_text(*[F.col(c) for c in ("customer_name", "country_code", "city", "postal_code")])
        ).alias("hash_diff"),
        F.col("load_timestamp").alias("effective_from"),
        F.lit(OPEN_END).alias("effective_to"),
        F.lit(True).alias("is_current"),
        F.lit(1).alias("record_version"),
        F.col("batch_id").alias("source_batch_id"),
    )


# -- lines, products, opportunities ---------------------------------------------


def order_lines(items: DataFrame, silver_orders: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Silver lines of current orders.

    Source, customer, date and currency come from the header. Items that name
    their source are matched within it, as two sources may share an order id.
    """
    match = ["order_id"] + [c for c in ("source_system",) if c in items.columns]
    head = silver_orders.where(F.col("is_current")).select(
        F.col("original_id").alias("order_id"), "source_system", "order_hk", "customer_hk",
        "order_date", "currency_code", "is_quarantined", "source_batch_id", "effective_from",
    )
    src = F.col("source_system")
    line_id = F.concat_ws("-", "order_id", F.col("line_item").cast("string"))
    return with_fx(items.join(head, match), rates).select(
        hash_key(src, line_id).alias("line_hk"),
        "source_system",
        F.col("order_id").alias("original_order_id"),
        F.col("line_item").alias("line_number"),
        "order_hk",
        "customer_hk",
        hash_key(src, F.col("product_code")).alias("product_hk"),
        "product_code",
        "product_family",
        "order_date",
        "quantity",
        F.col("unit_price").alias("unit_price_orig"),
        _usd("unit_price").alias("unit_price_usd"),
        _usd("line_amount").alias("line_amount_usd"),
        "discount_pct",
        F.col("item_status").alias("line_status"),
        "is_quarantined",
        "source_batch_id",
        "effective_from",
    )


def orphan_lines(items: DataFrame, silver_orders: DataFrame) -> DataFrame:
    """Items without a current header: not lost, but waiting for it or rejected by whoever owns them."""
    match = ["order_id"] + [c for c in ("source_system",) if c in items.columns]
    heads = silver_orders.where(F.col("is_current")).select(F.col("original_id").alias("order_id"), "source_system")
    return items.join(heads, match, "left_anti").withColumn("rejection_reason", F.lit("ORDER_NOT_FOUND"))


def products(bronze: DataFrame, source: str = "SAP") -> DataFrame:
    region = SOURCE_REGION[source]
    return bronze.where(F.col("product_code").isNotNull()).select(
        hash_key(F.lit(source), F.col("product_code")).alias("product_hk"),
        F.lit(source).alias("source_system"),
        F.lit(region).alias("source_region"),
        F.col("product_code").alias("original_id"),
        "product_code",
        "product_name",
        "product_family",
        "product_line",
        "unit_of_measure",
        F.col("list_price").alias("list_price_usd"),
        F.lit(False).alias("is_discontinued"),
        hash_diff(
            attributes_text(*[F.col(c) for c in ("product_name", "product_family", "product_line", "list_price")])
        ).alias("hash_diff"),
    )


def opportunities(deals: DataFrame, identity: DataFrame) -> DataFrame:
    """Silver deals; ``customer_hk`` is the master customer of the account."""
    account = identity.where(F.col("source_system") == "SALESFORCE").select(
        F.col("original_id").alias("account_id"), F.col("master_customer_hk").alias("customer_hk")
    )
    src = F.lit("SALESFORCE")
    return deals.join(account, "account_id", "left").select(
        hash_key(src, F.col("opp_id")).alias("opp_hk"),
        src.alias("source_system"),
        F.col("opp_id").alias("original_id"),
        "customer_hk",
        "opp_name",
        "stage_name",
        F.col("amount").alias("amount_usd"),
        "probability",
        "close_date",
        "is_won",
        "is_closed",
        "region",
        hash_diff(
            attributes_text(*[F.col(c) for c in ("stage_name", "amount", "probability", "close_date")])
        ).alias("hash_diff"),
        F.col("load_timestamp").alias("effective_from"),
    )
