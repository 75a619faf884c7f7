"""Published product views: stable column lists over Gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns each version-1 view promises, in order.
SALES_ORDERS_V1 = [
    "order_hk", "customer_hk", "order_date", "order_type", "order_status", "currency_code", "net_amount_usd",
    "total_amount_usd", "discount_pct", "source_system", "source_region", "year_number", "quarter_number",
    "quarter_name", "month_number", "month_name", "region_name", "sub_region", "country_code", "erp_system",
]
CUSTOMERS_V1 = [
    "customer_sk", "master_customer_hk", "customer_name", "customer_type", "industry", "country_code", "country_name",
    "region", "is_key_account", "segment", "is_current",
]
FEATURES_V1 = [
    "customer_hk", "as_of_date", "feature_version", "rev_l30d_usd", "rev_l90d_usd", "rev_l365d_usd",
    "order_count_l90", "avg_order_value_l90", "days_since_last_order", "order_frequency_l365",
    "churn_risk_score", "upsell_propensity",
]
CUSTOMER_360_V1 = {
    "customer_hk": "string", "customer_name": "string", "industry": "string", "region": "string", "segment": "string",
    "rev_l30d_usd": "decimal(18,2)", "rev_l90d_usd": "decimal(18,2)", "rev_l365d_usd": "decimal(18,2)",
    "churn_risk_score": "decimal(5,4)", "upsell_propensity": "decimal(5,4)", "days_since_last_order": "int",
    "as_of_date": "date",
}
PREDICTIONS_V1 = [
    "entity_hk", "entity_type", "as_of_date", "model_name", "model_version", "prediction_label",
    "prediction_score", "prediction_band", "confidence_interval",
]
PUBLISHED_MODELS = ["CHURN_RISK", "UPSELL_PROPENSITY"]


def sales_orders(fact: DataFrame, dates: DataFrame, regions: DataFrame) -> DataFrame:
    """Orders with calendar and region attributes.

    Dimensions carry no hint: both are far below the broadcast threshold when
    their size is known, and a large one falls back to a shuffle join.
    """
    when = dates.select(
        "date_key", "year_number", "quarter_number", "quarter_name", "month_number", "month_name"
    )
    where = regions.select("region_sk", "region_name", "sub_region", "country_code", "erp_system")
    return fact.join(when, "date_key", "left").join(where, "region_sk", "left").select(SALES_ORDERS_V1)


def customers(dim: DataFrame) -> DataFrame:
    """Current customers with their key; no e-mail, phone or address leaves this view."""
    return dim.where(F.col("is_current")).select(CUSTOMERS_V1)


def customer_360(dim: DataFrame, identity: DataFrame, rows: DataFrame) -> DataFrame:
    """Feature rows of source customers with what their master customer is known by, in the promised types."""
    owner = identity.select("customer_hk", "master_customer_hk")
    known = dim.where(F.col("is_current")).select("master_customer_hk", "customer_name", "industry", "region", "segment")
    joined = rows.join(owner, "customer_hk").join(known, "master_customer_hk")
    return joined.select(*[F.col(name).cast(kind).alias(name) for name, kind in CUSTOMER_360_V1.items()])


def features(rows: DataFrame) -> DataFrame:
    return rows.select(FEATURES_V1)


def predictions(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("model_name").isin(PUBLISHED_MODELS)).select(PREDICTIONS_V1)


def register(views: dict[str, DataFrame]) -> None:
    """Expose frames as temporary views, e.g. ``sales_orders_v1``."""
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
