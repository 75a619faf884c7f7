"""Landing schemas of the source systems, and the shared metadata columns."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
    "bigint": T.LongType(),
    "money": T.DecimalType(18, 4),
    "limit": T.DecimalType(18, 2),
    "percent": T.DecimalType(5, 2),
    "quantity": T.DecimalType(15, 3),
}


def schema(text: str) -> T.StructType:
    """``"name kind, name kind"`` to a schema; a bare name is text."""
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(f[0], _KINDS[f[1] if len(f) > 1 else "string"]) for f in fields])


METADATA = schema(
    "source_system, source_region, load_id, load_timestamp timestamp, load_date date, batch_id, is_deleted boolean, raw_record"
)
ORDER_EXTRA_METADATA = schema("file_name, row_number bigint, change_type")

# Business columns of each landing table.
BRONZE = {
    "sap_orders": schema(
        "order_id, order_type, order_date date, delivery_date date, customer_id, ship_to_party, sales_org, "
        "distribution_ch, division, order_status, currency_code, net_amount money, tax_amount money, "
        "discount_pct percent, country_code, region_code, created_by, changed_date timestamp"
    ),
    "sap_order_items": schema(
        "order_id, line_item bigint, product_code, product_desc, quantity quantity, unit_of_measure, "
        "unit_price money, line_amount money, discount_pct percent, currency_code, plant, item_status"
    ),
    "sap_customers": schema(
        "customer_id, customer_name, customer_type, street, city, postal_code, country_code, phone, email, "
        "tax_number, credit_limit limit, payment_terms, industry_code, sales_district"
    ),
    "jde_orders": schema(
        "order_id, order_type, order_date date, customer_id, ship_to_id, branch_plant, status_code, "
        "quantity_ordered quantity, quantity_shipped quantity, unit_price money, extended_price money, "
        "currency_code, country_code"
    ),
    "jde_customers": schema(
        "customer_id, customer_name, address_line_1, city, state_code, zip_code, country_code, phone, tax_id, "
        "credit_limit limit, payment_terms"
    ),
    "qad_orders": schema(
        "order_id, order_date date, customer_id, site, order_status, order_type, currency_code, "
        "total_amount money, discount_pct percent, country_code"
    ),
    "qad_customers": schema("customer_id, customer_name, city, country_code, phone, credit_limit limit, payment_terms"),
    "opportunities": schema(
        "opp_id, opp_name, account_id, stage_name, amount limit, probability percent, close_date date, "
        "created_date timestamp, modified_date timestamp, owner_id, lead_source, is_won boolean, is_closed boolean, region"
    ),
    "accounts": schema(
        "account_id, account_name, industry, annual_revenue limit, employee_count bigint, billing_country, region"
    ),
    "order_events": schema(
        "event_id, kafka_topic, kafka_partition bigint, kafka_offset bigint, event_timestamp timestamp, event_type, "
        "source_system, event_payload"
    ),
}

# The six columns a lenient order file carries, in file order.
ORDER_FILE = schema("order_id, order_date date, customer_id, currency_code, net_amount money, order_status")
