"""Gold plans: dimensions, fact, revenue summaries, their published views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.functions.exact import money
from tiermill.operators import gold, products as published, silver as conform
from tiermill.plans import oracle as q
from tiermill.plans.registry import plan
from tiermill.plans.silver import lines, orders, sql_stamp, stamp
from tiermill.reference import OPEN_END
from tiermill.session import stored
from tiermill.sources.bridge import CUSTOMER_LOADS, Bronze

AMOUNTS = ["net_amount_orig", "net_amount_usd", "tax_amount_usd", "total_amount_usd", "discount_pct"]


def doubles(*names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


def sql_doubles(*names: str, prefix: str = "") -> str:
    return ", ".join(f"CAST({prefix}{n} AS DOUBLE) AS {n}" for n in names)


def fact(b: Bronze, before=None) -> DataFrame:
    return gold.fact_sales(orders(b, before), b.regions())


# -- dimensions --------------------------------------------------------------

q.RELATIONS["calendar_days"] = (
    "SELECT CAST(unnest(generate_series(date_trunc('year', min(order_date)), "
    "date_trunc('year', max(order_date)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM bronze_orders"
)
q.RELATIONS["dim_dates"] = """
SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, d AS calendar_date, CAST(dayofweek(d) AS INT) AS day_of_week,
  left(dayname(d), 3) AS day_name, CAST(day(d) AS INT) AS day_of_month, CAST(weekofyear(d) AS INT) AS week_of_year,
  CAST(month(d) AS INT) AS month_number, left(monthname(d), 3) AS month_name, CAST(quarter(d) AS INT) AS quarter_number,
  'Q' || CAST(quarter(d) AS VARCHAR) AS quarter_name, CAST(year(d) AS INT) AS year_number, dayofweek(d) IN (0, 6) AS is_weekend,
  FALSE AS is_holiday, CAST(quarter(d) AS INT) AS fiscal_quarter, CAST(year(d) AS INT) AS fiscal_year FROM calendar_days"""


@plan("dim_date", "SELECT * FROM dim_dates")
def dim_date(b: Bronze) -> DataFrame:
    return calendar(b)


def calendar(b: Bronze) -> DataFrame:
    return gold.dim_date_of(b.table("orders").select(F.to_date(F.col("o_orderdate")).alias("d")), "d")


@plan(
    "dim_region",
    """SELECT region_sk, region_hk, region_name, sub_region, country_code, erp_system, count(c_custkey) AS customers
      FROM dim_regions LEFT JOIN customer ON c_nationkey = region_sk - 1 GROUP BY ALL""",
)
def dim_region(b: Bronze) -> DataFrame:
    """Region dimension with the number of customers in each row."""
    per_nation = b.table("customer").groupBy((F.col("c_nationkey") + 1).alias("region_sk")).agg(
        F.count("*").alias("customers")
    )
    return gold.dim_region(b.regions()).join(per_nation, "region_sk", "left").select(
        "region_sk", "region_hk", "region_name", "sub_region", "country_code", "erp_system",
        F.coalesce("customers", F.lit(0)).alias("customers"),
    )


@plan(
    "dim_product",
    f"""SELECT row_number() OVER (ORDER BY sha256(CAST(p_partkey AS VARCHAR))) AS product_sk,
      sha256(CAST(p_partkey AS VARCHAR)) AS product_hk, CAST(p_partkey AS VARCHAR) AS product_code, p_name AS product_name,
      p_type AS product_family, p_brand AS product_line, 'EA' AS unit_of_measure, p_retailprice AS list_price_usd,
      FALSE AS is_discontinued, TRUE AS is_current, {sql_stamp(f"TIMESTAMP '{CUSTOMER_LOADS[0]}'")} AS effective_from,
      {sql_stamp(f"TIMESTAMP '{OPEN_END}'")} AS effective_to FROM part""",
)
def dim_product(b: Bronze) -> DataFrame:
    numbered = gold.number_rows(gold.dim_product(b.products(), CUSTOMER_LOADS[0]), "product_hk", "product_sk")
    return numbered.withColumns(
        {
            "list_price_usd": F.col("list_price_usd").cast("double"),
            "effective_from": stamp("effective_from"),
            "effective_to": stamp("effective_to"),
        }
    )


def dim_customers(b: Bronze) -> DataFrame:
    return gold.dim_customer(identities(b))


def identities(b: Bronze) -> DataFrame:
    return gold.identity(conform.customers(b.customers()), b.accounts())


@plan(
    "dim_customer",
    """SELECT row_number() OVER (ORDER BY master_customer_hk) AS customer_sk, master_customer_hk, sap_customer_hk, jde_customer_hk,
      qad_customer_hk, sfdc_account_hk, customer_name, industry, country_code, region, is_key_account, segment FROM dim_customers""",
)
def dim_customer(b: Bronze) -> DataFrame:
    numbered = gold.number_rows(dim_customers(b), "master_customer_hk", "customer_sk")
    return numbered.select(
        "customer_sk", "master_customer_hk", "sap_customer_hk", "jde_customer_hk", "qad_customer_hk",
        "sfdc_account_hk", "customer_name", "industry", "country_code", "region", "is_key_account", "segment",
    )


# -- fact and summaries ---------------------------------------------------------


@plan(
    "fact_sales",
    f"""SELECT order_hk, customer_hk, CAST(NULL AS INT) AS product_sk, date_key, region_sk, order_date, order_type, order_status,
      currency_code, {sql_doubles(*AMOUNTS)}, source_system, source_region, {sql_stamp('effective_from')} AS order_loaded_at FROM facts""",
)
def fact_sales(b: Bronze) -> DataFrame:
    return fact(b).select(
        "order_hk", "customer_hk", "product_sk", "date_key", "region_sk", "order_date", "order_type", "order_status",
        "currency_code", *doubles(*AMOUNTS), "source_system", "source_region",
        stamp("order_loaded_at").alias("order_loaded_at"),
    )


REGIONAL_SQL = f"""SELECT source_system, source_region, date_key, region_sk, count(DISTINCT order_hk) AS order_count,
  {q.money('sum(net_amount_usd)')} AS total_revenue_usd, {q.money('sum(tax_amount_usd)')} AS total_tax_usd,
  {q.money('sum(total_amount_usd)')} AS total_billed_usd,
  CAST(sum(net_amount_usd) AS DOUBLE) / count(net_amount_usd) AS avg_order_value_usd,
  CAST(sum(discount_pct) AS DOUBLE) / count(discount_pct) AS avg_discount_pct,
  count(DISTINCT customer_hk) AS unique_customers FROM facts GROUP BY ALL"""


def summary_report(df: DataFrame) -> DataFrame:
    totals = [c for c in df.columns if c.startswith("total_")]
    return df.withColumns({c: money(F.col(c)) for c in totals})


@plan("regional_sales_daily", REGIONAL_SQL)
def regional_sales_daily(b: Bronze) -> DataFrame:
    return summary_report(gold.regional_sales_daily(fact(b)))


def _product_sql(period: str) -> str:
    return f"""SELECT product_code, source_system, {period}, {q.money('sum(line_amount_usd)')} AS total_revenue_usd,
      count(DISTINCT order_hk) AS order_count, count(DISTINCT customer_hk) AS unique_customers,
      CAST(sum(discount_pct) AS DOUBLE) / count(discount_pct) AS avg_discount_pct
      FROM silver_lines WHERE NOT is_quarantined GROUP BY ALL"""


DAY_SQL = _product_sql("CAST(strftime(order_date, '%Y%m%d') AS INT) AS date_key")
MONTH_SQL = _product_sql("CAST(strftime(order_date, '%Y%m') AS INT) AS month_key")


@plan("product_revenue", DAY_SQL)
def product_revenue(b: Bronze) -> DataFrame:
    return summary_report(gold.product_revenue(lines(b), "day"))


@plan("product_revenue_month", MONTH_SQL)
def product_revenue_month(b: Bronze) -> DataFrame:
    return summary_report(gold.product_revenue(lines(b), "month"))


@plan("product_revenue_rollup", MONTH_SQL)
def product_revenue_rollup(b: Bronze) -> DataFrame:
    """The monthly summary from a stored daily table, as a scheduled run would make it without reading the lines again."""
    days = stored(gold.product_customer_days(lines(b)), "product-customer-days", compression="zstd")
    return summary_report(gold.product_revenue_from_days(days))


# -- published views ---------------------------------------------------------------

SALES_VIEW_SQL = f"""SELECT order_hk, customer_hk, order_date, order_type, order_status, currency_code,
  {sql_doubles('net_amount_usd', 'total_amount_usd', 'discount_pct')}, source_system, source_region, d.year_number,
  d.quarter_number, d.quarter_name, d.month_number, d.month_name, r.region_name, r.sub_region, r.country_code, r.erp_system
  FROM facts LEFT JOIN dim_dates d USING (date_key) LEFT JOIN dim_regions r USING (region_sk)"""


def sales_view(b: Bronze) -> DataFrame:
    return published.sales_orders(fact(b), calendar(b), gold.dim_region(b.regions()))


@plan("product_sales_orders", SALES_VIEW_SQL)
def product_sales_orders(b: Bronze) -> DataFrame:
    return sales_view(b).withColumns({n: F.col(n).cast("double") for n in ("net_amount_usd", "total_amount_usd", "discount_pct")})


@plan("product_regional_summary", REGIONAL_SQL)
def product_regional_summary(b: Bronze) -> DataFrame:
    return summary_report(gold.regional_sales_daily(fact(b)))


@plan("product_product_revenue", DAY_SQL)
def product_product_revenue(b: Bronze) -> DataFrame:
    return summary_report(gold.product_revenue(lines(b), "day"))


@plan("product_monthly_revenue", MONTH_SQL)
def product_monthly_revenue(b: Bronze) -> DataFrame:
    return summary_report(gold.product_revenue(lines(b), "month"))


@plan(
    "product_customers",
    """SELECT row_number() OVER (ORDER BY master_customer_hk) AS customer_sk, master_customer_hk, customer_name, CAST(NULL AS VARCHAR) AS customer_type, industry, country_code,
      country_code AS country_name, region, is_key_account, segment, TRUE AS is_current FROM dim_customers""",
)
def product_customers(b: Bronze) -> DataFrame:
    return published.customers(gold.number_rows(dim_customers(b), "master_customer_hk", "customer_sk"))
