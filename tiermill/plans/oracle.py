"""Checking SQL: named relations that mirror the transforms in plain SQL.

A check is a SELECT over these names; ``compose`` puts the ones it needs in
front of it as common table expressions.
"""

from __future__ import annotations

import re

from tiermill import reference as ref
from tiermill.sources import bridge as br

RUN_TS = f"TIMESTAMP '{br.RUN_TS}'"
AS_OF = f"DATE '{br.AS_OF}'"


def sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def money(expr: str) -> str:
    return f"CAST(round({expr}, 2) AS DOUBLE)"


def percent(part: str, total: str, when_empty: int) -> str:
    """Integer half-up percentage with two decimals, as DECIMAL(5,2)."""
    return (
        f"CASE WHEN {total} = 0 THEN CAST({when_empty} AS DECIMAL(5,2)) ELSE "
        f"CAST(CAST((CAST({part} AS HUGEINT) * 20000 + {total}) // ({total} * 2) AS DECIMAL(12,0)) / 100.0 AS DECIMAL(5,2)) END"
    )


def mean_2dp(total: str, n: str) -> str:
    return f"CAST(CAST((CAST({total} * 200 AS BIGINT) + {n}) // ({n} * 2) AS DOUBLE) / 100 AS DOUBLE)"


def digest(*parts: str) -> str:
    text = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"sha256(upper(trim({text})))"


def hk(source: str, pk: str) -> str:
    return f"sha256(upper(trim({source})) || '|' || upper(trim(coalesce(CAST({pk} AS VARCHAR), 'NULL_PK'))))"


def rate_of(code: str) -> str:
    return f"CAST(coalesce((SELECT fx.rate FROM fx WHERE fx.code = {code}), 1) AS DECIMAL(10,6))"


RELATIONS: dict[str, str] = {}

RELATIONS["fx"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{code}', CAST({rate} AS DECIMAL(10,6)))" for code, rate in ref.FX_TO_USD.items()
) + ") t(code, rate)"

RELATIONS["geo"] = (
    f"SELECT n_nationkey, n_name, r_name, {br.SOURCE_SQL} AS source_system, {br.REGION_SQL} AS source_region "
    "FROM nation JOIN region ON n_regionkey = r_regionkey"
)

RELATIONS["bronze_orders"] = f"""
SELECT source_system, source_region, CAST(o_orderkey AS VARCHAR) AS order_id, o_orderpriority AS order_type,
  CAST(o_orderdate AS DATE) AS order_date, {br.CUSTOMER_ID_SQL} AS customer_id, o_orderstatus AS order_status,
  {br.CURRENCY_SQL} AS currency_code, {br.NET_SQL} AS net_amount,
  CASE WHEN r_name = 'EUROPE' THEN CAST({br.NET_SQL} * CAST(0.08 AS DECIMAL(3,2)) AS DECIMAL(18,4)) END AS tax_amount,
  n_name AS country_code, o_orderdate + to_hours(o_orderkey % 8) AS load_timestamp,
  {br.BATCH_SQL} AS batch_id
FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo ON c_nationkey = n_nationkey"""

RELATIONS["priced_orders"] = (
    "SELECT b.*, CAST(coalesce(fx.rate, 1) AS DECIMAL(10,6)) AS fx_rate "
    "FROM bronze_orders b LEFT JOIN fx ON fx.code = b.currency_code"
)

RELATIONS["silver_orders"] = f"""
SELECT {hk('source_system', 'order_id')} AS order_hk, source_system, source_region, order_id AS original_id,
  customer_id, {hk('source_system', 'customer_id')} AS customer_hk, order_date, order_type, order_status,
  currency_code, net_amount AS net_amount_orig, CAST(net_amount * fx_rate AS DECIMAL(18,4)) AS net_amount_usd,
  CAST(tax_amount * fx_rate AS DECIMAL(18,4)) AS tax_amount_usd, CAST(0 AS DECIMAL(5,2)) AS discount_pct,
  country_code, customer_id IS NULL AS is_quarantined, {digest('order_status', 'net_amount', 'customer_id')} AS hash_diff,
  load_timestamp AS effective_from, batch_id AS source_batch_id, load_timestamp
FROM priced_orders"""

RELATIONS["bronze_customers"] = f"""
SELECT source_system, source_region, CAST(c_custkey AS VARCHAR) AS customer_id, {br.NAME_SQL} AS customer_name,
  {br.CITY_SQL} AS city, {br.POSTAL_SQL} AS postal_code, n_name AS country_code, {br.PHONE_SQL} AS phone,
  {br.EMAIL_SQL} AS email, {br.CREDIT_SQL} AS credit_limit, c_mktsegment AS industry_code, c_custkey
FROM customer JOIN geo ON c_nationkey = n_nationkey"""

RELATIONS["silver_customers"] = f"""
SELECT {hk('source_system', 'customer_id')} AS customer_hk, source_system, source_region, customer_id AS original_id,
  customer_name, industry_code, country_code, city, postal_code, credit_limit AS credit_limit_usd,
  20 * (1 + CAST(customer_name IS NOT NULL AS INT) + CAST(country_code IS NOT NULL AS INT)
    + CAST(city IS NOT NULL AS INT) + CAST(postal_code IS NOT NULL AS INT)) AS dq_completeness_score,
  {digest('customer_name', 'country_code', 'city', 'postal_code')} AS hash_diff
FROM bronze_customers"""

RELATIONS["customer_loads"] = f"""
SELECT {hk('source_system', 'customer_id')} AS customer_hk, loaded_at AS effective_from, new_city AS city,
  {digest('customer_name', 'country_code', 'new_city', 'postal_code')} AS hash_diff
FROM (SELECT b.*, l.loaded_at, CASE WHEN l.n = 3 AND c_custkey % 15 = 0 THEN 'THIRD CITY'
        WHEN l.n >= 2 AND c_custkey % 5 = 0 THEN 'SECOND CITY' ELSE city END AS new_city
      FROM bronze_customers b CROSS JOIN (VALUES {', '.join(f"({i}, TIMESTAMP '{t}')" for i, t in enumerate(br.CUSTOMER_LOADS, 1))}) l(n, loaded_at))"""

RELATIONS["customer_changes"] = """
SELECT * FROM (SELECT *, lag(hash_diff) OVER (PARTITION BY customer_hk ORDER BY effective_from) AS previous FROM customer_loads)
WHERE previous IS DISTINCT FROM hash_diff"""

RELATIONS["customer_versions"] = """
SELECT customer_hk, effective_from, city, hash_diff,
  coalesce(lead(effective_from) OVER w, TIMESTAMP '9999-12-31 23:59:59') AS effective_to,
  lead(effective_from) OVER w IS NULL AS is_current, row_number() OVER w AS record_version
FROM customer_changes WINDOW w AS (PARTITION BY customer_hk ORDER BY effective_from)"""

RELATIONS["silver_lines"] = f"""
SELECT {hk('o.source_system', "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)")} AS line_hk,
  o.source_system, CAST(l_orderkey AS VARCHAR) AS original_order_id, l_linenumber AS line_number, o.order_hk, o.customer_hk,
  {hk('o.source_system', 'l_partkey')} AS product_hk, CAST(l_partkey AS VARCHAR) AS product_code, {br.FAMILY_SQL} AS product_family,
  o.order_date, CAST(l_quantity AS DECIMAL(15,3)) AS quantity,
  CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * coalesce(fx.rate, CAST(1 AS DECIMAL(10,6))) AS DECIMAL(18,4)) AS unit_price_usd,
  CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (CAST(1 AS DECIMAL(5,2)) - CAST(l_discount AS DECIMAL(5,2))) AS DECIMAL(18,4))
    * coalesce(fx.rate, CAST(1 AS DECIMAL(10,6))) AS DECIMAL(18,4)) AS line_amount_usd,
  CAST(l_discount * 100 AS DECIMAL(5,2)) AS discount_pct, l_linestatus AS line_status, o.is_quarantined,
  o.source_batch_id, o.effective_from
FROM lineitem JOIN silver_orders o ON o.original_id = {br.ITEM_ORDER_SQL}
LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN fx ON fx.code = o.currency_code"""

RELATIONS["identities"] = f"""
SELECT *, sha256(CASE WHEN trim(coalesce(customer_name, '')) = '' THEN customer_hk
    ELSE upper(trim(customer_name)) || '|' || upper(trim(coalesce(country_code, ''))) END) AS master_customer_hk
FROM (SELECT source_system, original_id, customer_hk, customer_name, country_code, source_region AS region,
        industry_code AS industry, CAST(NULL AS DECIMAL(18,2)) AS annual_revenue FROM silver_customers
      UNION ALL
      SELECT 'SALESFORCE', 'ACC-' || CAST(c_custkey AS VARCHAR), {hk("'SALESFORCE'", "'ACC-' || CAST(c_custkey AS VARCHAR)")},
        {br.NAME_SQL}, n_name, {br.REGION_SQL}, c_mktsegment, {br.ANNUAL_REVENUE_SQL}
      FROM customer JOIN geo ON c_nationkey = n_nationkey)"""


def _best(column: str) -> str:
    return (
        f"arg_min({column}, CASE source_system WHEN 'SAP' THEN 1 WHEN 'JDE' THEN 2 WHEN 'QAD' THEN 3 ELSE 4 END) "
        f"FILTER (WHERE {column} IS NOT NULL) AS {column}"
    )


RELATIONS["customers_merged"] = f"""
SELECT master_customer_hk, {', '.join(
    f"min(customer_hk) FILTER (WHERE source_system = '{s}') AS {a}"
    for s, a in [('SAP', 'sap_customer_hk'), ('JDE', 'jde_customer_hk'), ('QAD', 'qad_customer_hk'), ('SALESFORCE', 'sfdc_account_hk')])},
  {', '.join(_best(c) for c in ('customer_name', 'industry', 'country_code', 'region', 'annual_revenue'))}
FROM identities GROUP BY master_customer_hk"""

RELATIONS["dim_customers"] = """
SELECT *, CASE WHEN annual_revenue > 1000000 THEN 'ENTERPRISE' WHEN annual_revenue > 100000 THEN 'MID_MARKET'
    WHEN annual_revenue IS NOT NULL THEN 'SMB' END AS segment,
  coalesce(annual_revenue > 1000000, FALSE) AS is_key_account FROM customers_merged"""

RELATIONS["dim_regions"] = (
    "SELECT n_nationkey + 1 AS region_sk, sha256(source_region || '|' || n_name) AS region_hk, "
    "source_region AS region_name, n_name AS sub_region, n_name AS country_code, source_system AS erp_system FROM geo"
)

RELATIONS["facts"] = """
SELECT o.order_hk, o.customer_hk, CAST(strftime(o.order_date, '%Y%m%d') AS INT) AS date_key, r.region_sk, o.order_date,
  o.order_type, o.order_status, o.currency_code, o.net_amount_orig, o.net_amount_usd, o.tax_amount_usd,
  coalesce(o.net_amount_usd, 0) + coalesce(o.tax_amount_usd, 0) AS total_amount_usd, o.discount_pct,
  o.source_system, o.source_region, o.source_batch_id, o.effective_from
FROM silver_orders o LEFT JOIN dim_regions r USING (country_code) WHERE NOT o.is_quarantined"""


def compose(check: str) -> str:
    """The check with the relations it uses, directly or not, as CTEs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in RELATIONS:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_name(name)

    def visit_name(name: str) -> None:
        if name not in order:
            visit_body = RELATIONS[name]
            for other in RELATIONS:
                if other != name and other not in order and re.search(rf"\b{other}\b", visit_body):
                    visit_name(other)
            order.append(name)

    visit(check)
    if not order:
        return check
    parts = ", ".join(f"{name} AS ({RELATIONS[name].strip()})" for name in order)
    return f"WITH {parts} {check.strip()}"
