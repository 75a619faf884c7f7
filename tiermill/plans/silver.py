"""Silver plans: keys, conforming, pricing, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermill.functions.exact import money
from tiermill.functions.keys import attributes_text, hash_diff, hash_key
from tiermill.operators import gold, mapping, scd, silver
from tiermill.plans import oracle as q
from tiermill.plans.registry import plan
from tiermill.session import shared_dir
from tiermill.sources.bridge import Bronze
from tiermill.sources.tables import VersionedTable

STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp(column: str) -> Column:
    return F.date_format(column, STAMP)


def sql_stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


@plan(
    "hash_keys",
    f"""SELECT customer_id, source_system, {q.hk('source_system', 'customer_id')} AS customer_hk,
      {q.digest('customer_name', 'country_code', 'city', 'postal_code')} AS hash_diff FROM bronze_customers""",
)
def hash_keys(b: Bronze) -> DataFrame:
    parts = [F.col(c) for c in ("customer_name", "country_code", "city", "postal_code")]
    return b.customers().select(
        "customer_id",
        "source_system",
        hash_key(F.col("source_system"), F.col("customer_id")).alias("customer_hk"),
        hash_diff(attributes_text(*parts)).alias("hash_diff"),
    )


@plan(
    "ref_currency",
    f"""SELECT coalesce(currency_code, 'NONE') AS currency_code, coalesce(max(fx.rate), 1) AS fx_to_usd,
      max(fx.rate) IS NOT NULL AS has_rate, count(*) AS order_count, {q.money('sum(net_amount)')} AS net_amount
      FROM bronze_orders LEFT JOIN fx ON fx.code = currency_code GROUP BY currency_code""".replace(
        "coalesce(max(fx.rate), 1) AS fx_to_usd", "CAST(coalesce(max(fx.rate), 1) AS DOUBLE) AS fx_to_usd"
    ),
)
def ref_currency(b: Bronze) -> DataFrame:
    """The rate table against the currencies that orders really carry."""
    used = b.orders().groupBy("currency_code").agg(
        F.count("*").alias("order_count"), F.sum("net_amount").alias("net_amount")
    )
    known = silver.currency_table(b.spark).select(
        F.col("currency_code").alias("code"), "fx_to_usd"
    )
    return used.join(F.broadcast(known), F.col("currency_code") == F.col("code"), "left").select(
        F.coalesce("currency_code", F.lit("NONE")).alias("currency_code"),
        F.coalesce(F.col("fx_to_usd").cast("double"), F.lit(1.0)).alias("fx_to_usd"),
        F.col("fx_to_usd").isNotNull().alias("has_rate"),
        "order_count",
        money(F.col("net_amount")).alias("net_amount"),
    )


@plan(
    "fx_normalize",
    f"""SELECT order_id, currency_code, CAST(fx_rate AS DOUBLE) AS fx_rate,
      CAST(CAST(net_amount * fx_rate AS DECIMAL(18,4)) AS DOUBLE) AS net_amount_usd FROM priced_orders""",
)
def fx_normalize(b: Bronze) -> DataFrame:
    priced = silver.with_fx(b.orders())
    return priced.select(
        "order_id",
        "currency_code",
        F.col("fx_rate").cast("double").alias("fx_rate"),
        (F.col("net_amount") * F.col("fx_rate")).cast("decimal(18,4)").cast("double").alias("net_amount_usd"),
    )


@plan(
    "silver_customer",
    """SELECT customer_hk, source_system, source_region, original_id, customer_name, industry_code, country_code, city,
      postal_code, CAST(credit_limit_usd AS DOUBLE) AS credit_limit_usd, dq_completeness_score, hash_diff FROM silver_customers""",
)
def silver_customer(b: Bronze) -> DataFrame:
    return silver.customers(b.customers()).select(
        "customer_hk", "source_system", "source_region", "original_id", "customer_name", "industry_code",
        "country_code", "city", "postal_code",
        F.col("credit_limit_usd").cast("double").alias("credit_limit_usd"),
        "dq_completeness_score", "hash_diff",
    )


q.RELATIONS["landed_customers"] = """SELECT * REPLACE (CASE WHEN source_system = 'QAD' THEN NULL ELSE postal_code END AS postal_code,
  CASE WHEN source_system = 'SAP' THEN industry_code END AS industry_code) FROM bronze_customers"""


@plan(
    "silver_customer_all",
    f"""SELECT {q.hk('source_system', 'customer_id')} AS customer_hk, source_system, source_region, customer_id AS original_id, industry_code, postal_code,
      20 * (1 + CAST(customer_name IS NOT NULL AS INT) + CAST(country_code IS NOT NULL AS INT)
        + CAST(city IS NOT NULL AS INT) + CAST(postal_code IS NOT NULL AS INT)) AS dq_completeness_score,
      {q.digest('customer_name', 'country_code', 'city', 'postal_code')} AS hash_diff FROM landed_customers""",
)
def silver_customer_all(b: Bronze) -> DataFrame:
    """Customers of three sources, each from its own landing columns."""
    rows = b.customers()
    of = lambda source, *columns: rows.where(F.col("source_system") == source).select(*columns, "load_timestamp", "batch_id")
    common = ["customer_id", "customer_name", "city", "country_code", "phone", "credit_limit", "payment_terms"]
    sap = silver.conform_sap_customers(of("SAP", *common, "postal_code", "email", "industry_code"))
    jde = silver.conform_jde_customers(of("JDE", *common, F.col("postal_code").alias("zip_code")))
    qad = silver.conform_qad_customers(of("QAD", *common))
    return silver.customers(sap.unionByName(jde).unionByName(qad)).select(
        "customer_hk", "source_system", "source_region", "original_id", "industry_code", "postal_code",
        "dq_completeness_score", "hash_diff",
    )


ORDER_SQL = f"""SELECT order_hk, customer_hk, source_system, source_region, original_id, order_date, order_status, currency_code,
  CAST(net_amount_orig AS DOUBLE) AS net_amount_orig, CAST(net_amount_usd AS DOUBLE) AS net_amount_usd,
  CAST(tax_amount_usd AS DOUBLE) AS tax_amount_usd, CAST(discount_pct AS DOUBLE) AS discount_pct, is_quarantined, hash_diff,
  {sql_stamp('effective_from')} AS effective_from, source_batch_id FROM silver_orders"""


def order_report(orders: DataFrame) -> DataFrame:
    wide = [F.col(c).cast("double").alias(c) for c in ("net_amount_orig", "net_amount_usd", "tax_amount_usd", "discount_pct")]
    return orders.select(
        "order_hk", "customer_hk", "source_system", "source_region", "original_id", "order_date", "order_status",
        "currency_code", *wide, "is_quarantined", "hash_diff", stamp("effective_from").alias("effective_from"),
        "source_batch_id",
    )


@plan("silver_order", ORDER_SQL + " WHERE source_system = 'SAP'")
def silver_order(b: Bronze) -> DataFrame:
    return order_report(silver.orders(silver.conform_sap_orders(b.sap_orders())))


MIXED_SQL = """(SELECT order_id, net_amount, CAST(round(net_amount * 0.25, 4) AS DECIMAL(18,4)) AS quarter, currency_code AS first,
  CASE WHEN CAST(order_id AS BIGINT) % 7 = 0 THEN 'GBP' ELSE currency_code END AS second FROM bronze_orders WHERE source_system = 'JDE')"""


@plan(
    "silver_jde_mixed",
    f"""SELECT order_id, first <> second AND first IS NOT NULL AND second IS NOT NULL AS is_mixed,
      CASE WHEN first <> second THEN 'USD' ELSE coalesce(first, second) END AS currency_code,
      CAST(CASE WHEN first <> second THEN round(quarter * coalesce(a.rate, 1), 4) + round((net_amount - quarter) * coalesce(z.rate, 1), 4)
        ELSE net_amount END AS DOUBLE) AS net_amount
      FROM {MIXED_SQL} LEFT JOIN fx a ON a.code = first LEFT JOIN fx z ON z.code = second""",
)
def silver_jde_mixed(b: Bronze) -> DataFrame:
    """Line-level orders of which some have a second line in another currency: those are added up in USD, and listed."""
    other = (F.col("line_number") == 2) & (F.col("order_id").cast("bigint") % 7 == 0)
    lines_ = b.jde_order_lines().withColumn("currency_code", F.when(other, "GBP").otherwise(F.col("currency_code")))
    mixed = silver.mixed_currency_orders(lines_).select(F.col("order_id").alias("mixed_id"))
    heads = silver.conform_jde_orders(lines_).join(mixed, F.col("order_id") == F.col("mixed_id"), "left")
    return heads.select(
        "order_id", F.col("mixed_id").isNotNull().alias("is_mixed"), "currency_code", F.col("net_amount").cast("double").alias("net_amount")
    )


def all_sources(b: Bronze) -> DataFrame:
    """Headers of the three source feeds, each in its own landing shape."""
    return silver.union_orders(
        silver.conform_sap_orders(b.sap_orders()),
        silver.conform_jde_orders(b.jde_order_lines()),
        silver.conform_qad_orders(b.qad_orders()),
    )


@plan("silver_order_all", ORDER_SQL)
def silver_order_all(b: Bronze) -> DataFrame:
    return order_report(silver.orders(all_sources(b)))


@plan(
    "silver_order_line",
    """SELECT line_hk, source_system, original_order_id, line_number, order_hk, product_hk, CAST(quantity AS DOUBLE) AS quantity,
      CAST(unit_price_usd AS DOUBLE) AS unit_price_usd, CAST(line_amount_usd AS DOUBLE) AS line_amount_usd,
      CAST(discount_pct AS DOUBLE) AS discount_pct, line_status FROM silver_lines""",
)
def silver_order_line(b: Bronze) -> DataFrame:
    return lines(b).select(
        "line_hk", "source_system", "original_order_id", "line_number", "order_hk", "product_hk",
        *[F.col(c).cast("double").alias(c) for c in ("quantity", "unit_price_usd", "line_amount_usd", "discount_pct")],
        "line_status",
    )


def orders(b: Bronze, before=None) -> DataFrame:
    """Silver orders of all sources in one scan of the headers."""
    return silver.orders(b.orders(before))


def lines(b: Bronze) -> DataFrame:
    return silver.order_lines(b.order_items(), orders(b))


@plan(
    "silver_line_orphans",
    """SELECT 'X' || CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS line_item, CAST(l_partkey AS VARCHAR) AS product_code,
      'ORDER_NOT_FOUND' AS rejection_reason FROM lineitem WHERE l_orderkey % 67 = 0""",
)
def silver_line_orphans(b: Bronze) -> DataFrame:
    """Items whose header never came."""
    waiting = silver.orphan_lines(b.order_items(), orders(b))
    return waiting.select("order_id", "line_item", "product_code", "rejection_reason")


@plan(
    "silver_product",
    f"""SELECT {q.hk("'SAP'", 'p_partkey')} AS product_hk, CAST(p_partkey AS VARCHAR) AS product_code, p_name AS product_name,
      p_type AS product_family, p_brand AS product_line, p_retailprice AS list_price_usd,
      {q.digest('p_name', 'p_type', 'p_brand', 'CAST(p_retailprice AS DECIMAL(18,4))')} AS hash_diff FROM part""",
)
def silver_product(b: Bronze) -> DataFrame:
    return silver.products(b.products()).select(
        "product_hk", "product_code", "product_name", "product_family", "product_line",
        F.col("list_price_usd").cast("double").alias("list_price_usd"), "hash_diff",
    )


@plan(
    "silver_opportunity",
    f"""SELECT {q.hk("'SALESFORCE'", "'OPP-' || CAST(event_id AS VARCHAR)")} AS opp_hk, i.master_customer_hk AS customer_hk,
      {q.br.STAGE_SQL} AS stage_name, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount_usd,
      CAST(ts AS DATE) + 30 AS close_date, event_type = 'purchase' AS is_won, event_type IN ('purchase', 'error') AS is_closed
      FROM events LEFT JOIN identities i ON i.source_system = 'SALESFORCE' AND i.original_id = 'ACC-' || CAST(user_id AS VARCHAR)""",
)
def silver_opportunity(b: Bronze) -> DataFrame:
    identified = gold.identity(silver.customers(b.customers()), b.accounts())
    return silver.opportunities(b.opportunities(), identified).select(
        "opp_hk", "customer_hk", "stage_name", F.col("amount_usd").cast("double").alias("amount_usd"),
        "close_date", "is_won", "is_closed",
    )


# -- versions -------------------------------------------------------------------

HISTORY = ["customer_hk", "effective_from", "city", "hash_diff"]
VERSIONS_SQL = f"""SELECT customer_hk, city, hash_diff, {sql_stamp('effective_from')} AS effective_from,
  {sql_stamp('effective_to')} AS effective_to, is_current, CAST(record_version AS INT) AS record_version FROM customer_versions"""


def customer_load(b: Bronze, load: int) -> DataFrame:
    return silver.customers(b.customer_load(load)).select(HISTORY)


def version_report(versions: DataFrame) -> DataFrame:
    return versions.select(
        "customer_hk", "city", "hash_diff", stamp("effective_from").alias("effective_from"),
        stamp("effective_to").alias("effective_to"), "is_current", "record_version",
    )


@plan("scd2_build", VERSIONS_SQL)
def scd2_build(b: Bronze) -> DataFrame:
    loads = customer_load(b, 1).unionByName(customer_load(b, 2)).unionByName(customer_load(b, 3))
    return version_report(scd.build(loads, "customer_hk"))


@plan("scd2_apply", VERSIONS_SQL)
def scd2_apply(b: Bronze) -> DataFrame:
    """Two loads stored as versions; only the rows of the third that are new or changed are applied to their parts."""
    table = VersionedTable(b.spark, shared_dir(b.spark, "customer-versions"), "customer_hk", rows_per_part=20_000)
    table.refresh(customer_load(b, 1).unionByName(customer_load(b, 2)), 1)
    table.refresh(customer_load(b, 3), 2)
    return version_report(table.read())


# A third of all rows is one key's, all within March 1995.
BUSY = "CASE WHEN l_orderkey % 3 = 0 THEN 'busy' ELSE concat('S', CAST(l_suppkey AS STRING)) END"
BUSY_SECOND = "(l_orderkey * 8 + l_linenumber) % 2592000"


@plan(
    "scd2_hot_key",
    f"""SELECT line_key, {sql_stamp('moment')} AS effective_from, hash_diff, {sql_stamp('lead(moment) OVER w')} AS effective_to,
      lead(moment) OVER w IS NULL AS is_current, CAST(row_number() OVER w AS INT) AS record_version
    FROM (SELECT *, lag(hash_diff) OVER w AS before
      FROM (SELECT {BUSY} AS line_key, TIMESTAMP '1995-03-01' + to_seconds(CAST({BUSY_SECOND} AS BIGINT)) AS moment,
        max(l_returnflag || l_linestatus) AS hash_diff FROM lineitem GROUP BY ALL)
      WINDOW w AS (PARTITION BY line_key ORDER BY moment) QUALIFY before IS NULL OR before <> hash_diff)
    WINDOW w AS (PARTITION BY line_key ORDER BY moment)""",
)
def scd2_hot_key(b: Bronze) -> DataFrame:
    """Versions of line states, one key having a third of all rows within one month."""
    rows = b.table("lineitem").select(
        F.expr(BUSY).alias("line_key"),
        F.expr(f"timestampadd(SECOND, {BUSY_SECOND}, TIMESTAMP '1995-03-01')").alias("effective_from"),
        F.concat("l_returnflag", "l_linestatus").alias("hash_diff"),
    )
    versions = scd.build(rows, "line_key", most=1_000)
    ends = F.when(~F.col("is_current"), F.col("effective_to"))
    return versions.withColumns({"effective_from": stamp("effective_from"), "effective_to": stamp(ends)})


# -- configured mapping -----------------------------------------------------------

MAPPING = [
    mapping.Rule(1, "order_id", "original_id", "trim(order_id)", "string"),
    mapping.Rule(2, "order_date", "order_year", "year(order_date)", "int"),
    mapping.Rule(3, "net_amount", "net_amount", None, "decimal(18,4)"),
    mapping.Rule(4, "currency_code", "currency_code", "upper(coalesce(currency_code, 'USD'))", "string"),
    mapping.Rule(5, "order_type", "legacy_type", None, "string", active=False),
]


@plan(
    "stt_apply",
    """SELECT trim(order_id) AS original_id, CAST(year(order_date) AS INT) AS order_year, CAST(net_amount AS DOUBLE) AS net_amount,
      upper(coalesce(currency_code, 'USD')) AS currency_code FROM bronze_orders""",
)
def stt_apply(b: Bronze) -> DataFrame:
    mapped = mapping.apply(b.orders(), MAPPING)
    return mapped.withColumn("net_amount", F.col("net_amount").cast("double"))
