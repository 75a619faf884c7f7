"""Product plans: measurements, trust, marketplace, contracts, masks, access."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.functions import policies
from tiermill.operators import catalog, runs
from tiermill.plans import oracle as q
from tiermill.plans.features import features_at
from tiermill.plans.gold import dim_customers, fact, identities, sales_view
from tiermill.plans.quality import log
from tiermill.plans.registry import plan
from tiermill.plans.silver import orders, sql_stamp, stamp
from tiermill.operators import products as published
from tiermill.session import stored_once
from tiermill.sources.bridge import AS_OF, REQUEST_STATUS_SQL, RUN_TS, Bronze

TIMES = [RUN_TS - timedelta(hours=24), RUN_TS - timedelta(hours=12), RUN_TS]

_FIELDS = [
    "product_id", "product_name", "product_version", "domain_name", "domain_owner_team", "description", "primary_view",
    "share_name", "slo_freshness_minutes", "slo_availability_pct", "slo_dq_completeness", "slo_dq_validity",
    "slo_dq_uniqueness", "access_classification", "required_role", "pii_present", "gdpr_applicable", "tags",
    "consumer_personas", "status",
]


def _sql_value(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (bool, int)) else f"'{value}'"


q.RELATIONS["data_products"] = (
    "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_sql_value(v) for v in row) + ")" for row in catalog.CATALOG)
    + f") t({', '.join(_FIELDS)})"
)


def _rate_sql(name: str, default: str) -> str:
    only = "" if name == "overall" else f" FILTER (WHERE dama_dimension = '{name.upper()}')"
    mean = q.mean_2dp(f"sum(pass_rate){only}", f"count(*){only}")
    return f"(SELECT CAST(coalesce(CASE WHEN count(*){only} > 0 THEN {mean} END, {default}) AS DECIMAL(5,2)) FROM dq_log_rows l WHERE l.run_timestamp BETWEEN m.t - INTERVAL 24 HOUR AND m.t)"


q.RELATIONS["sli_times"] = (
    "SELECT t, date_diff('minute', (SELECT max(effective_from) FROM silver_orders WHERE effective_from <= t), t) AS age, "
    + ", ".join(
        f"{_rate_sql(n, d)} AS {'overall_dq_score' if n == 'overall' else f'dq_{n}_pct'}" for n, d in catalog.DEFAULT_RATES.items()
    )
    + f" FROM (VALUES {', '.join(f'''(TIMESTAMP '{t}')''' for t in TIMES)}) m(t)"
)
RATES = [("overall_dq_score" if n == "overall" else f"dq_{n}_pct") for n in catalog.DEFAULT_RATES]
q.RELATIONS["sli_rows"] = (
    "SELECT product_id, t AS measurement_time, age AS data_age_minutes, age <= slo_freshness_minutes AS freshness_met, "
    f"{', '.join(RATES)}, age <= slo_freshness_minutes AS all_slos_met FROM data_products CROSS JOIN sli_times WHERE age IS NOT NULL"
)
q.RELATIONS["sli_latest"] = (
    "SELECT * FROM sli_rows WHERE (product_id, measurement_time) IN (SELECT (product_id, max(measurement_time)) FROM sli_rows GROUP BY product_id)"
)
q.RELATIONS["trust_rows"] = """
SELECT *, CASE WHEN trust_score >= 98 THEN 'GREEN' WHEN trust_score >= 95 THEN 'AMBER' ELSE 'RED' END AS trust_band
FROM (SELECT p.product_name, p.domain_name, p.domain_owner_team, p.slo_freshness_minutes, s.*,
  round(s.overall_dq_score * 0.7 + CASE WHEN s.freshness_met THEN 30 ELSE 15 END, 1) AS trust_score
  FROM data_products p JOIN sli_latest s USING (product_id) WHERE p.status = 'ACTIVE')"""
RATES_SQL = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in RATES)


def as_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def measurements(b: Bronze) -> DataFrame:
    """The measurement log that the scheduled run writes; its readers do not measure."""

    def run(path: str) -> None:
        runs.sli_run(catalog.measure(catalog.table(b.spark), orders(b), log(b), TIMES), path, RUN_TS)

    return b.spark.read.parquet(stored_once(b.spark, f"sli-log:{b.folder}", run)).drop("run_date", "run_id")


def trust(b: Bronze) -> DataFrame:
    return catalog.trust_scores(catalog.table(b.spark), measurements(b))


def listed(b: Bronze) -> DataFrame:
    return catalog.marketplace(catalog.table(b.spark), trust(b))


SLI_SQL = f"SELECT product_id, {sql_stamp('measurement_time')} AS measurement_time, data_age_minutes, freshness_met, {RATES_SQL}, all_slos_met FROM "


def sli_report(df: DataFrame) -> DataFrame:
    return as_double(df.drop("notes"), *RATES).withColumn("measurement_time", stamp("measurement_time"))


@plan("sli_measure", SLI_SQL + "sli_rows")
def sli_measure(b: Bronze) -> DataFrame:
    return sli_report(measurements(b))


@plan("latest_sli", SLI_SQL + "sli_latest")
def latest_sli(b: Bronze) -> DataFrame:
    return sli_report(catalog.latest(measurements(b)))


@plan(
    "trust_score",
    f"""SELECT product_id, product_name, domain_name, domain_owner_team, slo_freshness_minutes, data_age_minutes, freshness_met,
      {RATES_SQL}, CAST(trust_score AS DOUBLE) AS trust_score, trust_band FROM trust_rows""",
)
def trust_score(b: Bronze) -> DataFrame:
    return as_double(trust(b).drop("status", "measurement_time", "all_slos_met", "notes"), *RATES, "trust_score")


q.RELATIONS["market_rows"] = """
SELECT p.product_id, p.product_name, p.product_version, p.domain_name, p.domain_owner_team, p.description, p.primary_view AS full_address,
  p.share_name, CAST(p.slo_freshness_minutes AS VARCHAR) || ' min freshness' AS freshness_sla, p.slo_availability_pct || '% availability' AS availability_sla,
  p.slo_dq_completeness || '% completeness' AS dq_completeness_sla, CAST(t.trust_score AS DOUBLE) AS trust_score, t.trust_band,
  t.data_age_minutes AS current_data_age_minutes, CAST(t.overall_dq_score AS DOUBLE) AS current_dq_score, p.access_classification, p.required_role,
  p.pii_present, p.gdpr_applicable, p.tags, p.consumer_personas, p.status, 'SELECT * FROM ' || p.primary_view AS sql_access_example
FROM data_products p LEFT JOIN trust_rows t USING (product_id) WHERE p.status = 'ACTIVE'"""


@plan("marketplace", "SELECT * FROM market_rows")
def marketplace(b: Bronze) -> DataFrame:
    return as_double(listed(b), "trust_score", "current_dq_score")


@plan(
    "marketplace_card",
    """SELECT product_id, product_name, domain_name AS domain, description, domain_owner_team AS owner_team, trust_score,
      freshness_sla AS freshness_label, access_classification AS access_tier,
      CAST(split_part(replace(availability_sla, '%', ''), ' ', 1) AS DOUBLE) AS sla_availability,
      replace(tags, ',', '|') AS tags, share_name IS NOT NULL AS share_available,
      CAST(current_data_age_minutes AS VARCHAR) AS last_updated FROM market_rows WHERE product_id = 'DP-002'""",
)
def marketplace_card(b: Bronze) -> DataFrame:
    shaped = catalog.card(catalog.lookup(listed(b), "DP-002"))
    return shaped.withColumn("tags", F.array_join("tags", "|"))


@plan(
    "persona_search",
    "SELECT product_id, product_name, domain_name, trust_score, trust_band, freshness_sla FROM market_rows WHERE consumer_personas LIKE '%ML_ENGINEER%'",
)
def persona_search(b: Bronze) -> DataFrame:
    hits = catalog.for_persona(listed(b), "ML_ENGINEER")
    return as_double(hits.select("product_id", "product_name", "domain_name", "trust_score", "trust_band", "freshness_sla"), "trust_score")


@plan(
    "product_search",
    "SELECT product_id, product_name, domain_name, trust_score FROM market_rows WHERE lower(product_name || ' ' || description || ' ' || domain_name || ' ' || tags) LIKE '%churn%'",
)
def product_search(b: Bronze) -> DataFrame:
    hits = catalog.find(listed(b), "CHURN")
    return as_double(hits.select("product_id", "product_name", "domain_name", "trust_score"), "trust_score")


@plan(
    "platform_metrics",
    """SELECT (SELECT count(*) FROM market_rows) AS total_products,
      (SELECT CAST(sum(trust_score) AS DOUBLE) / count(*) FROM trust_rows) AS avg_trust_score,
      (SELECT count(*) FROM facts) AS total_rows""",
)
def platform_metrics(b: Bronze) -> DataFrame:
    rows = fact(b).select(F.count("*")).scalar()
    score = F.col("trust_score")
    return listed(b).agg(
        F.count("*").alias("total_products"),
        (F.sum(score).cast("double") / F.count(score)).alias("avg_trust_score"),
    ).withColumn("total_rows", rows)


@plan(
    "contract_check",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT 'DP-001' AS product_id, '{f.name}' AS column_name, TRUE AS is_present, TRUE AS type_matches, "
        + (f"count(*) FILTER (WHERE {f.name} IS NULL)" if not f.nullable else "count(*) * 0")
        + " AS null_violations FROM sales_view_rows"
        for f in catalog.CONTRACTS["DP-001"]
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'DP-002', '{f.name}', TRUE, TRUE, " + (f"count(*) FILTER (WHERE {f.name} IS NULL)" if not f.nullable else "count(*) * 0")
        + " FROM customer_360_rows"
        for f in catalog.CONTRACTS["DP-002"]
    )
    + ")",
)
def contract_check(b: Bronze) -> DataFrame:
    sales = catalog.check_contract(sales_view(b), "DP-001", catalog.CONTRACTS["DP-001"])
    people = catalog.check_contract(customer_360(b), "DP-002", catalog.CONTRACTS["DP-002"])
    return sales.unionByName(people)


def customer_360(b: Bronze) -> DataFrame:
    return published.customer_360(dim_customers(b), identities(b), features_at(b, AS_OF))


CENTS, SCORES = ["rev_l30d_usd", "rev_l90d_usd", "rev_l365d_usd"], ["churn_risk_score", "upsell_propensity"]
CENTS_SQL = ", ".join(f"CAST(round({c}, 2) AS DOUBLE) AS {c}" for c in CENTS)
SCORES_SQL = ", ".join(f"CAST(CAST({c} AS DECIMAL(5,4)) AS DOUBLE) AS {c}" for c in SCORES)
q.RELATIONS["customer_360_rows"] = (
    f"SELECT p.customer_hk, d.customer_name, {q.AS_OF} AS as_of_date, d.industry, d.region, d.segment, p.churn_risk_score, "
    "p.upsell_propensity, p.rev_l30d_usd, p.rev_l90d_usd, p.rev_l365d_usd, p.days_since_last_order "
    "FROM pit_rows p JOIN identities i USING (customer_hk) JOIN dim_customers d USING (master_customer_hk)"
)


@plan(
    "product_customer_360",
    f"""SELECT customer_hk, customer_name, industry, region, segment, {CENTS_SQL}, {SCORES_SQL}, days_since_last_order, as_of_date
      FROM customer_360_rows""",
)
def product_customer_360(b: Bronze) -> DataFrame:
    """The product's output view with all its columns, in their promised types; decimals are compared as numbers."""
    return as_double(customer_360(b), *CENTS, *SCORES)


q.RELATIONS["sales_view_rows"] = (
    "SELECT f.*, d.year_number, d.quarter_name, r.region_name, r.country_code FROM facts f "
    "LEFT JOIN dim_dates d USING (date_key) LEFT JOIN dim_regions r USING (region_sk)"
)


@plan(
    "access_summary",
    f"""SELECT product_id, count(*) AS total_requests, count(*) FILTER (WHERE s = 'APPROVED') AS approved,
      count(*) FILTER (WHERE s = 'PENDING') AS pending, count(*) FILTER (WHERE s = 'REJECTED') AS rejected,
      {sql_stamp('max(ts)')} AS last_request
      FROM (SELECT 'DP-00' || CAST(user_id % 4 + 1 AS VARCHAR) AS product_id, {REQUEST_STATUS_SQL} AS s, ts FROM events) GROUP BY product_id""",
)
def access_summary(b: Bronze) -> DataFrame:
    return catalog.access_summary(b.access_requests()).withColumn("last_request", stamp("last_request"))


@plan(
    "dq_triage",
    """SELECT product_id, product_name, domain_owner_team, CAST(trust_score AS DOUBLE) AS trust_score,
      CASE WHEN trust_score < 85 THEN 'HIGH' WHEN trust_score < 90 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
      worst.d AS failing_dimension, CAST(worst.r AS DOUBLE) AS failing_rate, w.batch_id AS worst_batch, w.source_system AS worst_source
      FROM (SELECT *, list_min([{'r': dq_completeness_pct, 'd': 'COMPLETENESS'}, {'r': dq_uniqueness_pct, 'd': 'UNIQUENESS'},
        {'r': dq_validity_pct, 'd': 'VALIDITY'}, {'r': dq_accuracy_pct, 'd': 'ACCURACY'}, {'r': dq_consistency_pct, 'd': 'CONSISTENCY'},
        {'r': dq_timeliness_pct, 'd': 'TIMELINESS'}]) AS worst FROM trust_rows WHERE trust_score < 95)
      CROSS JOIN (SELECT batch_id, source_system FROM dq_log_rows GROUP BY 1, 2 ORDER BY CAST(sum(pass_rate) AS DOUBLE) / count(*), batch_id, source_system LIMIT 1) w""",
)
def dq_triage(b: Bronze) -> DataFrame:
    """Failing products with the dimension and the batch to look at first."""
    found = as_double(catalog.triage(trust(b)), "trust_score", "failing_rate")
    mean = F.sum("pass_rate").cast("double") / F.count("*")
    worst = log(b).groupBy("batch_id", "source_system").agg(F.struct(mean.alias("rate"), "batch_id", "source_system").alias("w"))
    first = worst.select(F.min("w")).scalar()
    return found.withColumn("_w", first).select("*", F.col("_w.batch_id").alias("worst_batch"), F.col("_w.source_system").alias("worst_source")).drop("_w")


# -- masks and row access ---------------------------------------------------------------


@plan(
    "mask_pii",
    "SELECT customer_id, phone AS for_exec, sha256(phone) AS for_ml_engineer, '***-MASKED-***' AS for_analyst FROM bronze_customers",
)
def mask_pii(b: Bronze) -> DataFrame:
    phone = F.col("phone")
    return b.customers().select(
        "customer_id",
        policies.mask_pii(phone, {policies.EXEC}).alias("for_exec"),
        policies.mask_pii(phone, {policies.ML_ENGINEER}).alias("for_ml_engineer"),
        policies.mask_pii(phone, {policies.ANALYST}).alias("for_analyst"),
    )


@plan(
    "mask_email",
    "SELECT customer_id, email AS for_admin, '****@' || split_part(email, '@', 2) AS for_analyst, '****@unknown' AS for_missing FROM bronze_customers",
)
def mask_email(b: Bronze) -> DataFrame:
    email = F.col("email")
    return b.customers().select(
        "customer_id",
        policies.mask_email(email, {policies.ADMIN}).alias("for_admin"),
        policies.mask_email(email, {policies.ANALYST}).alias("for_analyst"),
        policies.mask_email(F.lit(None).cast("string"), {policies.ANALYST}).alias("for_missing"),
    )


@plan(
    "mask_number",
    "SELECT customer_id, CAST(credit_limit AS DOUBLE) AS for_finance, CAST(-1 AS DOUBLE) AS for_analyst FROM bronze_customers",
)
def mask_number(b: Bronze) -> DataFrame:
    limit = F.col("credit_limit")
    return b.customers().select(
        "customer_id",
        policies.mask_financial(limit, {policies.FINANCE}).cast("double").alias("for_finance"),
        policies.mask_financial(limit, {policies.ANALYST}).cast("double").alias("for_analyst"),
    )


@plan(
    "masked_customers",
    """SELECT source_system, customer_id, sha256(phone) AS phone,
      CASE WHEN source_system = 'SAP' THEN '****@' || split_part(email, '@', 2) ELSE email END AS email,
      CASE WHEN source_system = 'QAD' THEN CAST(credit_limit AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS credit_limit FROM bronze_customers""",
)
def masked_customers(b: Bronze) -> DataFrame:
    """Each source's customers under its own bindings, as an ML engineer sees them."""
    people = b.customers().select("source_system", "customer_id", "phone", "email", "credit_limit")
    return as_double(policies.mask_sources(people, policies.BINDINGS, {policies.ML_ENGINEER}), "credit_limit")


@plan(
    "row_access",
    """SELECT 'GLOBAL_ANALYST' AS reader, source_region, count(*) AS n FROM silver_orders GROUP BY source_region
      UNION ALL SELECT 'SAP_EUROPE_READER', source_region, count(*) FROM silver_orders WHERE source_region = 'EUROPE' GROUP BY source_region
      UNION ALL SELECT 'SAP+JDE', source_region, count(*) FROM silver_orders WHERE source_region IN ('EUROPE', 'AMERICAS') GROUP BY source_region""",
)
def row_access(b: Bronze) -> DataFrame:
    readers = {
        "GLOBAL_ANALYST": {"GLOBAL_ANALYST"},
        "SAP_EUROPE_READER": {"SAP_EUROPE_READER"},
        "SAP+JDE": {"SAP_EUROPE_READER", "JDE_AMERICAS_READER"},
        "NOBODY": set(),
    }
    seen = orders(b).select("source_region", F.explode(policies.readable_by(readers)).alias("reader"))
    return seen.groupBy("reader", "source_region").agg(F.count("*").alias("n"))
