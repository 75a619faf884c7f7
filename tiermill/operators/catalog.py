"""Data product catalog: service measurements, trust, marketplace, contracts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiermill.functions.dates import boundaries
from tiermill.functions.exact import mean_2dp
from tiermill.functions.text import contains_any, leading_percent, split_tags
from tiermill.reference import inline_table

# Identity, service targets, access and discovery fields per product.
CATALOG = [
    ("DP-001", "Sales Performance", "v1", "Sales", "Sales Operations Team",
     "Sales orders of all source systems in one place, by region and period.",
     "SALES_PERFORMANCE.SALES_ORDERS_V1", "SALES_PERFORMANCE_SHARE", 15, "99.50", "99.00", "99.00", "100.00",
     "INTERNAL", "GLOBAL_ANALYST", False, False,
     "sales,revenue,orders,ERP,SAP,JDE,QAD,regional", "DATA_ANALYST,FINANCE_ANALYST,EXECUTIVE", "ACTIVE"),
    ("DP-002", "Customer 360", "v1", "Sales", "CRM & Customer Intelligence Team",
     "One customer master over all sources, with revenue history, churn risk and upsell scores.",
     "CUSTOMER_360.CUSTOMERS_V1", "CUSTOMER_360_SHARE", 5, "99.90", "99.50", "99.00", "100.00",
     "INTERNAL", "GLOBAL_ANALYST", False, True,
     "customer,360,churn,upsell,ML,CRM,Salesforce,features", "ML_ENGINEER,DATA_ANALYST,SALES_REP", "ACTIVE"),
    ("DP-003", "Revenue Analytics", "v1", "Finance", "Finance & FP&A Team",
     "Revenue by product, source and period for planning and reporting.",
     "REVENUE_ANALYTICS.MONTHLY_REVENUE_V1", None, 60, "99.50", "99.00", "99.50", "100.00",
     "INTERNAL", "FINANCE_ANALYST", False, False,
     "revenue,finance,FP&A,monthly,product-family,P&L", "FINANCE_ANALYST,EXECUTIVE", "ACTIVE"),
    ("DP-004", "Opportunity Signals", "v1", "Revenue Operations", "RevOps & Sales Intelligence Team",
     "Prediction scores for accounts and deals, refreshed continuously.",
     "OPPORTUNITY_SIGNALS.PREDICTIONS_V1", None, 2, "99.90", "98.00", "99.00", "100.00",
     "INTERNAL", "GLOBAL_ANALYST", False, False,
     "ML,predictions,churn,upsell,opportunities,real-time,RevOps", "ML_ENGINEER,DATA_ANALYST,SALES_REP", "ACTIVE"),
]

# Averages assumed when the log has no recent row of a dimension.
DEFAULT_RATES = {
    "completeness": "99.9", "validity": "99.9", "uniqueness": "100.0", "accuracy": "98.8",
    "consistency": "100.0", "timeliness": "94.8", "overall": "98.9",
}
# Trust weights and bands.
GREEN_FROM, AMBER_FROM, ALERT_BELOW = 98, 95, 95


def table(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark,
        CATALOG,
        "product_id string; product_name string; product_version string; domain_name string; "
        "domain_owner_team string; description string; primary_view string; share_name string; "
        "slo_freshness_minutes int; slo_availability_pct decimal(5,2); slo_dq_completeness decimal(5,2); "
        "slo_dq_validity decimal(5,2); slo_dq_uniqueness decimal(5,2); access_classification string; "
        "required_role string; pii_present boolean; gdpr_applicable boolean; tags string; "
        "consumer_personas string; status string",
    )


# -- service level measurements --------------------------------------------------


def data_age(orders: DataFrame, times: list[datetime]) -> DataFrame:
    """Newest row and age in minute boundaries at each time, from one aggregation."""
    newest = [F.max(F.when(F.col("effective_from") <= F.lit(t), F.col("effective_from"))).alias(f"_{i}") for i, t in enumerate(times)]
    pairs = [F.struct(F.lit(t).alias("measurement_time"), F.col(f"_{i}").alias("newest")) for i, t in enumerate(times)]
    rows = orders.agg(*newest).select(F.inline(F.array(*pairs))).where(F.col("newest").isNotNull())
    return rows.select(
        "measurement_time", boundaries("minute", F.col("newest"), F.col("measurement_time")).alias("data_age_minutes")
    )


def recent_rates(log: DataFrame, times: list[datetime]) -> DataFrame:
    """Mean pass rate per dimension over the 24 hours up to each time."""
    at = F.col("run_timestamp")
    day = timedelta(hours=24)
    open_at = F.filter(F.array(*[F.lit(t) for t in times]), lambda t: (at >= t - F.lit(day)) & (at <= t))
    rows = log.select("dama_dimension", "pass_rate", F.explode(open_at).alias("measurement_time"))

    def mean_of(name: str) -> Column:
        rate = F.col("pass_rate") if name == "overall" else F.when(F.col("dama_dimension") == name.upper(), F.col("pass_rate"))
        return mean_2dp(F.sum(rate), F.count(rate)).cast("decimal(5,2)").alias(name)

    return rows.groupBy("measurement_time").agg(*[mean_of(n) for n in DEFAULT_RATES])


def measure(catalog: DataFrame, orders: DataFrame, log: DataFrame, times: list[datetime]) -> DataFrame:
    """Service measurements of every active product at each time.

    Orders and log are reduced to one row per time before they meet the
    catalog, so nothing is multiplied by the number of orders.
    """
    state = data_age(orders, times).join(recent_rates(log, times), "measurement_time", "left")
    due = catalog.where(F.col("status") == "ACTIVE").select(
        "product_id", "slo_freshness_minutes", F.explode(F.array(*[F.lit(t) for t in times])).alias("measurement_time")
    )
    fresh = F.col("data_age_minutes") <= F.col("slo_freshness_minutes")
    rates = [
        F.coalesce(n, F.lit(default).cast("decimal(5,2)")).alias("overall_dq_score" if n == "overall" else f"dq_{n}_pct")
        for n, default in DEFAULT_RATES.items()
    ]
    return due.join(state, "measurement_time").select(
        "product_id", "measurement_time", "data_age_minutes", fresh.alias("freshness_met"), *rates,
        fresh.alias("all_slos_met"), F.lit("Auto SLI measurement").alias("notes"),
    )


def latest(sli: DataFrame) -> DataFrame:
    """Newest measurement of each product; equal times are all kept.

    The newest time per product comes from a combinable maximum, because a
    window per product would hold a whole product's log in one task.
    """
    newest = sli.groupBy("product_id").agg(F.max("measurement_time").alias("measurement_time"))
    return sli.join(newest, ["product_id", "measurement_time"], "left_semi")


# -- trust and marketplace -----------------------------------------------------------


def trust_value(score: Column, fresh: Column) -> Column:
    freshness = F.when(fresh, F.lit(30)).otherwise(F.lit(15)).cast("decimal(5,2)")
    return F.round(score * F.lit("0.7").cast("decimal(2,1)") + freshness, 1).cast("decimal(5,1)")


def trust_band(score: Column) -> Column:
    return F.when(score >= GREEN_FROM, "GREEN").when(score >= AMBER_FROM, "AMBER").otherwise("RED")


def trust_scores(catalog: DataFrame, sli: DataFrame) -> DataFrame:
    score = trust_value(F.col("overall_dq_score"), F.col("freshness_met"))
    active = catalog.where(F.col("status") == "ACTIVE").select(
        "product_id", "product_name", "domain_name", "domain_owner_team", "slo_freshness_minutes", "status"
    )
    return active.join(latest(sli), "product_id").withColumn("trust_score", score).withColumn(
        "trust_band", trust_band(F.col("trust_score"))
    )


def marketplace(catalog: DataFrame, trust: DataFrame) -> DataFrame:
    """What a consumer browses: address, service promises, trust, tags."""
    scored = trust.select("product_id", "trust_score", "trust_band", "data_age_minutes", "overall_dq_score")
    text = lambda c, words: F.concat(F.col(c).cast("string"), F.lit(words))
    return (
        catalog.where(F.col("status") == "ACTIVE")
        .join(scored, "product_id", "left")
        .select(
            "product_id", "product_name", "product_version", "domain_name", "domain_owner_team", "description",
            F.col("primary_view").alias("full_address"), "share_name",
            text("slo_freshness_minutes", " min freshness").alias("freshness_sla"),
            text("slo_availability_pct", "% availability").alias("availability_sla"),
            text("slo_dq_completeness", "% completeness").alias("dq_completeness_sla"),
            "trust_score", "trust_band",
            F.col("data_age_minutes").alias("current_data_age_minutes"),
            F.col("overall_dq_score").alias("current_dq_score"),
            "access_classification", "required_role", "pii_present", "gdpr_applicable", "tags", "consumer_personas", "status",
            F.concat(F.lit("SELECT * FROM "), "primary_view").alias("sql_access_example"),
        )
        .orderBy("domain_name", "product_name")
    )


def card(listed: DataFrame) -> DataFrame:
    """Marketplace rows shaped for display: parsed tags and availability."""
    return listed.select(
        "product_id", "product_name", F.col("domain_name").alias("domain"), "description",
        F.col("domain_owner_team").alias("owner_team"), F.col("trust_score").cast("double").alias("trust_score"),
        F.col("freshness_sla").alias("freshness_label"), F.col("access_classification").alias("access_tier"),
        leading_percent(F.col("availability_sla")).alias("sla_availability"), split_tags(F.col("tags")).alias("tags"),
        F.col("share_name").isNotNull().alias("share_available"),
        F.col("current_data_age_minutes").cast("string").alias("last_updated"),
    )


def find(listed: DataFrame, query: str) -> DataFrame:
    """Keyword search over names, descriptions, domains and tags, best trust first."""
    fields = [F.col(c) for c in ("product_name", "description", "domain_name", "tags")]
    return listed.where((F.col("status") == "ACTIVE") & contains_any(query, *fields)).orderBy(F.desc("trust_score"))


def for_persona(listed: DataFrame, persona: str) -> DataFrame:
    return listed.where(F.contains("consumer_personas", F.lit(persona))).orderBy(F.desc("trust_score"), "product_id")


def lookup(listed: DataFrame, product_id: str) -> DataFrame:
    return listed.where(F.col("product_id") == product_id)


# -- output contracts ------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = True


# The columns two products promise to their consumers.
CONTRACTS = {
    "DP-001": [
        Field("order_hk", "string", False), Field("customer_hk", "string", False), Field("order_date", "date", False),
        Field("order_type", "string"), Field("order_status", "string"), Field("currency_code", "string", False),
        Field("net_amount_usd", "decimal(18,4)", False), Field("source_system", "string", False),
        Field("source_region", "string", False), Field("region_name", "string"), Field("country_code", "string"),
        Field("year_number", "int", False), Field("quarter_name", "string", False),
    ],
    "DP-002": [
        Field("customer_hk", "string", False), Field("customer_name", "string", False), Field("industry", "string"),
        Field("region", "string"), Field("segment", "string"), Field("rev_l30d_usd", "decimal(18,2)"),
        Field("rev_l90d_usd", "decimal(18,2)"), Field("rev_l365d_usd", "decimal(18,2)"),
        Field("churn_risk_score", "decimal(5,4)"), Field("upsell_propensity", "decimal(5,4)"),
        Field("days_since_last_order", "int"), Field("as_of_date", "date", False),
    ],
}


def check_contract(view: DataFrame, product_id: str, contract: list[Field]) -> DataFrame:
    """One row per promised column: present, right type, NULLs where none may be."""
    kinds = {f.name: f.dataType for f in view.schema}
    nulls = [
        F.count_if(F.col(f.name).isNull()).alias(f"_{i}")
        for i, f in enumerate(contract)
        if f.name in kinds and not f.nullable
    ]
    counted = {f"_{i}" for i, f in enumerate(contract) if f.name in kinds and not f.nullable}

    def row(i: int, field: Field) -> Column:
        present = field.name in kinds
        same = present and kinds[field.name] == T.DataType.fromDDL(field.kind)
        broken = F.col(f"_{i}") if f"_{i}" in counted else F.lit(0).cast("bigint")
        return F.struct(
            F.lit(product_id).alias("product_id"), F.lit(field.name).alias("column_name"),
            F.lit(present).alias("is_present"), F.lit(same).alias("type_matches"), broken.alias("null_violations"),
        )

    totals = view.agg(F.count("*").alias("_n"), *nulls)
    return totals.select(F.inline(F.array(*[row(i, f) for i, f in enumerate(contract)])))


# -- access requests ----------------------------------------------------------------------


def access_request(
    spark: SparkSession, product_id: str, name: str, email: str, reason: str, at: datetime
) -> DataFrame:
    """One pending request, in the layout of the append-only request log."""
    ticket = f"REQ-{int(at.replace(tzinfo=timezone.utc).timestamp())}"
    return inline_table(
        spark,
        [(ticket, product_id, name, email, reason, "PENDING", at, None, None, None)],
        "ticket_id string; product_id string; requester_name string; requester_email string; justification string; "
        "status string; requested_at timestamp; resolved_at timestamp; resolved_by string; notes string",
    )


def access_summary(requests: DataFrame) -> DataFrame:
    state = F.coalesce("status", F.lit("PENDING"))
    return requests.groupBy("product_id").agg(
        F.count("*").alias("total_requests"),
        *[F.count_if(state == s).alias(s.lower()) for s in ("APPROVED", "PENDING", "REJECTED")],
        F.max("requested_at").alias("last_request"),
    )


# -- triage ----------------------------------------------------------------------------------


def severity(trust: Column) -> Column:
    return F.when(trust < 85, "HIGH").when(trust < 90, "MEDIUM").otherwise("LOW")


def triage(trust: DataFrame) -> DataFrame:
    """Products whose trust is too low, with their worst dimension."""
    names = ["completeness", "uniqueness", "validity", "accuracy", "consistency", "timeliness"]
    worst = F.array_min(F.array(*[F.struct(F.col(f"dq_{n}_pct").alias("rate"), F.lit(n.upper()).alias("dimension")) for n in names]))
    failing = trust.where(F.col("trust_score") < ALERT_BELOW)
    return failing.withColumn("_worst", worst).select(
        "product_id", "product_name", "domain_owner_team", "trust_score", severity(F.col("trust_score")).alias("severity"),
        F.col("_worst.dimension").alias("failing_dimension"), F.col("_worst.rate").alias("failing_rate"),
    ).orderBy("trust_score")
