"""Point-in-time customer features, scores, predictions, narratives."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermill.functions.dates import days_before
from tiermill.operators.gold import revenue_band
from tiermill.session import stored

# Thresholds of the churn bands and weights of the churn score.
HIGH_ABOVE, MEDIUM_ABOVE = 0.7, 0.4
CONFIDENCE_INTERVAL = 0.05


def _aggregate(seen: DataFrame, keys: list[str]) -> DataFrame:
    """One grouped aggregation holds every window, count and extreme."""
    age, amount = F.col("_age"), F.col("net_amount_usd")
    none = F.lit(0).cast("decimal(18,4)")
    revenue = lambda inside: F.sum(F.when(inside, amount).otherwise(none))
    number = lambda days: F.count_if(age <= days)
    return seen.groupBy(*keys).agg(
        revenue(age <= 7).alias("rev_l7d_usd"),
        revenue(age <= 30).alias("rev_l30d_usd"),
        revenue(age <= 90).alias("rev_l90d_usd"),
        revenue(age <= 365).alias("rev_l365d_usd"),
        revenue(age.between(366, 730)).alias("rev_prev_year_usd"),
        number(30).alias("order_count_l30"),
        number(90).alias("order_count_l90"),
        number(365).alias("order_count_l365"),
        F.max(amount).alias("max_order_value"),
        F.min(amount).alias("min_order_value"),
        F.min(age).alias("days_since_last_order"),
        F.count("*").alias("total_orders"),
    )


def churn_score() -> Column:
    quiet = F.when(F.col("rev_l90d_usd") == 0, F.lit(0.3)).otherwise(F.lit(0.0))
    raw = F.col("days_since_last_order") / F.lit(365.0) * F.lit(0.7) + quiet
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def upsell_score() -> Column:
    growing = F.col("rev_l30d_usd") * 3 > F.col("rev_l90d_usd")
    return F.when(growing, F.lit(0.75)).otherwise(F.lit(0.25))


def _derive(grouped: DataFrame, version: int) -> DataFrame:
    orders_90 = F.col("order_count_l90")
    mean_90 = F.when(orders_90 > 0, F.col("rev_l90d_usd").cast("double") / orders_90).otherwise(F.lit(0.0))
    return grouped.withColumns(
        {
            "avg_order_value_l90": mean_90,
            "order_frequency_l365": F.col("order_count_l365") / F.lit(12.0),
            "churn_risk_score": churn_score(),
            "upsell_propensity": upsell_score(),
            "feature_version": F.lit(version),
        }
    )


def _usable(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("is_current") & ~F.col("is_quarantined"))


def revenue_features(orders: DataFrame, as_of: date, version: int = 1) -> DataFrame:
    """Features per customer from orders strictly before ``as_of``."""
    at = F.lit(as_of)
    seen = _usable(orders).where(F.col("order_date") < at).withColumn("_age", days_before(F.col("order_date"), at))
    return _derive(_aggregate(seen, ["customer_hk"]), version).withColumn("as_of_date", at)


# First and last age in days of an order in each revenue window.
WINDOWS = {"l7d": (1, 7), "l30d": (1, 30), "l90d": (1, 90), "l365d": (1, 365), "prev_year": (366, 730)}


def _borders(daily: DataFrame, dates: list[date]) -> DataFrame:
    """What changes for a customer at each date (``_slot``): a day's orders enter a window at the first date on or after one
    border and leave it at the first date after the other."""
    ages = sorted({first for first, _ in WINDOWS.values()} | {last + 1 for _, last in WINDOWS.values()})
    changes = {age: {n: (age == first) - (age == last + 1) for n, (first, last) in WINDOWS.items()} for age in ages}
    rows = [F.struct(F.lit(age).alias("age"), *[F.lit(c).alias(n) for n, c in changes[age].items()]) for age in ages]
    days = (dates[-1] - dates[0]).days + 1
    day = F.date_add(F.lit(dates[0]), F.col("id").cast("int"))
    earlier = F.filter(F.array(*[F.lit(d) for d in dates]), lambda d: d < day)
    # One row for each day between the first and the last date.
    calendar = daily.sparkSession.range(days).select(day.alias("_day"), F.size(earlier).alias("_slot"))
    events = daily.withColumn("_e", F.explode(F.array(*rows))).select("*", "_e.*").drop("_e")
    # What happened before the first date happens on it; what would after the last one does not.
    events = events.withColumn("_day", F.greatest(F.date_add("order_date", F.col("age")), F.lit(dates[0])))
    events = events.join(F.broadcast(calendar), "_day")
    signed = lambda n, c: F.sum(F.when(F.col(n) == 1, F.col(c)).when(F.col(n) == -1, -F.col(c)))
    entering = lambda c: F.when(F.col("age") == 1, F.col(c))
    return events.groupBy("customer_hk", "_slot").agg(
        *[signed(n, c).alias(f"{c}_{n}") for n in WINDOWS for c in ("_sum", "_n", "_known")],
        F.sum(entering("_n")).alias("total_orders"),
        F.max(entering("_max")).alias("max_order_value"),
        F.min(entering("_min")).alias("min_order_value"),
        F.max(entering("order_date")).alias("_last"),
    )


def revenue_features_for(orders: DataFrame, dates: list[date], version: int = 1) -> DataFrame:
    """Features for many dates in one pass.

    Orders are reduced to customers and days. Each customer-day makes one change at each border of the windows, whatever the
    number of dates, and running sums over a customer's changes are its features; between two changes they stay.
    """
    dates = sorted(set(dates))
    amount = F.col("net_amount_usd")
    daily = (
        _usable(orders)
        .where(F.col("order_date") < F.lit(dates[-1]))
        .groupBy("customer_hk", "order_date")
        .agg(
            F.sum(amount).alias("_sum"), F.count("*").alias("_n"), F.count(amount).alias("_known"),
            F.max(amount).alias("_max"), F.min(amount).alias("_min"),
        )
    )
    # A customer has a row a day at most; from here on everything stays with the customer.
    changes = _borders(daily.repartition("customer_hk"), dates)
    along = Window.partitionBy("customer_hk").orderBy("_slot")
    until = along.rowsBetween(Window.unboundedPreceding, 0)
    sums = [f"{c}_{n}" for n in WINDOWS for c in ("_sum", "_n", "_known")] + ["total_orders"]
    running = {c: F.coalesce(F.sum(c).over(until), F.lit(0)) for c in sums}
    running |= {"max_order_value": F.max("max_order_value").over(until), "min_order_value": F.min("min_order_value").over(until)}
    running |= {"_last": F.max("_last").over(until), "_next": F.coalesce(F.lead("_slot").over(along), F.lit(len(dates)))}
    states = changes.withColumns(running).withColumn("_at", F.explode(F.sequence(F.col("_slot"), F.col("_next") - 1)))
    as_of = F.element_at(F.array(*[F.lit(d) for d in dates]), F.col("_at") + 1)
    # As in the sum over single orders: unknown only where all orders are inside and none has an amount.
    unknown = lambda n: (F.col(f"_known_{n}") == 0) & (F.col(f"_n_{n}") == F.col("total_orders"))
    revenue = lambda n: F.when(~unknown(n), F.col(f"_sum_{n}")).cast("decimal(28,4)")
    grouped = states.withColumn("as_of_date", as_of).select(
        "customer_hk",
        "as_of_date",
        *[revenue(n).alias(f"rev_{n}_usd") for n in WINDOWS],
        *[F.col(f"_n_l{d}d").alias(f"order_count_l{d}") for d in (30, 90, 365)],
        "max_order_value",
        "min_order_value",
        days_before(F.col("_last"), F.col("as_of_date")).alias("days_since_last_order"),
        "total_orders",
    )
    return _derive(grouped, version)


# -- product mix -----------------------------------------------------------------


def _year_before(lines: DataFrame, as_of: date) -> DataFrame:
    age = days_before(F.col("order_date"), F.lit(as_of))
    return lines.where(~F.col("is_quarantined") & (F.col("order_date") < F.lit(as_of)) & (age <= 365))


def family_revenue(lines: DataFrame, as_of: date) -> DataFrame:
    """Last year's purchases per customer and product family."""
    return _year_before(lines, as_of).groupBy("customer_hk", "product_family").agg(
        F.sum("line_amount_usd").alias("revenue"),
        F.count("*").alias("purchase_count_l365"),
        F.max("order_date").alias("last_purchase_date"),
    )


def product_mix(lines: DataFrame, as_of: date) -> DataFrame:
    """Concentration of a customer's revenue over families (sum of squared shares)."""
    share = F.col("revenue").cast("double")
    return family_revenue(lines, as_of).groupBy("customer_hk").agg(
        (F.sum(share * share) / F.pow(F.sum("revenue").cast("double"), F.lit(2.0))).alias("product_mix_hhi"),
        F.count("*").alias("families"),
    )


def with_product_mix(features: DataFrame, mix: DataFrame) -> DataFrame:
    """Feature rows completed by the concentration; no purchase gives NULL."""
    return features.join(mix.select("customer_hk", "product_mix_hhi"), "customer_hk", "left")


def _joint_counter(width: int = 1024):
    """Task function: customers owning both families, per batch of baskets.

    Baskets become a 0/1 matrix whose product with itself holds the counts,
    taken ``width`` families at a time so that memory stays bounded.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["owned"].map(len).to_numpy()
            if not sizes.sum():
                continue
            names, codes = np.unique(np.concatenate(batch["owned"].to_numpy()), return_inverse=True)
            rows = np.repeat(np.arange(len(batch)), sizes)

            def block(start: int) -> np.ndarray:
                stop = min(start + width, len(names))
                owned = np.zeros((len(batch), stop - start), dtype=np.float32)
                inside = (codes >= start) & (codes < stop)
                owned[rows[inside], codes[inside] - start] = 1.0
                return owned

            for top in range(0, len(names), width):
                wanted = block(top).T
                for left in range(0, len(names), width):
                    both = wanted @ block(left)
                    i, j = np.nonzero(both)
                    yield pd.DataFrame(
                        {
                            "family": names[top + i],
                            "other": names[left + j],
                            "customers": both[i, j].astype(np.int64),
                        }
                    )

    return count


def family_affinity(purchases: DataFrame) -> DataFrame:
    """P(family | other) over customers, one row per family pair that occurs.

    Ownership is counted by matrix products inside the tasks, so each batch
    hands on at most one row per family pair however many customers share it.
    """
    return _likelihoods(purchases, purchases.groupBy("customer_hk").agg(F.collect_list("product_family").alias("owned")))


def _likelihoods(purchases: DataFrame, baskets: DataFrame) -> DataFrame:
    """``purchases`` has one row per customer and family, so its rows per family are the owners."""
    joint = (
        baskets.select("owned")
        .mapInPandas(_joint_counter(), "family string, other string, customers bigint")
        .groupBy("family", "other")
        .agg(F.sum("customers").alias("both"))
    )
    alone = purchases.where(F.col("product_family").isNotNull()).groupBy(F.col("product_family").alias("other")).agg(
        F.count("*").alias("owners")
    )
    return joint.join(alone, "other").select(
        "family", "other", (F.col("both") / F.col("owners")).alias("likelihood")
    )


def product_affinity(lines: DataFrame, as_of: date) -> DataFrame:
    """Per customer and family: counts, recency, revenue share, cross-sell score.

    The score is the best chance of owning the family among owners of another
    family the customer has; a single-family customer scores zero. So do purchases without a family, which count in
    the customer's total like any other.
    """
    purchases = stored(family_revenue(lines, as_of), "family-purchases")  # read three times below
    basket = stored(
        purchases.groupBy("customer_hk").agg(
            F.sum("revenue").alias("total"), F.collect_list("product_family").alias("owned")
        ),
        "family-baskets",
    )
    chances = stored(
        _likelihoods(purchases, basket).groupBy("family").agg(
            F.map_from_entries(F.collect_list(F.struct("other", "likelihood"))).alias("chance")
        ),
        "family-chances",
    )
    family = F.col("product_family")
    others = F.filter("owned", lambda g: g != family)
    score = F.array_max(F.transform(others, lambda g: F.element_at("chance", g)))
    return (
        purchases.join(basket, "customer_hk")
        .join(chances, family == F.col("family"), "left")
        .select(
            "customer_hk",
            "product_family",
            "purchase_count_l365",
            "last_purchase_date",
            days_before(F.col("last_purchase_date"), F.lit(as_of)).alias("days_since_purchase"),
            (F.col("revenue").cast("double") * 100 / F.col("total").cast("double")).alias("revenue_share_pct"),
            F.coalesce(score, F.lit(0.0)).alias("cross_sell_score"),
            F.lit(as_of).alias("as_of_date"),
        )
    )


# -- predictions ---------------------------------------------------------------------


def risk_band(score: Column) -> Column:
    return F.when(score > HIGH_ABOVE, "HIGH").when(score > MEDIUM_ABOVE, "MEDIUM").otherwise("LOW")


def churn_predictions(features: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Prediction rows; customers already scored for the same day are skipped."""
    score = F.col("churn_risk_score")
    band = risk_band(score)
    fresh = features.select(
        F.lit("CHURN_RISK").alias("model_name"),
        F.lit("v1.0").alias("model_version"),
        F.lit("CUSTOMER").alias("entity_type"),
        F.col("customer_hk").alias("entity_hk"),
        "as_of_date",
        F.concat(F.lit("CHURN_"), band).alias("prediction_label"),
        score.alias("prediction_score"),
        band.alias("prediction_band"),
        F.lit(CONFIDENCE_INTERVAL).alias("confidence_interval"),
    )
    if existing is None:
        return fresh
    return fresh.join(existing.select("model_name", "entity_hk", "as_of_date"), ["model_name", "entity_hk", "as_of_date"], "left_anti")


# -- narratives ------------------------------------------------------------------------


def features_by_master(features: DataFrame, identity: DataFrame) -> DataFrame:
    """Features of all source customers of a master customer, combined."""
    owner = identity.select("customer_hk", "master_customer_hk")
    return features.join(owner, "customer_hk").groupBy("master_customer_hk").agg(
        F.sum("rev_l365d_usd").alias("rev_l365d_usd"),
        F.sum("order_count_l90").alias("order_count_l90"),
        F.min("churn_risk_score").alias("churn_risk_score"),
    )


def whole_dollars(amount: Column) -> Column:
    """Grouped whole number, padded left to eleven characters, never cut."""
    text = F.format_number(F.round(amount, 0).cast("bigint"), 0)
    return F.when(F.length(text) < 11, F.lpad(text, 11, " ")).otherwise(text)


def narratives(customers: DataFrame, features: DataFrame) -> DataFrame:
    """One summary row per current customer; missing features count as zero."""
    revenue = F.coalesce("rev_l365d_usd", F.lit(0).cast("decimal(18,4)"))
    orders = F.coalesce("order_count_l90", F.lit(0))
    known = lambda c: F.coalesce(c, F.lit("Unknown"))
    summary = F.concat(
        F.lit("Customer: "), known("customer_name"),
        F.lit(". Industry: "), known("industry"),
        F.lit(". Region: "), known("region"),
        F.lit(". Segment: "), known("segment"),
        F.lit(". Revenue 12mo: $"), whole_dollars(revenue),
        F.lit(". Orders 90d: "), orders.cast("string"),
        F.lit(". Churn risk: "), risk_band(F.coalesce("churn_risk_score", F.lit(0.0))),
    )
    return customers.where(F.col("is_current")).join(features, "master_customer_hk", "left").select(
        F.col("master_customer_hk").alias("customer_hk"),
        "customer_name",
        summary.alias("customer_summary"),
        F.array("industry", "segment").alias("tags"),
        F.array("country_code").alias("top_countries"),
        revenue_band(revenue).alias("revenue_band"),
    )
