"""What the quality dashboards show, from a stored batch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermill.functions.exact import mean_2dp
from tiermill.reference import DIMENSIONS


def mean_rate() -> Column:
    return mean_2dp(F.sum("pass_rate"), F.count("pass_rate")).cast("double")


def kpi(log: DataFrame) -> DataFrame:
    """Totals over all log rows."""
    return log.agg(
        F.countDistinct("batch_id").alias("total_batches"),
        F.sum("records_checked").alias("total_checked"),
        F.sum("records_failed").alias("total_failed"),
        F.sum("records_quarantined").alias("total_quarantined"),
        mean_rate().alias("avg_pass_rate"),
    )


def heatmap(log: DataFrame) -> DataFrame:
    """Mean pass rate of each source and dimension."""
    wide = log.groupBy("source_system").pivot("dama_dimension", DIMENSIONS).agg(mean_rate())
    return wide.select("source_system", *[F.col(d).alias(d.lower()) for d in DIMENSIONS])


def trend(log: DataFrame) -> DataFrame:
    """Mean pass rate of each day and dimension, oldest day first."""
    by_day = log.groupBy(F.to_date("run_timestamp").alias("run_date"), "dama_dimension")
    return by_day.agg(mean_rate().alias("daily_pass_rate")).orderBy("run_date")


def failures(log: DataFrame) -> DataFrame:
    """Failed records of each dimension, most first."""
    return log.groupBy("dama_dimension").agg(F.sum("records_failed").alias("failures")).orderBy(F.desc("failures"))


def dimension_averages(log: DataFrame, *by) -> DataFrame:
    """Plain mean of each dimension and of all rows."""
    rate = F.col("pass_rate")
    of = lambda d: F.when(F.col("dama_dimension") == d, rate)
    return log.groupBy(*by).agg(
        *[(F.sum(of(d)).cast("double") / F.count(of(d))).alias(d.lower()) for d in DIMENSIONS],
        (F.sum(rate).cast("double") / F.count(rate)).alias("overall"),
    )


def latest_score(log: DataFrame, source: str) -> DataFrame:
    """Mean pass rate of the newest batch of a source."""
    scored = (
        log.where(F.col("source_system") == source)
        .groupBy("batch_id", "source_system", "run_timestamp")
        .agg((F.sum("pass_rate").cast("double") / F.count("*")).alias("score"))
    )
    newest = scored.orderBy(F.desc("run_timestamp")).limit(1)
    return newest.select("batch_id", "source_system", F.to_date("run_timestamp").alias("run_date"), "score")
