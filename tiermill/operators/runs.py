"""Scheduled runs: the transforms with their tables attached.

An outside scheduler calls these; each writes tables partitioned by date, and may
be repeated: a run replaces its own rows and never those of another.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.operators import features, quality
from tiermill.sources import tables


def _existing(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows already stored, or none where nothing has been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def _replace(rows: DataFrame, path: str) -> None:
    """Write the rows of one run; a repeated run replaces its own partition."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_date", "run_id").parquet(path)


def quality_run(
    orders: DataFrame, log_path: str, run_ts: datetime, by: list[str] | None = None, run_id: str | None = None
) -> None:
    """All checks of all sources, written to the batch log under their run id (the run time, if none is given)."""
    groups = by or ["batch_id", "source_system", "source_region"]
    results = quality.run_all(orders, groups, run_ts.date())
    rows = quality.log_rows(results, F.lit(run_ts)).withColumns(
        {"run_date": F.to_date("run_timestamp"), "run_id": F.lit(run_id or f"{run_ts:%Y%m%dT%H%M%S}")}
    )
    _replace(rows, log_path)


def sli_run(measured: DataFrame, log_path: str, run_ts: datetime, run_id: str | None = None) -> None:
    """Measured service levels of all products, written to the measurement log under their run id."""
    rows = measured.withColumns({"run_date": F.lit(run_ts.date()), "run_id": F.lit(run_id or f"{run_ts:%Y%m%dT%H%M%S}")})
    _replace(rows, log_path)


def feature_run(
    orders: DataFrame, lines: DataFrame, feature_path: str, prediction_path: str, as_of: date, version: int = 1
) -> None:
    """Feature rows and predictions of one day; what is stored is not written twice."""
    spark = orders.sparkSession
    rows = features.with_product_mix(
        features.revenue_features(orders, as_of, version), features.product_mix(lines, as_of)
    )
    key = ["customer_hk", "as_of_date", "feature_version"]
    stored = _existing(spark, feature_path, rows.schema).where(F.col("as_of_date") == F.lit(as_of))
    tables.append(rows.join(stored.select(key), key, "left_anti"), feature_path, ["as_of_date"], ["customer_hk"])

    current = spark.read.schema(rows.schema).parquet(feature_path).where(
        (F.col("as_of_date") == F.lit(as_of)) & (F.col("feature_version") == version)
    )
    known = _existing(spark, prediction_path, features.churn_predictions(rows).schema)
    scored = features.churn_predictions(current, known.where(F.col("as_of_date") == F.lit(as_of)))
    tables.append(scored, prediction_path, ["as_of_date"], ["entity_hk"])
