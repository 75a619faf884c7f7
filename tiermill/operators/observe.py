"""Batch lineage and the batch run log."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tiermill.reference import inline_table


def digest(*columns: str) -> Column:
    """Sum of 60-bit hashes of the rows' columns: equal for equal multisets of rows, whatever their order, and mergeable.

    Exchanged values, or a row altered for another one, change it, where a count stays the same.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns])
    return F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)"))


def reconcile(
    bronze: DataFrame,
    silver: DataFrame,
    gold: DataFrame,
    traced: tuple[list[str], list[str]] | None = None,
    published: list[str] | None = None,
) -> DataFrame:
    """Row counts of a batch through the layers, and the rows nobody accounts for.

    Each argument carries ``batch_id`` and ``source_system``; ``silver`` also ``is_quarantined``. The layers' counts are put
    under each other and added up once, so a batch without a number stays one row. ``traced`` names columns that must come
    through unchanged, as Bronze and as Silver call them, ``published`` those of clean Silver rows and Gold: then
    ``digest_matches`` and ``gold_matches`` tell whether the layers hold the same rows.
    """
    keys, names = ["batch_id", "source_system"], ["rows_bronze", "rows_silver", "quarantined", "rows_gold"]
    sums = ["_bronze", "_silver", "_clean", "_gold"]

    def counted(df: DataFrame, **found) -> DataFrame:
        number = [found.get(n, F.lit(0)).cast("bigint").alias(n) for n in names]
        zero = F.lit(0).cast("decimal(38,0)")
        return df.groupBy(*keys).agg(*number, *[F.coalesce(found.get(n, zero), zero).cast("decimal(38,0)").alias(n) for n in sums])

    def of(name: str, columns: list[str] | None) -> dict:
        return {name: digest(*columns)} if columns else {}

    own, conformed = traced or (None, None)
    clean = silver.where(~F.col("is_quarantined")) if published else None
    layers = counted(bronze, rows_bronze=F.count("*"), **of("_bronze", own)).unionByName(
        counted(
            silver, rows_silver=F.count_if(~F.col("is_quarantined")), quarantined=F.count_if("is_quarantined"), **of("_silver", conformed)
        )
    )
    if clean is not None:
        layers = layers.unionByName(counted(clean, **of("_clean", published)))
    layers = layers.unionByName(counted(gold, rows_gold=F.count("*"), **of("_gold", published)))
    summed = layers.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in [*names, *sums]])
    summed = summed.withColumn("lost", F.col("rows_bronze") - F.col("rows_silver") - F.col("quarantined"))
    if traced:
        summed = summed.withColumns({"digest_matches": F.col("_bronze") == F.col("_silver"), "digest": F.col("_bronze").cast("string")})
    if published:
        summed = summed.withColumn("gold_matches", F.col("_clean") == F.col("_gold"))
    return summed.drop(*sums)


RUN_LOG = (
    "batch_id string; process_name string; target_layer string; status string; records_read bigint; "
    "records_loaded bigint; records_rejected bigint; start_time timestamp; end_time timestamp; "
    "duration_seconds double; error_message string"
)


def lineage_row(spark: SparkSession, batch_id: str, source: str, target: str, counts: dict, at: datetime) -> DataFrame:
    """One row per hop of a batch: where its rows came from, where they went and how many."""
    row = (batch_id, source, target, counts["records_read"], counts["records_loaded"], counts["records_rejected"], at)
    return inline_table(
        spark,
        [row],
        "batch_id string; source_table string; target_table string; rows_in bigint; rows_out bigint; rows_rejected bigint; "
        "logged_at timestamp",
    )


def logged_write(
    judged: DataFrame,
    path: str,
    batch_id: str,
    name: str,
    started: datetime,
    partition_by: list[str] | None = None,
    now: Callable[[], datetime] = datetime.now,
) -> DataFrame:
    """Write the rows that pass and return the run-log row: status, end, duration and, after a failure, the error.

    The counts are observed while the rows are written, so logging costs no
    second pass. ``judged`` carries ``route``.
    """
    seen = Observation("batch_run")
    rejected = F.col("route") == "REJECTED"
    observed = judged.observe(
        seen,
        F.count(F.lit(1)).alias("records_read"),
        F.count_if(~rejected).alias("records_loaded"),
        F.count_if(rejected).alias("records_rejected"),
    )
    kept = observed.where(~rejected).drop("violations")
    status, error, counts = "SUCCESS", None, {"records_read": None, "records_loaded": None, "records_rejected": None}
    try:
        kept.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
        counts = seen.get
    except Exception as failure:  # a run that fails is logged like any other; the caller sees it in the row
        status, error = "FAILED", f"{type(failure).__name__}: {failure}"
    ended = now()
    row = (
        batch_id, name, "SILVER", status, counts["records_read"], counts["records_loaded"], counts["records_rejected"],
        started, ended, (ended - started).total_seconds(), error,
    )
    return inline_table(judged.sparkSession, [row], RUN_LOG)
