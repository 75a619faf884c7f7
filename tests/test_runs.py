from datetime import datetime

from pyspark.sql import functions as F

from tiermill.operators import catalog, runs, silver
from tiermill.sources import tables
from tiermill.sources.bridge import AS_OF, RUN_TS


def test_feature_run_twice_writes_once(spark, bronze, tmp_path):
    feature_path, prediction_path = str(tmp_path / "features"), str(tmp_path / "predictions")
    orders = silver.orders(bronze.orders(before=AS_OF))
    lines = silver.order_lines(bronze.order_items(), orders)
    for _ in range(2):
        runs.feature_run(orders, lines, feature_path, prediction_path, AS_OF)
    stored = spark.read.parquet(feature_path)
    assert stored.count() == stored.select("customer_hk").distinct().count() > 100
    assert spark.read.parquet(prediction_path).count() == stored.count()


def test_a_repeated_quality_run_replaces_its_rows(spark, bronze, tmp_path):
    path = str(tmp_path / "log")
    orders = silver.orders(bronze.orders()).withColumnRenamed("source_batch_id", "batch_id")
    runs.quality_run(orders, path, RUN_TS)
    runs.quality_run(orders, path, RUN_TS)
    runs.quality_run(orders, path, RUN_TS, run_id="other")
    log = spark.read.parquet(path)
    assert log.select("run_id").distinct().count() == 2
    groups = orders.select("batch_id", "source_system").distinct().count()
    assert log.where(F.col("dama_dimension") == "UNIQUENESS").count() == 2 * groups
    assert log.select("run_date").distinct().count() == 1


def test_access_requests_append_and_sum_up(spark, tmp_path):
    path = str(tmp_path / "requests")
    at = datetime(2024, 5, 1, 12)
    tables.append(catalog.access_request(spark, "DP-001", "A O'Neil", "a@x.org", "report", at).withColumn("day", F.to_date("requested_at")), path, ["day"])
    row = catalog.access_summary(spark.read.parquet(path)).first()
    assert (row.product_id, row.total_requests, row.pending, row.approved, row.last_request) == ("DP-001", 1, 1, 0, at)
    assert spark.read.parquet(path).first().ticket_id == "REQ-1714564800"
