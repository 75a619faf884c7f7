from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tiermill.operators import catalog, observe

SLI = (
    "product_id string, measurement_time timestamp, data_age_minutes bigint, freshness_met boolean, "
    "dq_completeness_pct decimal(5,2), dq_validity_pct decimal(5,2), dq_uniqueness_pct decimal(5,2), "
    "dq_accuracy_pct decimal(5,2), dq_consistency_pct decimal(5,2), dq_timeliness_pct decimal(5,2), "
    "overall_dq_score decimal(5,2), all_slos_met boolean"
)
NOON = datetime(2024, 1, 1, 12)


def sli(product, fresh, overall, *rates, at=NOON):
    six = [Decimal(str(r)) for r in (rates or (100,) * 6)]
    return (product, at, 1, fresh, *six, Decimal(str(overall)), fresh)


def test_seeded_trust_scores(spark):
    rows = [
        sli("DP-001", True, 98.9, 99.9, 100, 100, 98.8, 100, 94.8),
        sli("DP-002", True, 98.7, 99.8, 99.5, 100, 99.1, 99, 95),
        sli("DP-003", True, 99.6, 100, 100, 100, 99.5, 100, 98),
        sli("DP-004", True, 98.7, 98.5, 99, 100, 97.2, 98.5, 99),
    ]
    got = catalog.trust_scores(catalog.table(spark), spark.createDataFrame(rows, SLI)).orderBy("product_id").collect()
    assert [float(r.trust_score) for r in got] == [99.2, 99.1, 99.7, 99.1]
    assert {r.trust_band for r in got} == {"GREEN"}


def test_band_edges(spark):
    scores = spark.createDataFrame([(98.0,), (97.9,), (95.0,), (94.9,)], "s double")
    assert [r[0] for r in scores.select(catalog.trust_band(F.col("s"))).collect()] == ["GREEN", "AMBER", "AMBER", "RED"]


def test_latest_keeps_ties_and_drops_older(spark):
    rows = [sli("DP-001", True, 99), sli("DP-001", False, 98), sli("DP-001", True, 97, at=datetime(2024, 1, 1, 11))]
    kept = catalog.latest(spark.createDataFrame(rows, SLI)).collect()
    assert sorted(float(r.overall_dq_score) for r in kept) == [98.0, 99.0]


def test_measure_defaults_and_no_silver(spark):
    orders = spark.createDataFrame([(datetime(2024, 1, 1, 11, 50, 30),)], "effective_from timestamp")
    log = spark.createDataFrame([], "dama_dimension string, pass_rate decimal(5,2), run_timestamp timestamp")
    got = {r.product_id: r for r in catalog.measure(catalog.table(spark), orders, log, [NOON]).collect()}
    assert len(got) == 4
    assert got["DP-001"].data_age_minutes == 10 and got["DP-001"].freshness_met and not got["DP-002"].freshness_met
    assert float(got["DP-001"].overall_dq_score) == 98.9 and float(got["DP-001"].dq_timeliness_pct) == 94.8
    empty = catalog.measure(catalog.table(spark), orders.limit(0), log, [NOON])
    assert empty.count() == 0


def test_log_window_includes_both_edges(spark):
    rows = [
        ("VALIDITY", Decimal("90.00"), datetime(2023, 12, 31, 12)),
        ("VALIDITY", Decimal("80.00"), NOON),
        ("VALIDITY", Decimal("10.00"), datetime(2023, 12, 31, 11, 59)),
    ]
    log = spark.createDataFrame(rows, "dama_dimension string, pass_rate decimal(5,2), run_timestamp timestamp")
    assert float(catalog.recent_rates(log, [NOON]).first().validity) == 85.0


def test_triage_golden(spark):
    schema = (
        "product_id string, product_name string, domain_owner_team string, trust_score double, dq_completeness_pct double, "
        "dq_uniqueness_pct double, dq_validity_pct double, dq_accuracy_pct double, dq_consistency_pct double, dq_timeliness_pct double"
    )
    rows = [
        ("DP-001", "Customer view", "team a", 99.2, 99.8, 100.0, 99.5, 98.9, 99.1, 99.6),
        ("DP-002", "Sales view", "team b", 87.5, 82.1, 99.7, 88.4, 90.0, 85.3, 99.0),
    ]
    got = catalog.triage(spark.createDataFrame(rows, schema)).collect()
    assert [(r.product_id, r.severity, r.failing_dimension, r.failing_rate) for r in got] == [
        ("DP-002", "MEDIUM", "COMPLETENESS", 82.1)
    ]


def test_lineage_golden(spark):
    batch = lambda n: spark.range(n).select(F.lit("B1").alias("batch_id"), F.lit("JDE").alias("source_system"), "id")
    silver = batch(8420).withColumn("is_quarantined", F.col("id") < 312)
    row = observe.reconcile(batch(8420), silver, batch(8108)).first()
    assert (row.rows_bronze, row.rows_silver, row.rows_gold, row.quarantined, row.lost) == (8420, 8108, 8108, 312, 0)


def test_lineage_shows_lost_and_unknown_batches(spark):
    batch = lambda b, n: spark.range(n).select(F.lit(b).alias("batch_id"), F.lit("SAP").alias("source_system"))
    silver = batch("B1", 7).withColumn("is_quarantined", F.lit(False))
    got = {r.batch_id: r for r in observe.reconcile(batch("B1", 10), silver, batch("B2", 1)).collect()}
    assert got["B1"].lost == 3
    assert (got["B2"].rows_bronze, got["B2"].rows_gold) == (0, 1)


def test_contract_reports_missing_type_and_nulls(spark):
    view = spark.createDataFrame([("a", 1), (None, 2)], "order_hk string, net int")
    contract = [catalog.Field("order_hk", "string", False), catalog.Field("net", "decimal(18,4)"), catalog.Field("gone", "date", False)]
    got = {r.column_name: (r.is_present, r.type_matches, r.null_violations) for r in catalog.check_contract(view, "P", contract).collect()}
    assert got == {"order_hk": (True, True, 1), "net": (True, False, 0), "gone": (False, False, 0)}


def test_a_failed_write_is_logged(spark):
    judged = spark.sql("SELECT raise_error('broken') AS x, 'PASSED' AS route, array('a') AS violations")
    start = datetime(2024, 1, 1)
    row = observe.logged_write(judged, "/proc/no-such-folder/out", "B1", "load", start, now=lambda: datetime(2024, 1, 1, 0, 1)).first()
    assert (row.status, row.records_read, row.duration_seconds) == ("FAILED", None, 60.0) and row.error_message


def test_digest_finds_an_altered_row(spark):
    """Counts agree, yet two rows have exchanged their amounts, or one was altered."""
    schema = "batch_id string, source_system string, is_quarantined boolean, id string, amount decimal(18,4)"
    rows = [("b1", "SAP", False, str(i), i * 10) for i in range(5)] + [(None, "SAP", True, "9", None)]
    make = lambda changed: spark.createDataFrame(
        [(*r[:4], None if (v := changed.get(r[3], r[4])) is None else Decimal(v)) for r in rows], schema
    )
    traced = (["id", "amount"], ["id", "amount"])
    for changed, same in (({}, True), ({"1": 20, "2": 10}, False), ({"3": 31}, False)):
        other = make(changed).repartition(3)
        got = observe.reconcile(make({}), other, other.where("NOT is_quarantined"), traced, ["id", "amount"]).collect()
        by = {r.batch_id: r for r in got}
        assert by["b1"].digest_matches == same and by["b1"].gold_matches and by["b1"].lost == 0
        assert by[None].digest_matches and len(got) == 2
