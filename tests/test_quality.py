import random
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tiermill.operators import quality, rules, states

SCHEMA = (
    "source_system string, source_region string, order_hk string, original_id string, customer_hk string, "
    "order_date date, net_amount_usd decimal(18,4), currency_code string, effective_from timestamp, load_timestamp timestamp"
)


def order(i, **changes):
    row = {
        "source_system": "SAP", "source_region": "EUROPE", "order_hk": f"o{i}", "original_id": f"{i}", "customer_hk": "c",
        "order_date": date(2020, 1, 1), "net_amount_usd": Decimal("10.0000"), "currency_code": "EUR",
        "effective_from": datetime(2020, 1, 1, 1), "load_timestamp": datetime(2020, 1, 1, 4),
    }
    return tuple({**row, **changes}.values())


def run(spark, rows, by=("source_system",)):
    frame = spark.createDataFrame(rows, SCHEMA)
    return {r.rule_name: r for r in quality.run_all(frame, list(by), date(2021, 1, 1)).collect()}


def test_sigma_needs_more_than_thirty_rows(spark):
    thirty = run(spark, [order(i) for i in range(30)])
    more = run(spark, [order(i) for i in range(30)] + [order(99, net_amount_usd=Decimal("9999.0000"))])
    assert "AMOUNT_3SIGMA_OUTLIER" not in thirty
    assert more["AMOUNT_3SIGMA_OUTLIER"].records_failed == 1
    assert more["AMOUNT_3SIGMA_OUTLIER"].records_checked == 31


def test_constant_amounts_have_no_outliers(spark):
    assert run(spark, [order(i) for i in range(40)])["AMOUNT_3SIGMA_OUTLIER"].records_failed == 0


def test_completeness_quarantines_only_below_99(spark):
    bad = order(0, customer_hk=None)
    hundred = run(spark, [bad] + [order(i) for i in range(1, 100)])["CUSTOMER_HK_NOT_NULL"]
    fifty = run(spark, [bad] + [order(i) for i in range(1, 50)])["CUSTOMER_HK_NOT_NULL"]
    assert (hundred.records_failed, hundred.records_quarantined, str(hundred.pass_rate)) == (1, 0, "99.00")
    assert (fifty.records_failed, fifty.records_quarantined, str(fifty.pass_rate)) == (1, 1, "98.00")


def test_missing_currency_is_not_invalid(spark):
    got = run(spark, [order(0, currency_code=None), order(1, currency_code="XXX"), order(2, currency_code="USD")])
    assert got["CURRENCY_ISO4217"].records_failed == 1
    assert got["EUR_REGION_CURRENCY_MATCH"].records_failed == 2


def test_date_range_edges_and_negative_amounts(spark):
    days = [date(2009, 12, 31), date(2010, 1, 1), date(2021, 1, 1), date(2021, 1, 2), None]
    got = run(spark, [order(i, order_date=d) for i, d in enumerate(days)] + [order(9, net_amount_usd=Decimal("-1.0000"))])
    assert got["ORDER_DATE_RANGE"].records_failed == 2
    assert (got["AMOUNT_NON_NEGATIVE"].records_failed, got["AMOUNT_NON_NEGATIVE"].records_quarantined) == (1, 0)


def test_lag_counts_hour_boundaries(spark):
    times = [datetime(2020, 1, 1, 4, 59), datetime(2020, 1, 1, 5, 0)]
    assert run(spark, [order(i, load_timestamp=t) for i, t in enumerate(times)])["LOAD_LAG_CHECK"].records_failed == 1


def test_uniqueness_counts_groups_not_rows(spark):
    got = run(spark, [order(1), order(1), order(1), order(2)])["PK_UNIQUE(ORDER_HK_EFFECTIVE_FROM)"]
    assert (got.records_checked, got.records_failed, str(got.pass_rate)) == (4, 1, "75.00")


def test_empty_source_gives_no_rows(spark):
    assert run(spark, []) == {}


def test_empty_frame_without_groups(spark):
    got = run(spark, [], by=())
    assert str(got["ORDER_HK_NOT_NULL"].pass_rate) == "0.00"
    assert str(got["CURRENCY_ISO4217"].pass_rate) == "100.00"
    assert str(got["PK_UNIQUE(ORDER_HK_EFFECTIVE_FROM)"].pass_rate) == "100.00"


def test_rules_route_rows(spark):
    frame = spark.createDataFrame(
        [("b", "SAP", 1, "x"), ("b", "SAP", -1, None), ("b", "SAP", None, None)],
        "batch_id string, source_system string, amount int, owner string",
    ).withColumn("load_timestamp", F.lit(datetime(2020, 1, 1)))
    checks = [
        rules.Rule("POSITIVE", "VALIDITY", "amount > 0", action="REJECT", message="not positive"),
        rules.Rule("OWNED", "COMPLETENESS", "owner IS NOT NULL", action="QUARANTINE"),
        rules.Rule("OFF", "VALIDITY", "false", active=False),
    ]
    judged = rules.judge(frame, checks)
    assert sorted((r.route, ",".join(r.dq_flags)) for r in judged.collect()) == [
        ("PASSED", ""), ("QUARANTINED", "OWNED"), ("REJECTED", "POSITIVE,OWNED"),
    ]
    kept = rules.passed(judged)
    assert sorted(r.is_quarantined for r in kept.collect()) == [False, True]
    refused = rules.rejected(judged, "T", ["amount", "owner"]).collect()
    assert [(r.rule_violated, r.record_data) for r in refused] == [("POSITIVE", '{"amount":-1}')]
    assert [r.status for r in rules.quarantined(judged, "T", ["amount"]).collect()] == ["OPEN"]


def test_states_of_batches_equal_one_run(spark, tmp_path):
    """Keys repeated within and across batches, outliers found by later limits, unknown groups, a batch that comes again."""
    draw = random.Random(12)
    rows = []
    for i in range(400):
        amount = draw.choice([10, 11, 12, 13, 9]) if draw.random() < 0.97 else draw.choice([-500, 40, 900, 15])
        rows.append(
            order(
                draw.randrange(330), source_system=draw.choice(["SAP", "SAP", "JDE", None]), net_amount_usd=draw.choice([Decimal(amount), Decimal(amount), None]),
                currency_code=draw.choice(["EUR", "XXX", None]), customer_hk=draw.choice(["c", None]),
            )
        )
    rows += [order(1000 + i, source_system="tiny") for i in range(9)]
    root, by = str(tmp_path / "states"), ["source_system"]
    for number, (a, b) in enumerate([(0, 5), (5, 150), (150, 409), (150, 409)]):
        states.add_batch(spark.createDataFrame(rows[a:b], SCHEMA).repartition(3), root, min(number, 2), by, date(2021, 1, 1), slices=4)
    got = states.results(spark, root, by)
    want = quality.run_all(spark.createDataFrame(rows, SCHEMA), by, date(2021, 1, 1)).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    outliers = {r.source_system: r.records_failed for r in got.where("dama_dimension = 'ACCURACY'").collect()}
    assert "tiny" not in outliers and sum(outliers.values()) > 3


def test_bins_keep_the_order_of_amounts(spark):
    values = sorted([0.0, -0.5, 0.5, 1e9, -1e9, *[s * 1.07**i for i in range(120) for s in (1, -1)]])
    bins = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", states.amount_bin(F.col("v")).alias("b")).orderBy("v").collect()]
    assert bins == sorted(bins) and bins[0] < 0 < bins[-1]
