from datetime import date, datetime

from pyspark.sql import functions as F

from tiermill.functions import dates, exact, keys, policies, text
from tiermill.operators import gold, silver
from tiermill.reference import country_table, currency_table

GOLDEN_KEY = "ecf1f2b7eeaec55c029c7df62976ac8e12bb0c38e4cef53d05f13dfb0d070c9e"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_hash_key_golden(spark):
    assert one(spark, keys.hash_key(F.lit("SAP"), F.lit("CUST-001"))) == GOLDEN_KEY
    assert one(spark, keys.hash_key(F.lit(" sap "), F.lit("cust-001 "))) == GOLDEN_KEY
    assert one(spark, keys.hash_key(F.lit("JDE"), F.lit("CUST-001"))) != GOLDEN_KEY
    missing = one(spark, keys.hash_key(F.lit("SAP"), F.lit(None).cast("string")))
    assert missing == one(spark, F.sha2(F.lit("SAP|NULL_PK"), 256))


def test_hash_functions_in_sql(spark):
    keys.register_sql(spark)
    row = spark.sql("SELECT generate_hash_key('SAP', 'CUST-001') k, generate_hash_diff(NULL) d").first()
    assert row.k == GOLDEN_KEY
    assert row.d == one(spark, keys.hash_diff(F.lit(None).cast("string")))


def test_hour_boundaries_are_not_elapsed_hours(spark):
    a, b = F.lit(datetime(2020, 1, 1, 10, 59)), F.lit(datetime(2020, 1, 1, 11, 1))
    assert one(spark, dates.boundaries("hour", a, b)) == 1
    assert one(spark, dates.boundaries("minute", a, b)) == 2
    assert one(spark, dates.boundaries("hour", b, a)) == -1


def test_percent_rounds_half_up_without_floats(spark):
    assert str(one(spark, exact.percent(F.lit(1), F.lit(32), 0))) == "3.13"
    assert str(one(spark, exact.percent(F.lit(0), F.lit(0), 100))) == "100.00"
    assert str(one(spark, exact.percent(F.lit(10**13), F.lit(10**13), 0))) == "100.00"


def test_calendar_golden(spark):
    calendar = gold.dim_date(spark)
    assert calendar.count() == 5479
    last = calendar.orderBy(F.desc("calendar_date")).first()
    assert last.calendar_date == date(2029, 12, 31)
    sunday = calendar.where("date_key = 20150104").first()
    assert (sunday.day_of_week, sunday.day_name, sunday.is_weekend, sunday.quarter_name) == (0, "Sun", True, "Q1")


def test_region_seed_and_reference_rows(spark):
    seed = gold.dim_region_seed(spark)
    assert seed.count() == 10
    assert seed.where("region_sk = 1").first().region_hk == one(spark, F.sha2(F.lit("EUROPE|DACH"), 256))
    assert currency_table(spark).count() == 15
    assert country_table(spark).count() == 17


def test_text_parsers(spark):
    assert one(spark, text.split_tags(F.lit(" a, ,b,,c "))) == ["a", "b", "c"]
    assert one(spark, text.leading_percent(F.lit("99.90% availability"))) == 99.9
    assert one(spark, text.leading_percent(F.lit("none"))) == 99.5
    assert one(spark, text.leading_percent(F.lit(None).cast("string"))) == 99.5
    assert one(spark, text.contains_any("50%", F.lit("gives 50% off"), F.lit(None).cast("string"))) is True
    assert one(spark, text.contains_any("5_%", F.lit("gives 50% off"))) is False


def test_masks_never_leak(spark):
    value, amount = F.lit("secret@x.org"), F.lit(12.5)
    everyone = ["GLOBAL_ANALYST", "FINANCE_ANALYST", "SAP_EUROPE_READER", "DATA_PRODUCT_OWNER", "ML_ENGINEER"]
    for role in everyone:
        assert one(spark, policies.mask_pii(value, {role})) != "secret@x.org"
        assert one(spark, policies.mask_email(value, {role})) == "****@x.org"
        assert (one(spark, policies.mask_financial(amount, {role})) == -1) == (role != "FINANCE_ANALYST")
    assert one(spark, policies.mask_pii(value, set())) == "***-MASKED-***"
    assert one(spark, policies.mask_pii(value, {"GLOBAL_ANALYST", "EXEC_VP"})) == "secret@x.org"
    assert one(spark, policies.mask_email(F.lit("no-at-sign"), {"GLOBAL_ANALYST"})) == "****@"


def test_row_access(spark):
    rows = spark.createDataFrame([("EUROPE",), ("AMERICAS",), ("EMEA",), (None,)], "source_region string")
    count = lambda roles: policies.row_access(rows, roles).count()
    assert count({"PLATFORM_ADMIN"}) == 4
    assert count({"JDE_AMERICAS_READER"}) == 1
    assert count({"JDE_AMERICAS_READER", "QAD_EMEA_READER"}) == 2
    assert count({"FINANCE_ANALYST"}) == 0


def test_fx_default_and_caller_rates(spark):
    rows = spark.createDataFrame([("EUR",), ("SEK",), (None,)], "currency_code string")
    got = {r.currency_code: float(r.fx_rate) for r in silver.with_fx(rows).collect()}
    assert got == {"EUR": 1.08, "SEK": 1.0, None: 1.0}
    own = spark.createDataFrame([("SEK", 0.1)], "currency_code string, fx_to_usd double").withColumn(
        "fx_to_usd", F.col("fx_to_usd").cast("decimal(10,6)")
    )
    got = {r.currency_code: float(r.fx_rate) for r in silver.with_fx(rows, own).collect()}
    assert got["SEK"] == 0.1 and got["EUR"] == 1.0


def test_three_feeds_equal_the_single_scan(bronze):
    from tiermill.plans.silver import all_sources

    one_pass, feeds = silver.orders(bronze.orders()), silver.orders(all_sources(bronze))
    assert feeds.count() == one_pass.count()
    assert feeds.exceptAll(one_pass).count() == 0


def test_surrogate_keys_are_dense_and_ordered(spark):
    keys_ = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    got = gold.number_rows(keys_, "k", "sk").orderBy("k").collect()
    assert [r.sk for r in got] == list(range(1, 501))


def test_readers_of_a_row_are_those_the_filter_lets_see_it(spark):
    frame = spark.createDataFrame([("EUROPE",), ("AMERICAS",), ("EMEA",), (None,)], "source_region string")
    readers = {"all": {"GLOBAL_ANALYST"}, "one": {"SAP_EUROPE_READER"}, "two": {"JDE_AMERICAS_READER", "QAD_EMEA_READER"}, "none": set()}
    got = {(r.reader, r.source_region) for r in frame.select("source_region", F.explode(policies.readable_by(readers)).alias("reader")).collect()}
    assert got == {(n, r.source_region) for n, roles in readers.items() for r in policies.row_access(frame, roles).collect()}


def test_masks_of_sources_in_one_pass(spark):
    frame = spark.createDataFrame([(s, "p", "a@b", 1.0) for s in ("SAP", "JDE", "QAD", None)], "source_system string, phone string, email string, credit_limit double")
    for roles in ({policies.ML_ENGINEER}, {policies.EXEC}, set()):
        got = policies.mask_sources(frame, policies.BINDINGS, roles)
        for source, bound in policies.BINDINGS.items():
            own = frame.where(F.col("source_system") == source)
            assert got.where(F.col("source_system") == source).collect() == policies.mask_table(own, bound, roles).collect()
        assert got.where("source_system IS NULL").collect() == frame.where("source_system IS NULL").collect()


def test_packed_keys_are_short_and_stay_different(spark):
    """64 hex digits in lower case become 32 bytes; whatever else a key is, it comes back and meets no other."""
    digits = "0123456789abcdef" * 4
    texts = [digits, digits.upper(), "g" * 64, "", "a", "é漢", "0" * 63, "0" * 65, bytes.fromhex(digits[:62]).decode("latin1"), "x" * 32, None]
    rows = spark.createDataFrame([(k,) for k in texts], "k string").select("k", keys.packed(F.col("k")).alias("p"))
    got = rows.select("k", "p", keys.unpacked(F.col("p")).alias("u")).collect()
    assert [r.u for r in got] == texts and got[0].p == bytearray.fromhex(digits) and got[-1].p is None
    assert len({bytes(r.p) for r in got if r.p is not None}) == len(texts) - 1
    assert [len(r.p) == 32 for r in got[:-1]] == [True] + [False] * (len(texts) - 2)
