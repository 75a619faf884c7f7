import random
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiermill.operators import features, neighbours, search, vectors

AS_OF = date(2020, 6, 1)
ORDERS = "customer_hk string, order_date date, net_amount_usd decimal(18,4), is_current boolean, is_quarantined boolean"


def orders(spark, *ages, amount="10.0000", customer="c"):
    rows = [(customer, AS_OF - timedelta(days=a), Decimal(amount), True, False) for a in ages]
    return spark.createDataFrame(rows, ORDERS)


def test_window_edges(spark):
    row = features.revenue_features(orders(spark, 0, 7, 8, 365, 366, 730, 731), AS_OF).first()
    assert float(row.rev_l7d_usd) == 10 and float(row.rev_l30d_usd) == 20
    assert float(row.rev_l365d_usd) == 30 and float(row.rev_prev_year_usd) == 20
    assert (row.order_count_l365, row.total_orders, row.days_since_last_order) == (3, 6, 7)


def test_order_on_the_date_itself_is_unseen(spark):
    assert features.revenue_features(orders(spark, 0, -5), AS_OF).count() == 0


def test_later_orders_change_nothing(spark):
    past = orders(spark, 3, 40, 400)
    more = past.unionByName(orders(spark, 0, -1, -300))
    assert features.revenue_features(past, AS_OF).collect() == features.revenue_features(more, AS_OF).collect()


def test_many_dates_equal_single_dates(spark):
    frame = orders(spark, 1, 2, 30, 31, 90, 91).unionByName(orders(spark, 5, customer="d"))
    dates = [AS_OF - timedelta(days=i) for i in range(3)]
    many = features.revenue_features_for(frame, dates)
    for day in dates:
        single = features.revenue_features(frame, day).select(many.columns)
        assert many.where(F.col("as_of_date") == day).exceptAll(single).count() == 0
        assert single.exceptAll(many.where(F.col("as_of_date") == day)).count() == 0


def test_quarantined_and_old_versions_are_ignored(spark):
    frame = orders(spark, 5)
    assert features.revenue_features(frame.withColumn("is_quarantined", F.lit(True)), AS_OF).count() == 0
    assert features.revenue_features(frame.withColumn("is_current", F.lit(False)), AS_OF).count() == 0


def test_scores(spark):
    quiet = features.revenue_features(orders(spark, 800), AS_OF).first()
    assert quiet.churn_risk_score == 1.0
    busy = features.revenue_features(orders(spark, 10, 50), AS_OF).first()
    assert busy.churn_risk_score == pytest.approx(10 / 365 * 0.7) and busy.upsell_propensity == 0.75
    even = features.revenue_features(orders(spark, 10, 40, 80), AS_OF).first()
    assert even.upsell_propensity == 0.25


def test_band_edges(spark):
    frame = spark.createDataFrame([(0.71,), (0.7,), (0.41,), (0.4,)], "s double")
    assert [r[0] for r in frame.select(features.risk_band(F.col("s"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_predictions_are_written_once(spark):
    rows = features.revenue_features(orders(spark, 5).unionByName(orders(spark, 9, customer="d")), AS_OF)
    first = features.churn_predictions(rows)
    assert first.count() == 2
    assert features.churn_predictions(rows, first).count() == 0
    assert features.churn_predictions(rows, first.where("entity_hk = 'c'")).first().entity_hk == "d"


LINES = "customer_hk string, product_family string, order_date date, line_amount_usd decimal(18,4), is_quarantined boolean"


def lines(spark, rows):
    day = AS_OF - timedelta(days=10)
    return spark.createDataFrame([(c, f, day, Decimal(str(a)), False) for c, f, a in rows], LINES)


BASKETS = [("a", "X", 30), ("a", "Y", 10), ("b", "X", 5), ("c", "Y", 1), ("d", "X", 2), ("d", "Y", 2), ("d", "Z", 4), ("a", "X", 10)]


def test_concentration(spark):
    got = {r.customer_hk: r.product_mix_hhi for r in features.product_mix(lines(spark, BASKETS), AS_OF).collect()}
    assert got["a"] == pytest.approx(0.8**2 + 0.2**2) and got["b"] == 1.0 and got["d"] == pytest.approx(0.375)


@pytest.mark.parametrize("width", [1, 2, 1024])
def test_joint_counts_for_any_block_width(width):
    import pandas as pd

    batch = pd.DataFrame({"owned": [["X", "Y"], ["X"], ["Y"], ["X", "Y", "Z"]]})
    parts = pd.concat(list(features._joint_counter(width)(iter([batch]))))
    got = {(r.family, r.other): r.customers for r in parts.itertuples()}
    assert got == {
        ("X", "X"): 3, ("Y", "Y"): 3, ("Z", "Z"): 1, ("X", "Y"): 2, ("Y", "X"): 2,
        ("X", "Z"): 1, ("Z", "X"): 1, ("Y", "Z"): 1, ("Z", "Y"): 1,
    }


def test_affinity(spark):
    got = {(r.customer_hk, r.product_family): r for r in features.product_affinity(lines(spark, BASKETS), AS_OF).collect()}
    assert got["a", "X"].purchase_count_l365 == 2 and got["a", "X"].revenue_share_pct == pytest.approx(80)
    assert got["a", "X"].cross_sell_score == pytest.approx(2 / 3)
    assert got["d", "X"].cross_sell_score == 1.0
    assert got["b", "X"].cross_sell_score == 0.0


def test_narrative_defaults(spark):
    people = spark.createDataFrame(
        [("m", "Acme", None, None, None, "DE", True)],
        "master_customer_hk string, customer_name string, industry string, region string, segment string, country_code string, is_current boolean",
    )
    none = spark.createDataFrame([], "master_customer_hk string, rev_l365d_usd decimal(18,4), order_count_l90 bigint, churn_risk_score double")
    row = features.narratives(people, none).first()
    assert row.customer_summary == (
        "Customer: Acme. Industry: Unknown. Region: Unknown. Segment: Unknown. Revenue 12mo: $          0. Orders 90d: 0. Churn risk: LOW"
    )
    assert row.revenue_band == "SMB" and row.tags == [None, None]


def test_large_and_negative_amounts_are_not_cut(spark):
    frame = spark.createDataFrame([(Decimal("123456789012.5"),), (Decimal("-1234.4"),)], "a decimal(18,4)")
    assert [r[0] for r in frame.select(features.whole_dollars(F.col("a"))).collect()] == ["123,456,789,013", "     -1,234"]


def test_vector_search_and_upsert(spark):
    stored = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<float>")
    got = vectors.top_k(stored, [1.0, 0.0], 2).collect()
    assert [(r.vec_id, r.similarity) for r in got] == [(1, 1.0), (3, 1.0)]
    assert vectors.top_k(stored, [1.0, 0.0], 9).count() == 3

    target = spark.createDataFrame([("a", "old", "v"), ("b", "old", None)], "k string, txt string, vec string")
    source = spark.createDataFrame([("b", None), ("c", "new")], "k string, txt string")
    merged = vectors.upsert(target, source, "k", ["vec"])
    assert sorted(map(tuple, merged.collect())) == [("a", "old", "v"), ("b", None, None), ("c", "new", None)]
    filled = vectors.fill_missing(merged, "vec", F.lit("todo"), "txt")
    assert sorted(map(tuple, filled.collect())) == [("a", "old", "v"), ("b", None, None), ("c", "new", "todo")]


def test_facets(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "domain string, tier string")
    assert search.facet_filter(frame, {"domain": "a", "tier": search.ALL}).count() == 2
    got = {(r.facet, r.value): r.n for r in search.facet_counts(frame, ["domain", "tier"]).collect()}
    assert got == {("domain", "a"): 2, ("domain", "b"): 1, ("tier", "x"): 2, ("tier", "y"): 1}


def test_changes_at_borders_equal_single_dates(spark):
    """Dates far apart, in any order and repeated; days with several orders, unknown amounts, a customer without a key."""
    draw = random.Random(8)
    rows = [
        (draw.choice(["a", "b", None]), AS_OF - timedelta(days=draw.randrange(1200)), draw.choice([None, Decimal("1.5"), Decimal("20")]),
         draw.random() < 0.95, draw.random() < 0.05)
        for _ in range(150)
    ]
    rows += [("only", AS_OF - timedelta(days=500), None, True, False), ("late", AS_OF, Decimal(1), True, False)]
    frame = spark.createDataFrame(rows, ORDERS)
    dates = [AS_OF - timedelta(days=d) for d in (0, 3, 3, 700, 40, 41, 365, 1100, 1300)]
    many = features.revenue_features_for(frame, dates)
    single = [features.revenue_features(frame, d).select(many.columns) for d in sorted(set(dates))]
    want = sorted(str(r) for s in single for r in s.collect())
    assert sorted(map(str, many.collect())) == want


def test_cost_does_not_follow_the_number_of_dates(spark):
    """At most six changes leave a customer-day, for one date or for a year of them; two exchanges hold customer-days."""
    frame = spark.range(3000).selectExpr(
        "concat('c', id % 50) AS customer_hk", "date_sub(DATE '2019-01-01', CAST(id % 400 AS INT)) AS order_date",
        "CAST(1 AS decimal(18,4)) AS net_amount_usd", "true AS is_current", "false AS is_quarantined",
    )
    for days in (2, 365):
        many = features.revenue_features_for(frame, [AS_OF - timedelta(days=d) for d in range(days)])
        text = many._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 2 and many.count() == 50 * days


def test_trigram_index_finds_what_a_scan_finds(spark, tmp_path):
    """Texts of all kinds, appended in batches, one of which comes again; queries with wildcards, of other scripts, and short ones."""
    draw = random.Random(7)
    alphabet = ["a", "B", "b", "c", "%", "_", "é", "É", "漢", " ", "\\", "\n"]
    rows = [
        (i, None if i % 17 == 0 else "".join(draw.choice(alphabet) for _ in range(draw.randrange(40))), draw.choice([None, "", "ab", "Bca"]))
        for i in range(300)
    ]
    frame, root = spark.createDataFrame(rows, "id int, text string, source string"), str(tmp_path / "index")
    for batch, part in enumerate([frame.where("id < 100"), frame.where("id >= 200"), frame.where("id BETWEEN 100 AND 199")]):
        search.append_texts(part.repartition(3), root, ["text", "source"], batch)
    search.append_texts(frame.where("id >= 200"), root, ["text", "source"], 1)
    for query in ["abc", "BCA", "a%b", "b_", "éÉ漢", "a b\n", "ab", "", "c\\a", "bcab", "漢"]:
        want = sorted(r.id for r in search.keyword(frame, query, ["text", "source"]).collect())
        assert sorted(r.id for r in search.indexed_keyword(spark, root, query, ["text", "source"]).collect()) == want, query
    assert search.candidates(spark, root, "abca").count() < 100


def test_the_index_and_its_candidates_have_a_row_for_64_texts(spark, tmp_path, monkeypatch):
    """Frequent trigrams are bits, in the postings and in what is sent to the texts; characters beyond the first plane are one each."""
    root, kept = str(tmp_path / "index"), []
    monkeypatch.setattr(search, "stored", lambda df, purpose: kept.append(df.count()) or df)
    frame = spark.range(20_000).selectExpr("id", "IF(id % 10 = 0, 'x\U0001F600yz', 'abcde') AS text").coalesce(1)
    search.append_texts(frame, root, ["text"], 0)
    words = -(-20_000 // 64)
    assert spark.read.parquet(f"{root}/postings").groupBy("gram").count().where(f"count <> {words}").isEmpty()
    grams = {r.gram for r in spark.read.parquet(f"{root}/postings").select("gram").distinct().collect()}
    assert grams == {"abc", "bcd", "cde", "x\U0001F600y", "\U0001F600yz"}
    assert search.candidates(spark, root, "bcde").count() == search.indexed_keyword(spark, root, "BCDE", ["text"]).count() == 18_000
    assert search.indexed_keyword(spark, root, "\U0001F600yz", ["text"]).count() == 2_000
    assert kept == [words, words]


def test_cells_find_the_nearest(spark, tmp_path):
    """Exactly, whatever the number of cells, parts and blocks, with copies, vectors without a direction and few vectors."""
    draw = np.random.default_rng(3)
    points = np.round(draw.normal(size=(400, 6)) + 3 * draw.normal(size=(8, 6))[draw.integers(0, 8, 400)], 2)
    points[50:60] = points[40:50]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(900, None), (901, [0.0] * 6), (902, [1.0]), (903, [float("nan")] * 6), (904, [None] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    units = points.astype(np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    asked = frame.where("vec_id % 10 = 0 OR vec_id > 899")
    want = {}
    for q in range(0, 400, 10):
        scores = np.round(units @ units[q], 9)
        want[q] = sorted(range(400), key=lambda i: (-scores[i], i))[:5]
    for cells, first, parts, blocks in ((16, 1, 100_000, 10_000), (5, 2, 20, 7), (1, 1, 50, 10_000)):
        index = neighbours.build(frame, str(tmp_path / f"{cells}"), 6, cells=cells, sample=100)
        got = neighbours.top_k_many(index, asked, 5, first=first, part_rows=parts, block_rows=blocks).collect()
        found = {}
        for r in sorted(got, key=lambda r: r.rank):
            found.setdefault(r.query, []).append(r.id)
        assert found == want
        if cells == 16:
            near = neighbours.top_k_many(index, asked, 5, first=3, exact=False).collect()
            recall = sum(r.id in want[r.query] for r in near) / sum(map(len, want.values()))
            assert recall >= 0.9
    few = neighbours.build(frame.where("vec_id < 3"), str(tmp_path / "few"), 6)
    assert len(neighbours.top_k_many(few, frame.where("vec_id = 1"), 5).collect()) == 3
    none = neighbours.build(frame.where("vec_id > 899"), str(tmp_path / "none"), 6)
    assert neighbours.top_k_many(none, asked).collect() == []
