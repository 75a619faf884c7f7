"""Versions agree with a row-by-row reading of the history."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tiermill.operators import scd

SCHEMA = "k string, effective_from timestamp, hash_diff string, note string"
START = datetime(2020, 1, 1)
COLUMNS = ["k", "effective_from", "hash_diff", "effective_to", "is_current", "record_version"]


def history(seed, keys=6, rows=220, hot=0.4, days=90):
    rng = random.Random(seed)
    made = []
    for i in range(rows):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(keys)}"
        at = START + timedelta(days=rng.randrange(days), hours=rng.randrange(3))
        made.append((key, at, rng.choice("ABC"), f"n{i % 5}"))
    return made


def expected(rows):
    best = {}
    for key, at, digest, _ in rows:
        best[key, at] = max(best.get((key, at), ""), digest)
    out = []
    for key in {k for k, _ in best}:
        kept = []
        for at in sorted(a for k, a in best if k == key):
            if not kept or kept[-1][1] != best[key, at]:
                kept.append((at, best[key, at]))
        for i, (at, digest) in enumerate(kept):
            end = kept[i + 1][0] if i + 1 < len(kept) else datetime(9999, 12, 31, 23, 59, 59)
            out.append((key, at, digest, end, i + 1 == len(kept), i + 1))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("chunk", ["hour", "day", "month", "year"])
def test_build_for_any_chunk(spark, chunk):
    rows = history(1)
    assert result(scd.build(spark.createDataFrame(rows, SCHEMA), "k", chunk=chunk)) == expected(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_apply_in_batches_equals_build_over_all(spark, tmp_path, seed):
    rows = sorted(history(seed), key=lambda r: r[1])
    cuts = [START + timedelta(days=d) for d in (0, 30, 45, 1000)]
    batches = [[r for r in rows if lo <= r[1] < hi] for lo, hi in zip(cuts, cuts[1:])]
    current = scd.build(spark.createDataFrame(batches[0], SCHEMA), "k")
    for i, batch in enumerate(batches[1:]):
        path = str(tmp_path / f"v{i}")
        scd.apply(current, spark.createDataFrame(batch, SCHEMA), "k").write.parquet(path)
        current = spark.read.parquet(path)
    assert result(current) == expected(rows)


def test_replay_changes_nothing(spark, tmp_path):
    rows = sorted(history(4, rows=60), key=lambda r: r[1])
    first, second = rows[:30], [r for r in rows[30:] if r[1] > rows[29][1]]
    base = scd.build(spark.createDataFrame(first, SCHEMA), "k")
    batch = spark.createDataFrame(second, SCHEMA)
    path = str(tmp_path / "v")
    scd.apply(base, batch, "k").write.parquet(path)
    once = spark.read.parquet(path)
    assert result(scd.apply(once, batch, "k")) == result(once)


def test_late_row_splits_the_stored_version(spark):
    day = lambda n: START + timedelta(days=n)
    stored = scd.build(spark.createDataFrame([("k", day(0), "A", ""), ("k", day(10), "B", "")], SCHEMA), "k")
    late = spark.createDataFrame([("k", day(5), "C", "")], SCHEMA)
    got = [(r[1], r[2], r[5]) for r in result(scd.apply(stored, late, "k"))]
    assert got == [(day(0), "A", 1), (day(5), "C", 2), (day(10), "B", 3)]


def test_new_key_and_untouched_key(spark):
    stored = scd.build(spark.createDataFrame([("old", START, "A", "")], SCHEMA), "k")
    batch = spark.createDataFrame([("new", START, "Z", "")], SCHEMA)
    assert [(r[0], r[5]) for r in result(scd.apply(stored, batch, "k"))] == [("new", 1), ("old", 1)]


def test_changes_hold_exactly_the_altered_rows(spark):
    day = lambda n: START + timedelta(days=n)
    stored = scd.build(spark.createDataFrame([(k, day(0), "A", "") for k in "abc"], SCHEMA), "k")
    batch = spark.createDataFrame([("a", day(1), "B", ""), ("b", day(1), "A", ""), ("d", day(1), "A", "")], SCHEMA)
    before, after = result(stored), result(scd.apply(stored, batch, "k"))
    assert result(scd.changes(stored, batch, "k")) == sorted(set(after) - set(before))


def test_one_key_holding_most_rows(spark):
    rows = [("hot", START + timedelta(hours=i), "ABCA"[i % 4], "") for i in range(3000)] + history(7, rows=100, hot=0)
    assert result(scd.build(spark.createDataFrame(rows, SCHEMA), "k")) == expected(rows)


@pytest.mark.parametrize("most", [1, 20, 1000])
def test_build_for_any_window_size(spark, most):
    rows = history(9, hot=0.5)
    assert result(scd.build(spark.createDataFrame(rows, SCHEMA), "k", most=most)) == expected(rows)


def test_hot_key_is_dealt_out_evenly(spark):
    """A key with a third of all rows, all in one month: no task holds much more than another."""
    rows = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 4000) END AS k",
        "timestampadd(SECOND, CAST(id * 37 % 2000000 AS INT), TIMESTAMP '2024-03-01') AS effective_from",
        "CAST(id % 7 AS STRING) AS hash_diff",
        "'' AS note",
    )
    built = scd.build(rows, "k", most=1000)
    tasks = [r["count"] for r in built.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 4 and max(tasks) < 2 * sorted(tasks)[len(tasks) // 2]
    text = built._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert built.exceptAll(scd.build(rows, "k", chunk="day").select(built.columns)).count() == 0
