import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tiermill import session
from tiermill.operators import scd
from tiermill.plans import streams
from tiermill.sources.tables import VersionedTable, refresh_derived
from tiermill.streaming import flows

ROWS = "k string, effective_from timestamp, hash_diff string"
EVENTS = "event_id string, event_timestamp timestamp, event_type string"


def test_versions_survive_a_restart(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    table = VersionedTable(spark, str(tmp_path / "silver"), "k", rows_per_part=2)
    first = [("a", datetime(2024, 1, 1), "x"), ("b", datetime(2024, 1, 1), "x")]
    second = [("a", datetime(2024, 1, 2), "y"), ("b", datetime(2024, 1, 2), "x"), ("c", datetime(2024, 1, 2), "z")]

    def run():
        stream = flows.file_stream(spark, folder, spark.createDataFrame([], ROWS).schema)
        query = flows.refresh_versions(stream, lambda df: df, table, state, every=None)
        query.awaitTermination(120)
        return sorted(tuple(r) for r in table.read().select("k", "hash_diff", "is_current", "record_version").collect())

    spark.createDataFrame(first, ROWS).write.mode("append").parquet(folder)
    assert run() == [("a", "x", True, 1), ("b", "x", True, 1)]
    assert run() == [("a", "x", True, 1), ("b", "x", True, 1)]
    spark.createDataFrame(second, ROWS).write.mode("append").parquet(folder)
    assert run() == [("a", "x", False, 1), ("a", "y", True, 2), ("b", "x", True, 1), ("c", "z", True, 1)]
    whole = scd.build(spark.createDataFrame(first + second, ROWS), "k")
    assert whole.exceptAll(table.read().select(whole.columns)).count() == 0
    # Four keys do not fit one part of two rows, and another flow is refused.
    spark.createDataFrame([("d", datetime(2024, 1, 3), "w")], ROWS).write.mode("append").parquet(folder)
    run()
    spark.createDataFrame([("d", datetime(2024, 1, 4), "v")], ROWS).write.mode("append").parquet(folder)
    run()
    assert table.parts() == 2 and table.open().count() == 4
    with pytest.raises(ValueError):
        table.refresh(spark.createDataFrame(first, ROWS), 99, "another")


def test_batches_in_any_order_equal_all_at_once(spark, tmp_path):
    """Late rows supersede closed versions; a batch that comes again, or was interrupted, changes nothing more."""
    draw = random.Random(3)
    rows = [(f"k{draw.randrange(7)}", datetime(2024, 1 + draw.randrange(5), 1 + draw.randrange(28)), draw.choice("xyz")) for _ in range(90)]
    table, whole = VersionedTable(spark, str(tmp_path / "t"), "k", rows_per_part=3), None
    shown = lambda df: sorted(map(str, df.select("k", "effective_from", "hash_diff", *scd.VERSION_COLUMNS).collect()))
    for number in range(6):
        batch = spark.createDataFrame(rows[15 * number : 15 * number + 15], ROWS)
        table.refresh(batch, number)
        # One snapshot of everything, applied to as a whole.
        path = str(tmp_path / f"whole{number}")
        (scd.build(batch, "k") if whole is None else scd.apply(whole, batch, "k")).write.parquet(path)
        whole = spark.read.parquet(path)
        assert shown(table.read()) == shown(whole)
        if number == 3:
            # As if the result had been written but put in place only in part.
            table.folder("open", f"parts={table.parts()}").delete()
            table.refresh(batch, number)
            assert shown(table.read()) == shown(whole)
    with pytest.raises(ValueError):
        table.refresh(batch, 2)


def test_refresh_writes_what_the_batch_touches(spark, tmp_path):
    """Closed versions are never written again; open ones only in the parts of the batch's keys."""
    rows = spark.range(4000).selectExpr("concat('k', id) AS k", "TIMESTAMP '2024-01-01' AS effective_from", "'x' AS hash_diff")
    table = VersionedTable(spark, str(tmp_path / "t"), "k", rows_per_part=250)
    table.refresh(rows, 0)
    assert table.parts() == 16

    def files(kind):
        found = {}
        for path in (tmp_path / "t" / kind).rglob("*.parquet"):
            found[str(path)] = path.stat().st_size
        return found

    largest = table.open().groupBy(table.part_of(16)).count().agg(F.max("count")).first()[0]
    assert largest < 2 * 250
    for number, part in ((1, 1), (2, 40), (3, 4000)):
        before = files("open") | files("closed")
        changed = rows.where(f"substr(k, 2) < {part}").withColumns(
            {"effective_from": F.col("effective_from") + F.expr(f"INTERVAL {number} DAY"), "hash_diff": F.lit(f"y{number}")}
        )
        table.refresh(changed, number)
        after = files("open") | files("closed")
        gone = [f for f in before if f not in after]
        assert all("/open/" in f for f in gone)
        if part == 1:
            assert len({f.split("part=")[2].split("/")[0] if f.count("part=") > 1 else f.split("/part=")[1].split("/")[0] for f in gone}) == 1
    assert table.read().count() == 4000 + 1 + 40 + 4000


def shown(df):
    return sorted(map(str, df.select("k", "effective_from", "hash_diff", *scd.VERSION_COLUMNS).collect()))


@pytest.mark.parametrize("most, rows_per_task", [(100_000, 250_000), (8, 4)])
def test_refresh_moves_rows_without_computed_columns(spark, tmp_path, most, rows_per_task):
    """Key and digest are made again from a row's other columns; keys of many rows, and parts dealt to several tasks, give the same."""
    draw = random.Random(5)
    at = lambda: datetime(2024, 1 + draw.randrange(5), 1 + draw.randrange(28))
    # One key has a third of all rows, one has no id.
    rows = [(draw.choice(["a", "a", "a", None, "b", "c", "d", "e", "f"]), at(), draw.choice("xyz")) for _ in range(90)]
    bare = "id string, effective_from timestamp, text string"
    computed = {"k": F.coalesce(F.concat(F.lit("key "), F.col("id")), F.lit("none")), "hash_diff": F.md5("text")}
    table = VersionedTable(spark, str(tmp_path / "t"), "k", 3, computed)
    table.MOST, table.ROWS_PER_TASK = most, rows_per_task
    whole = None
    for number in range(3):
        batch = spark.createDataFrame(rows[30 * number : 30 * number + 30], bare).withColumns(computed)
        table.refresh(table.staged(batch, str(tmp_path / f"batch{number}")), number)
        path = str(tmp_path / f"whole{number}")
        (scd.build(batch, "k") if whole is None else scd.apply(whole, batch, "k")).write.parquet(path)
        whole = spark.read.parquet(path)
    assert shown(table.read()) == shown(whole)
    assert table.read().where(~F.col("k").eqNullSafe(computed["k"]) | (F.col("hash_diff") != computed["hash_diff"])).isEmpty()
    pending = spark.read.parquet(table.folder("pending", "refresh", "batch=2").path)
    assert "id" in pending.columns and not {"k", "hash_diff"} & set(pending.columns)
    # Laid out by parts, it is put in place without being moved.
    assert all(n.startswith("part=") for n in table.folder("pending", "refresh", "batch=2", "kind=open").names())


@pytest.mark.parametrize("most", [100_000, 4])
def test_rows_without_a_time_or_key_stand_beside_the_stored(spark, tmp_path, most):
    """An open version is kept as it is when its key's new rows have no time, or when it has no key; later batches keep both."""
    table, day = VersionedTable(spark, str(tmp_path / "t"), "k", rows_per_part=2), lambda n: datetime(2024, 1, n)
    table.MOST = most
    batches = [
        [("a", None, "x"), ("b", day(1), "x"), (None, day(1), "x"), ("c", day(1), "x")],
        [("a", None, "y"), ("b", None, "y"), (None, day(2), "y"), ("c", day(2), "y")],
        [("d", day(3), "z"), ("a", day(3), "z")],
    ]
    for number, rows in enumerate(batches):
        table.refresh(spark.createDataFrame(rows, ROWS), number)
    got = sorted((r.k or "", r.effective_from and r.effective_from.day or 0, r.hash_diff, r.is_current, r.record_version) for r in table.read().collect())
    assert got == [
        ("", 1, "x", True, 1), ("", 2, "y", True, 1), ("a", 0, "y", False, 1), ("a", 3, "z", True, 2), ("b", 0, "y", True, 1),
        ("b", 1, "x", True, 1), ("c", 1, "x", False, 1), ("c", 2, "y", True, 2), ("d", 3, "z", True, 1),
    ]


def test_a_flow_leaves_no_copies(spark, tmp_path, monkeypatch):
    """Copies of micro-batches and notes of a refresh are gone when it is over, and the session's settings are as before."""
    folder, shared = str(tmp_path / "in"), tmp_path / "shared"
    monkeypatch.setattr(session, "_local_root", lambda: str(shared))
    table = VersionedTable(spark, str(tmp_path / "t"), "k", rows_per_part=2)
    derive = (lambda df: df.select("k", "hash_diff"), str(tmp_path / "d"))
    for day in (1, 3, 2):
        spark.createDataFrame([(c, datetime(2024, 1, day), f"{day}") for c in "abc"], ROWS).write.mode("append").parquet(folder)
        stream = flows.file_stream(spark, folder, spark.createDataFrame([], ROWS).schema)
        flows.refresh_versions(stream, lambda df: df, table, str(tmp_path / "state"), every=None, derive=derive).awaitTermination()
    assert table.read().count() == 9
    assert [p for p in shared.rglob("*.parquet")] == [] and spark.conf.get(session.SHUFFLES_GO, None) is None


def test_derived_parts_follow(spark, tmp_path):
    """A part of which nothing is left in the derived table is removed there."""
    table, path = VersionedTable(spark, str(tmp_path / "t"), "k", rows_per_part=1), str(tmp_path / "d")
    make = lambda df: df.where("hash_diff <> 'gone'").select("k", "hash_diff")
    rows = [(c, datetime(2024, 1, 1), "here") for c in "abcdefgh"]
    refresh_derived(table.refresh(spark.createDataFrame(rows, ROWS), 0), make, path, "k")
    assert spark.read.parquet(path).count() == 8
    rows = [(c, datetime(2024, 1, 2), "gone" if c < "e" else "there") for c in "abcdef"]
    refresh_derived(table.refresh(spark.createDataFrame(rows, ROWS), 1), make, path, "k")
    got = sorted((r.k, r.hash_diff) for r in spark.read.parquet(path).collect())
    assert got == [("e", "there"), ("f", "there"), ("g", "here"), ("h", "here")]


def test_a_derived_row_stays_where_its_version_is(spark, tmp_path):
    """Rows that are derived one by one are written from the parts they lie in: a file a part, the same rows as when moved."""
    table = VersionedTable(spark, str(tmp_path / "t"), "k", rows_per_part=50)
    rows = spark.range(700).selectExpr("concat('k', id) AS k", "TIMESTAMP '2024-01-01' AS effective_from", "'x' AS hash_diff")
    make = lambda df: df.where("k <> 'k7'").select("k", F.upper("hash_diff").alias("up"))
    for number, share in enumerate((1, 3)):
        later = F.col("effective_from") + F.expr(f"INTERVAL {number} DAY")
        batch = rows.where(f"substr(k, 2) % {share} = 0").withColumns({"effective_from": later, "hash_diff": F.lit(f"x{number}")})
        touched = table.refresh(batch, number)
        for name, row_by_row in (("stays", True), ("moves", False)):
            refresh_derived(touched, make, str(tmp_path / name), "k", row_by_row)
    got, want = (sorted(map(tuple, spark.read.parquet(str(tmp_path / n)).select("k", "up", "part").collect())) for n in ("stays", "moves"))
    assert got == want and len(got) == 699
    for part in range(table.parts()):
        assert len(list((tmp_path / "stays" / f"parts={table.parts()}" / f"part={part}").glob("*.parquet"))) == 1


def test_append_twice_with_one_checkpoint_gives_no_duplicates(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(10).write.parquet(folder)
    for _ in range(2):
        stream = flows.file_stream(spark, folder, spark.range(1).schema)
        flows.append_to(stream, out, state, every=None).awaitTermination(120)
    assert spark.read.parquet(out).count() == 10


def test_late_and_repeated_events_correct_their_day(spark, tmp_path):
    folder, root, state = (str(tmp_path / n) for n in ("in", "counts", "state"))
    days = [5, 6, 7, 2, 9, 5]
    for i, day in enumerate(days):
        row = ("5" if day == 5 else str(i), datetime(2024, 1, day, 5), "click")
        spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(folder)
        stream = flows.file_stream(spark, folder, spark.createDataFrame([], EVENTS).schema)
        flows.refresh_daily_counts(stream, root, state, every=None).awaitTermination()
    batches = [(r.rows, r.fresh, r.compared) for r in flows.read_batches(spark, root).orderBy("batch").collect()]
    # The last row's slot holds one id; the other batches meet none.
    assert batches == [(1, 1, 0)] * 5 + [(1, 0, 1)]
    got = flows.read_daily_counts(spark, root).collect()
    assert sorted((r.event_date.day, r.n_events) for r in got) == [(2, 1), (5, 1), (6, 1), (7, 1), (9, 1)]


def test_a_landing_of_many_files_is_one_batch(spark, tmp_path):
    """The number of micro-batches, each of which meets all that is stored, is that of the landings and not of their files."""
    events = spark.range(40).selectExpr("CAST(id AS STRING) AS event_id", "TIMESTAMP '2024-01-01' AS event_timestamp", "'x' AS event_type")
    root, state = (str(tmp_path / n) for n in ("counts", "state"))
    for stream in streams.landed(spark, [events.where(f"event_id % 2 = {part}").repartition(5) for part in (0, 1, 0)]):
        flows.refresh_daily_counts(stream, root, state, every=None).awaitTermination()
    batches = [(r.rows, r.fresh) for r in flows.read_batches(spark, root).orderBy("batch").collect()]
    assert batches == [(20, 20), (20, 20), (20, 0)]


def test_counts_of_events_by_brute_force(spark, tmp_path):
    """Rows repeated within and across batches, of any day or none, without an id or a type; ids compacted in between."""
    draw = random.Random(4)
    folder, root, state = (str(tmp_path / n) for n in ("in", "counts", "state"))
    rows = []
    for batch in range(5):
        made = [
            (draw.choice([None, "a", "b", "c", "d"]), draw.choice([None, datetime(2024, 1, draw.randrange(1, 4), 5)]), draw.choice(["x", "y", None]))
            for _ in range(12)
        ]
        rows += made
        spark.createDataFrame(made, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        stream = flows.file_stream(spark, folder, spark.createDataFrame([], EVENTS).schema)
        flows.refresh_daily_counts(stream, root, state, every=None, buckets=2).awaitTermination()
        if batch == 2:
            flows.compact_daily_ids(spark, root, 2)
    want = {}
    for i, at, kind in set(rows):
        key = (at and at.date(), kind)
        want.setdefault(key, set()).add(i)
    got = {(r.event_date, r.event_type): r.n_events for r in flows.read_daily_counts(spark, root).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    whole = flows.daily_counts(spark.createDataFrame(rows, EVENTS)).collect()
    assert {(r.event_date, r.event_type): r.n_events for r in whole} == got


def test_payloads_that_do_not_parse_are_marked(spark):
    events = spark.createDataFrame([('{"order_id": "7", "amount_usd": 1.5}',), ("{'order_id': '7'}",), (None,), ('{"order_id": 7}',)], "event_payload string")
    got = flows.parse_events(events, {"order_id": "string $.order_id", "amount": "double $.amount_usd"}).collect()
    assert [(r.order_id, r.amount, r.is_rejected) for r in got] == [("7", 1.5, False), (None, None, True), (None, None, True), ("7", None, False)]
