import json
from datetime import date, datetime
from decimal import Decimal

import pytest

from tiermill.operators import mapping
from tiermill.schemas import ORDER_FILE, schema
from tiermill.sources import files, tables


def test_csv_header_quotes_and_null_tokens(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(
        "order_id,order_date,customer_id,currency_code,net_amount,order_status\n"
        '1,2024-03-15,"Smith, Co",EUR,12.5,OPEN\n2,bad,N/A,null,x,NULL\n3,,"",USD,7,"a ""b"""\n'
    )
    got = {r.order_id: tuple(r)[1:] for r in files.read_csv(spark, str(path), ORDER_FILE).collect()}
    assert got["1"] == (date(2024, 3, 15), "Smith, Co", "EUR", Decimal("12.5000"), "OPEN")
    assert got["2"] == (None, None, None, None, None)
    assert got["3"] == (None, None, "USD", Decimal("7.0000"), 'a "b"')


def test_lenient_load_keeps_good_rows_and_reports_bad_lines(spark, tmp_path):
    (tmp_path / "f.csv").write_text("1,2024-01-01,c,EUR,1.23456,OPEN\n2,only\n3,2024-01-01,c,EUR,zz,OPEN,extra\n4,x,c,EUR,y,OPEN\n")
    loaded, bad = files.load_lenient(spark, str(tmp_path), ORDER_FILE)
    rows = {r.order_id: r for r in loaded.collect()}
    assert set(rows) == {"1", "4"} and rows["1"].net_amount == Decimal("1.2346") and rows["1"].file_name == "f.csv"
    assert rows["4"].order_date is None and rows["4"].net_amount is None
    assert sorted(r.record_data for r in bad.collect()) == ["2,only", "3,2024-01-01,c,EUR,zz,OPEN,extra"]


def test_lenient_load_does_not_depend_on_selected_columns(spark, tmp_path):
    (tmp_path / "f.csv").write_text("1,2024-01-01,c,EUR,1,OPEN\n2,only\n")
    loaded, _ = files.load_lenient(spark, str(tmp_path), ORDER_FILE)
    assert [r.order_id for r in loaded.select("order_id").collect()] == ["1"]


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": "x", "n": 1}, {"a": "y"}]))
    got = files.read_json(spark, str(tmp_path), schema("a, n bigint")).collect()
    assert sorted((r.a, r.n) for r in got) == [("x", 1), ("y", None)]


def test_align_keeps_missing_values_missing(spark):
    frame = spark.createDataFrame([("DATA_CENTER", None, 1), ("X" * 300, "y" * 300, 2)], "industry_code string, city string, extra int")
    got = files.align(frame, ["city", "industry_code", "load_id", "absent"], {"industry_code": ({"DATA_CENTER": "DATACENTER"}, 10)})
    assert got.columns == ["CITY", "INDUSTRY_CODE"]
    assert [tuple(r) for r in got.collect()] == [(None, "DATACENTER"), ("y" * 200, "X" * 10)]


def test_stamp(spark):
    row = files.stamp(spark.createDataFrame([("1", None)], "a string, b string"), datetime(2024, 5, 1, 9), "B7").first()
    assert (row.batch_id, row.load_date, row.is_deleted, row.change_type, len(row.load_id)) == ("B7", date(2024, 5, 1), False, "INSERT", 36)
    assert json.loads(row.raw_record) == {"a": "1"}


def test_mapping_from_configuration_rows(spark):
    config = spark.createDataFrame(
        [("SAP", "ORDERS", 2, "n", "twice", "n * 2", "bigint", True), ("SAP", "ORDERS", 1, "a", "name", None, "string", True),
         ("SAP", "ORDERS", 3, "a", "off", None, "string", False), ("JDE", "ORDERS", 1, "a", "other", None, "string", True)],
        "source_system string, source_table string, stt_id int, source_column string, target_column string, "
        "transformation string, data_type string, is_active boolean",
    )
    frame = spark.createDataFrame([("x", 4)], "a string, n int")
    got = mapping.apply(frame, mapping.rules_from(config, "SAP", "ORDERS"))
    assert got.columns == ["name", "twice"] and tuple(got.first()) == ("x", 8)


def test_append_lays_out_by_date(spark, tmp_path):
    path = str(tmp_path / "log")
    frame = spark.createDataFrame([(date(2024, 1, d), i) for d in (1, 2) for i in range(5)], "load_date date, id int")
    tables.append(frame, path, ["load_date"], ["id"])
    tables.append(frame, path, ["load_date"], ["id"])
    assert spark.read.parquet(path).where("load_date = '2024-01-01'").count() == 10


def test_versions_ignore_unfinished_ones(spark, tmp_path):
    """A result that was not written to its end is written anew; readers never see what is pending."""
    schema = "id string, effective_from timestamp, hash_diff string"
    table = tables.VersionedTable(spark, str(tmp_path / "t"), "id", rows_per_part=1)
    assert table.read() is None and table.open() is None and table.parts() == 0
    day = lambda n: datetime(2024, 1, n)
    table.refresh(spark.createDataFrame([("a", day(1), "x"), ("b", day(1), "x")], schema), 1)
    second = spark.createDataFrame([("a", day(2), "y")], schema)
    unfinished = tmp_path / "t" / "pending" / "refresh" / "batch=2"
    (unfinished / "kind=open").mkdir(parents=True)
    (unfinished / "kind=open" / "part-0.parquet").write_bytes(b"cut off")
    assert sorted(r.id for r in table.read().collect()) == ["a", "b"]
    table.refresh(second, 2)
    got = sorted((r.id, r.hash_diff, r.is_current, r.record_version) for r in table.read().collect())
    assert got == [("a", "x", False, 1), ("a", "y", True, 2), ("b", "x", True, 1)]
    # Only the last result is kept beside the table.
    assert table.folder("pending", "refresh").values("batch") == [2]
    with pytest.raises(ValueError):
        table.refresh(second, 3, "another")
