from datetime import date

from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.functions import parsing as p
from shelfwise.operators import quality
from shelfwise.operators import common
from shelfwise.sources import readers, sinks


def _map(make, values, fn):
    df = make("i int, s string", list(enumerate(values)))
    return [r.v for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]


def test_number(make):
    assert _map(make, ["5.177E1", " 51.77 ", "", None, "n/a", "1e", "-3", ".5", "1d"], p.number) == [
        51.77, 51.77, None, None, None, None, -3.0, 0.5, None]


def test_iso_date(make):
    assert _map(make, ["2026-03-01", "3/1/2026", "12/31/2025", "31.12.2025", "2026-02-30", "", None], p.iso_date) == [
        date(2026, 3, 1), date(2026, 3, 1), date(2025, 12, 31), None, None, None, None]


def test_location_code(make):
    assert _map(make, ["25-Main - DC", "1 -Main - NORTH", "007-X", "1234-Z", "HUB", None], p.location_code) == [
        "LOC-025", "LOC-001", "LOC-007", "LOC-1234", "HUB", None]


def test_flags_and_sentinels(make):
    assert _map(make, ["Y", " y", "N", "-", "", None], p.yes) == [True, True, False, False, False, False]
    assert _map(make, ["TRUE", "no", "1", ""], p.boolean) == [True, False, None, None]
    assert _map(make, [" a ", "~", "---", "UNKNOWN", "N/A", " "], p.meaningful) == ["a", None, None, None, None, None]


def test_tran_code_and_transfer_ends(make):
    assert _map(make, ["SL-I - SALE-INTERCO", "SL - SALE", "X", None], p.tran_code) == ["SL-I", "SL", "X", ""]
    assert _map(make, ["T2501", "T0103", "T251", "X2501"], lambda c: p.transfer_ends(c)[0]) == ["LOC-025", "LOC-001", None, None]
    assert _map(make, ["T2501", "T0103", "T251", "X2501"], lambda c: p.transfer_ends(c)[1]) == ["LOC-001", "LOC-003", None, None]


def test_ids(make):
    df = make("d date, s string, l string, i string", [(date(2026, 1, 2), "P", "LOC-001", "9"), (date(2026, 1, 2), "P", "LOC-001", None)])
    got = {r.v for r in df.select(p.sale_id(F.col("d"), F.col("s"), F.col("l"), F.col("i")).alias("v")).collect()}
    assert got == {"AC-2026-01-02-P-LOC-001-INV9", "AC-2026-01-02-P-LOC-001"}


def test_spreadsheet_guard(make):
    assert _map(make, ["=1", "+a", "-b", "@c", "\td", "\re", "f=", None], p.spreadsheet_safe) == [
        "'=1", "'+a", "'-b", "'@c", "'\td", "'\re", "f=", ""]


def test_csv_load_types_and_generated_columns(spark, tmp_path):
    (tmp_path / "purchase_orders.csv").write_text(
        "PONumber,LineNumber,PartNumber,SupplierID,StoreID,PODate,ExpectedDelivery,ActualDelivery,QtyOrdered,QtyReceived,UnitCost,Status,Extra\n"
        "PO1, 1 ,P1,S1,LOC-001,2026-01-01,2026-01-10,2026-01-12,10,12,3.5,received,zzz\n"
        "PO2,1,P1,S1,LOC-001,1/2/2026,2026-01-10,,0,0,bad,open,\n,,,,,,,,,,,,\n")
    rows = {r.po_number: r for r in readers.load(spark, str(tmp_path), "purchase_orders").collect()}
    assert set(rows) == {"PO1", "PO2"}
    assert rows["PO1"].fill_rate_pct == 1.0 and rows["PO1"].lead_time_variance == 2 and rows["PO1"].line_number == 1
    assert rows["PO2"].fill_rate_pct is None and rows["PO2"].unit_cost is None and rows["PO2"].po_date == date(2026, 1, 2)
    assert readers.load(spark, str(tmp_path), "sku_master").count() == 0


def test_sources_by_format(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    spark.range(4).write.json(str(tmp_path / "j"))
    assert readers.read_source(spark, "parquet", str(tmp_path), "t").count() == 3
    assert readers.read_source(spark, "json", str(tmp_path), "j").count() == 4


def test_conform_adds_missing_columns(make):
    got = schemas.conform(make("customer_id string, extra int", [("C1", 1)]), "customer_master")
    assert got.columns == ["customer_id", "salesman_id", "customer_type", "customer_status"]


def test_rules_report_violations_and_let_nulls_pass(make):
    df = make("id int, severity string", [(1, "error"), (2, "bad"), (3, None)])
    got = [(r.id, r.rule) for r in quality.violations(df, schemas.rules("data_quality_issues"), ["id"]).collect()]
    assert got == [(2, "severity")]


def test_weather_arrays_of_unequal_length_fail(spark):
    import pytest
    docs = spark.createDataFrame([(False, ["2026-01-01"], [40.0], [20.0], [0.1], [])],
                                 "is_forecast boolean, time array<string>, temp_max array<double>, temp_min array<double>,"
                                 " precipitation array<double>, snowfall_cm array<double>")
    with pytest.raises(Exception, match="unequal"):
        readers.weather_rows(docs).collect()


def test_merges_are_idempotent(make):
    old = make("k string, v int", [("a", 1), ("b", 2)])
    new = make("k string, v int", [("b", 9), ("c", 3)])
    once = sinks.upsert(old, new, ["k"])
    twice = sinks.upsert(once, new, ["k"])
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(once) == rows(twice) == [("a", 1), ("b", 9), ("c", 3)]
    kept = sinks.insert_absent(old, new, ["k"])
    assert rows(kept) == rows(sinks.insert_absent(kept, new, ["k"])) == [("a", 1), ("b", 2), ("c", 3)]


def test_replace_days_touches_only_its_days(spark, make, tmp_path):
    path = str(tmp_path / "report")
    d1, d2 = date(2026, 1, 1), date(2026, 1, 2)
    sinks.replace_days(make("k string, d date", [("a", d1), ("b", d2)]), path, "d")
    assert sinks.replace_days(make("k string, d date", [("c", d2)]), path, "d") == 1
    assert sorted((r.k, r.d) for r in spark.read.parquet(path).collect()) == [("a", d1), ("c", d2)]
    sinks.upsert_days(spark, make("k string, d date", [("c", d2), ("x", d2)]), path, ["k"], "d")
    sinks.upsert_days(spark, make("k string, d date", [("c", d2), ("x", d2)]), path, ["k"], "d")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == ["a", "c", "x"]


def test_a_key_that_changes_its_day_moves(spark, make, tmp_path):
    path = str(tmp_path / "moved")
    d1, d2, d3 = (date(2026, 1, k) for k in (1, 2, 3))
    rows = "k string, v int, d date"
    sinks.upsert_days(spark, make(rows, [("a", 1, d1), ("b", 1, d1), ("c", 1, d3)]), path, ["k"], "d")
    sinks.upsert_days(spark, make(rows, [("a", 2, d2), ("c", 2, d2), ("c", 3, d2)]), path, ["k"], "d")
    got = lambda: sorted((r.k, r.v, r.d) for r in spark.read.schema(rows).parquet(path).collect())
    assert got() == [("a", 2, d2), ("b", 1, d1), ("c", 3, d2)]
    sinks.upsert_days(spark, make(rows, [("c", 4, d2)]), path, ["k"], "d")
    assert got() == [("a", 2, d2), ("b", 1, d1), ("c", 4, d2)]


def test_newest_run_prunes_the_scan(spark, make, tmp_path):
    path = str(tmp_path / "runs")
    make("k string, d date", [(str(k), date(2026, 1, 1 + k)) for k in range(5)]).write.partitionBy("d").parquet(path)
    newest = common.newest_run(spark.read.parquet(path), "d")
    assert [r.k for r in newest.collect()] == ["4"]
    scan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in scan and "subquery" in scan.lower().split("partitionfilters")[1].split("pushed")[0]


def test_export_writes_guarded_cells(spark, make, tmp_path):
    path = str(tmp_path / "csv")
    sinks.export_csv(make("k string, v int", [("=x", 1), ("y", 2)]), ["k", "v"], [F.asc("k")], path)
    assert sorted(r.k for r in spark.read.option("header", True).csv(path).collect()) == ["'=x", "y"]


def test_merged_rows_take_each_customer_field_from_the_first_that_knows_it(make):
    ddl = ("sale_date string, location string, part string, qty string, price string, revenue string, warranty string, backorder string,"
           " core_return string, price_override string, invoice string, customer string, customer_type string, customer_status string,"
           " customer_salesman string, load_order bigint")
    line = lambda n, part, cust, kind, status, man: (
        "3/4/2026", "1 - A", part, "2", "5", "10", "N", "", None, "Y", "77", cust, kind, status, man, n)
    raw = make(ddl, [line(3, "p", "C1", "Retail", "Hold", "S2"), line(1, "p", None, " ", "Active", "S1"), line(2, "p", "C1", "Trade", "UNKNOWN", None),
                     line(4, "q", "---", None, "", "~")])
    got = {r.sku_id: r for r in readers.merge_sales(readers.cube_sales(raw)).collect()}
    p, q = got["p"], got["q"]
    assert (p.customer_id, p.customer_type, p.customer_status, p.customer_salesman) == ("C1", "Trade", "Active", "S1")
    assert (p.qty_sold, p.total_revenue, p.lines, p.conflicts) == (6.0, 30.0, 3, 3)
    assert (q.customer_id, q.customer_type, q.customer_status, q.customer_salesman, q.conflicts) == (None, None, None, None, 0)
    assert readers.merge_sales(readers.cube_sales(raw.limit(0))).count() == 0


def test_detail_rows_carry_profit_backorder_and_salesman(make):
    ddl = ("sale_date string, location string, part string, qty string, revenue string, tran string, ship_to string, stock_flag string,"
           " gross_profit string, backorder_qty string, counterman string, load_order bigint")
    rows = [("2026-03-04", "2 - B", "p", "1", "10", "SL - SALE", "C1-1", "n", " 2.5 ", "1E0", " K7 ", 1),
            ("2026-03-04", "2 - B", "q", "1", "10", "SL-I - INTERCO", "", None, "n/a", "", " ", 1)]
    got = {r.prod_line_pn: (r.gross_profit, r.backorder_qty, r.salesman_id) for r in readers.cube_detail(make(ddl, rows)).collect()}
    assert got == {"p": (2.5, 1.0, "K7"), "q": (None, None, None)}


def test_snapshots_keep_their_order_thresholds(make):
    ddl = ("part string, location_id string, on_hand string, on_order string, unit_cost_on_hand string, catalog_cost string, ext_cost string,"
           " min_qty string, max_qty string")
    rows = [("p", "LOC-001", "3", "", "1", None, None, " 2E0 ", "9"), ("q", "LOC-001", "", None, None, None, None, "", "n/a")]
    got = {r.sku_id: (r.reorder_point, r.reorder_qty) for r in readers.snapshot_costs(make(ddl, rows), date(2026, 3, 24)).collect()}
    assert got == {"p": (2.0, 9.0), "q": (None, None)}
