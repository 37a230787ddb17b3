from datetime import date, timedelta

import pytest

from shelfwise.operators import classify, quality
from tests.conftest import AS_OF

SALES = ("transaction_id string, sku_id string, location_id string, transaction_date date, qty_sold double, unit_price double,"
         " total_revenue double, is_stockout boolean, lost_sales_imputation double, is_residual_demand boolean")


def sale(i, sku="A", loc="LOC-001", day=0, qty=1.0, price=1.0, revenue=1.0, out=False, residual=False):
    return (f"t{i}", sku, loc, AS_OF - timedelta(days=day), qty, price, revenue, out, None, residual)


def test_quality_checks_fire_once_and_spare_clean_rows(make):
    rows = [sale(1), sale(2, qty=-1.0), sale(3, day=-1), sale(4, sku="ZZ"), sale(5, price=0.0), sale(6, loc="LOC-099"), sale(7), sale(7)]
    sales = make(SALES, rows)
    master = make("sku_id string", [("A",)])
    valid = make("location_id string", [("LOC-001",)])
    found = quality.run_checks({
        "a": lambda: quality.negative_quantity(sales), "b": lambda: quality.future_dated(sales, AS_OF),
        "c": lambda: quality.duplicate_ids(sales), "d": lambda: quality.orphaned_skus(sales, master),
        "e": lambda: quality.zero_price(sales), "f": lambda: quality.invalid_locations(sales, valid)})
    assert sorted((r.source_id, r.issue_type) for r in found.collect()) == [
        ("t2", "negative_qty_sold"), ("t3", "future_transaction_date"), ("t4", "orphaned_sku_id"),
        ("t5", "zero_price_nonzero_qty"), ("t6", "invalid_location_id"), ("t7", "duplicate_transaction_id")]


def test_outliers_need_enough_rows_and_spread(make):
    rows = [sale(i, qty=float(1 + i % 3)) for i in range(20)] + [sale(99, qty=100.0)]
    rows += [sale(200, sku="few", qty=1.0), sale(201, sku="few", qty=900.0)]
    rows += [sale(300 + i, sku="flat", qty=5.0) for i in range(30)]
    assert [r.source_id for r in quality.quantity_outliers(make(SALES, rows)).collect()] == ["t99"]


def test_suspicious_names(make):
    master = make("sku_id string, description string", [
        ("1", "delivery"), ("2", "Gaskets"), ("3", "OIL FILTER"), ("4", "BOLT"), ("5", "PART10"), ("6", None), ("7", "gift ")])
    assert sorted(r.source_id for r in quality.suspicious_names(master).collect()) == ["1", "2", "7"]


def test_abc_ties_and_unsold_skus(make):
    rows = [sale(i, sku=f"S{i:02d}", revenue=10.0) for i in range(10)] + [sale(99, sku="old", day=91, revenue=1e6)]
    master = make("sku_id string, abc_class string", [(f"S{i:02d}", None) for i in range(10)] + [("unsold", None), ("old", None)])
    got = {r.sku_id: r.abc_class for r in classify.abc_by_revenue(make(SALES, rows), master, AS_OF).collect()}
    assert [got[f"S{i:02d}"] for i in range(10)] == list("AABBBCCCCC")
    assert got["unsold"] == "C" and got["old"] == "C"


def test_xyz_needs_four_active_weeks(make):
    weeks = classify.listed_weeks(AS_OF, 90)
    assert len(weeks) == 13
    at = lambda w: (AS_OF - w).days
    rows = [sale(i, sku="flat", day=at(w), qty=5.0) for i, w in enumerate(weeks) if at(w) <= 90]
    rows += [sale(100 + i, sku="three", day=at(weeks[i + 2]), qty=5.0) for i in range(3)]
    rows += [sale(200 + i, sku="four", day=at(weeks[i + 2]), qty=5.0) for i in range(4)]
    rows += [sale(300 + i, sku="spike", day=at(weeks[i + 2]), qty=100.0 if i == 0 else 1.0) for i in range(5)]
    master = make("sku_id string, abc_class string", [(s, "B") for s in ("flat", "three", "four", "spike", "none")])
    got = {r.sku_id: (r.xyz_class, r.abc_xyz_class) for r in classify.xyz_by_variability(make(SALES, rows), master, AS_OF).collect()}
    assert got["flat"] == ("X", "BX") and got["three"] == (None, None) and got["none"] == (None, None)
    assert got["four"] == ("Z", "BZ") and got["spike"][0] == "Z"


def test_supplier_scores_at_the_edges(make):
    ddl = ("supplier_id string, po_date date, expected_delivery_date date, actual_delivery_date date, qty_ordered double,"
           " qty_received double, status string")
    d = lambda n: AS_OF - timedelta(days=n)
    rows = [("over", d(10), d(5), d(5), 10.0, 20.0, "received"), ("open", d(10), d(5), None, 10.0, 0.0, "open"),
            ("late", d(30), d(20), d(10), 10.0, 10.0, "received"), ("old", d(91), d(80), d(80), 1.0, 1.0, "received"),
            ("sixty", d(30), d(20), d(20), 10.0, 0.0, "partial")]
    got = {r.supplier_id: r for r in classify.supplier_scores(make(ddl, rows), AS_OF).collect()}
    assert "old" not in got
    assert got["over"].composite_score == 100.0 and got["over"].fill_rate_pct == 1.0 and got["over"].risk_flag == "green"
    assert got["open"].composite_score == 40.0 and got["open"].on_time_delivery_pct is None and got["open"].risk_flag == "red"
    assert got["late"].composite_score == 40.0 and got["late"].lead_time_variance_avg == 10.0
    assert got["sixty"].composite_score == 60.0 and got["sixty"].risk_flag == "amber"


def test_location_tiers_of_seven(make):
    rows = [sale(i * 10 + k, loc=f"LOC-{i:03d}", sku=f"s{k}") for i in range(1, 8) for k in range(i)]
    po = make("location_id string, qty_ordered double, qty_received double", [(f"LOC-{i:03d}", 10.0, 5.0) for i in range(1, 7)])
    got = {r.location_id: r for r in classify.location_tiers(make(SALES, rows), po, AS_OF).collect()}
    assert [got[f"LOC-{i:03d}"].location_tier for i in range(7, 0, -1)] == [1, 1, 1, 2, 2, 3, 3]
    assert all(r.fill_rate_score == 0.5 and r.return_rate_score == 0.5 for r in got.values())


def test_residual_demand_uses_at_least_twice_the_baseline(make):
    snaps = make("sku_id string, location_id string, snapshot_date date, is_stockout boolean",
                 [("A", loc, AS_OF, out) for loc, out in (("LOC-002", True), ("LOC-003", True), ("LOC-001", False))]
                 + [("A", loc, AS_OF - timedelta(days=1), True) for loc in ("LOC-001", "LOC-002")])
    rows = [sale(1, qty=4.0), sale(2, day=5, qty=1.0), sale(3, day=6, qty=1.0), sale(4, loc="LOC-002", qty=50.0), sale(5, day=1, qty=90.0)]
    rows = rows[:4]  # mean of LOC-001 is 2, so 4 is exactly twice
    assert [r.transaction_id for r in classify.residual_demand(make(SALES, rows), snaps, AS_OF).collect()] == ["t1"]


def test_sku_metrics_resume_skips_done_skus(make):
    sales = make(SALES, [sale(1, qty=365.0), sale(2, sku="B", day=3, qty=7.0), sale(3, sku="C", day=366)])
    got = {r.sku_id: (r.last_sale_date, r.avg_weekly_units) for r in classify.sku_metrics(sales, AS_OF).collect()}
    assert got == {"A": (AS_OF, 7.0), "B": (AS_OF - timedelta(days=3), 0.13)}
    assert [r.sku_id for r in classify.sku_metrics(sales, AS_OF, done=make("sku_id string", [("A",)])).collect()] == ["B"]


def test_weather_correlation_needs_five_days(make):
    d = [AS_OF - timedelta(days=i) for i in range(6)]
    weather = make("log_date date, temp_min_f double, is_forecast boolean", [(x, float(i * 10), False) for i, x in enumerate(d)])
    master = make("sku_id string, part_category string", [("A", "bolts"), ("B", "hoses"), ("C", "bolts")])
    sales = make(SALES, [sale(i, day=i, qty=100.0 - i) for i in range(5)] + [sale(50 + i, sku="B", day=i) for i in range(4)])
    got = {r.sku_id: r.weather_sensitivity_score for r in classify.weather_sensitivity(sales, master, weather, AS_OF).collect()}
    assert got == {"A": -1.0, "C": -1.0}


@pytest.mark.parametrize("sku,out", [("COUPON10", True), ("x-labor", True), ("BOLT", False), ("coupler", True)])
def test_catch_all_skus(spark, make, sku, out):
    from pyspark.sql import functions as F
    assert make("s string", [(sku,)]).select(classify.catch_all_sku(F.col("s")).alias("v")).first().v is out


def test_decay_weights(spark, make):
    from pyspark.sql import functions as F
    df = make("d date", [(AS_OF,), (date(2026, 2, 1),), (date(2024, 1, 1),)])
    got = [r.w for r in df.select(classify.decay_weight(classify.months_back(AS_OF, F.col("d"))).alias("w")).collect()]
    assert got == pytest.approx([1.0, 0.9, 0.9 ** 11])
