import random
from datetime import timedelta

import pytest

from shelfwise.operators import accuracy, alerts, customers, forecast, purchasing, stock
from shelfwise.plans import reports
from shelfwise.streaming import incremental
from tests.conftest import AS_OF

d = lambda n: AS_OF - timedelta(days=n)


def test_dead_stock_branches(make):
    inv = [("s1", "L1", 10.0, 2.4), ("s2", "L1", 10.0, 2.5), ("s3", "L1", 10.0, 5000.0), ("s4", "L1", 10.0, 5000.0), ("s5", "L1", 1000.0, None),
           ("s6", "L1", 10.0, 5000.0), ("s7", "L1", 10.0, 5000.0), ("s8", "L1", 0.0, 1.0)]
    snaps = make("sku_id string, location_id string, snapshot_date date, qty_on_hand double, unit_cost double", [(s, l, AS_OF, q, c) for s, l, q, c in inv])
    master = make("sku_id string, abc_class string, avg_weekly_units double, last_sale_date date, unit_cost double",
                  [("s1", "C", 0.0, d(900), None), ("s2", "C", 0.0, None, None), ("s3", "C", 0.0, d(365), None), ("s4", "C", 0.0, None, None),
                   ("s6", "C", 0.0, d(59), None), ("s7", "C", 2.0, None, None)])
    orders = make("po_number int, line_number int, sku_id string, supplier_id string, status string, actual_delivery_date date, unit_cost double",
                  [(1, 1, "s3", "V1", "received", d(50), 1.0), (2, 1, "s3", "V9", "open", None, 1.0)])
    sold = [("s4", "L1", d(100 + i), False) for i in range(12)]
    sales = make("sku_id string, location_id string, transaction_date date, is_warranty boolean", sold + [("s7", "L1", d(1), True)])
    detail = make("prod_line_pn string, tran_date date", [("s3", d(300))])
    needs = make("sku_id string, location_id string, recommendation_date date, qty_to_order double", [("s3", "L5", AS_OF, 1.0), ("s3", "L4", d(1), 9.0)])
    short = make("sku_id string, location_id string", [("s3", "L2"), ("s7", "L2")])
    got = {r.sku_id: r for r in stock.dead_stock(snaps, master, orders, sales, detail, needs, short, AS_OF).collect()}
    assert set(got) == {"s1", "s2", "s3", "s4", "s5", "s6", "s7"}
    assert (got["s1"].classification, got["s1"].action) == ("LIQUIDATE", "Write off")  # value 24, 900 days
    assert got["s2"].days_since_sale == 365 and got["s2"].classification == "MARKDOWN"
    assert got["s3"].action == "Return to vendor" and got["s3"].action_type == "TRANSFER" and got["s3"].transfer_candidate_location == "L5"
    assert got["s3"].data_conflict and not got["s7"].data_conflict
    assert got["s4"].classification == "HEALTHY" and got["s4"].sale_frequency == 12
    assert got["s5"].unit_cost == 10.0 and got["s5"].action == "Liquidate / delist"
    assert got["s6"].classification == "HEALTHY" and got["s7"].action == "Markdown — price reduction" and got["s7"].transfer_candidate_location == "L2"


def test_two_snapshots_of_one_day_give_one_answer(make):
    """The larger minimum and the larger cost of the newest day count, in whatever order the rows come."""
    rows = [("s", "L1", AS_OF, 1.0, 9.0, 3.0), ("s", "L1", AS_OF, 1.0, 8.0, 4.0), ("s", "L1", d(1), 1.0, 20.0, 50.0)]
    master = make("sku_id string, description string, avg_weekly_units double, unit_cost double", [("s", "x", 7.0, 1.0)])
    detail = make("prod_line_pn string, tran_date date, tran_code string, gross_profit double, qty_ship double", [])
    recs = _recs(make, [])
    flags = make("prod_line_pn string, location_id string, flag string", [])
    for some in (rows, rows[::-1]):
        snaps = make("sku_id string, location_id string, snapshot_date date, qty_on_hand double, reorder_point double, unit_cost double", some)
        got = stock.chronic_understocking(snaps.coalesce(1), master, detail, recs, flags, AS_OF).first()
        assert (got.current_min_qty, got.unit_cost, got.days_observed) == (9.0, 4.0, 3)


def _recs(make, rows):
    return make("sku_id string, location_id string, recommendation_date date, recommendation_type string, qty_to_order double, transfer_from_location string", rows)


def test_stocking_gap_classes(make):
    rows = []
    for sku, days in (("f4", [1, 3, 5, 7]), ("f5", [1, 3, 5, 7, 9]), ("s5", [20, 21, 22, 23, 24]), ("f9", list(range(1, 60, 7))), ("f10", list(range(1, 80, 8))), ("old", [91])):
        rows += [(sku, "L1", d(n), "transfer", 4.0, "L2" if i else "L3") for i, n in enumerate(days)]
    rows += [("f4", "L1", d(60), "po", 4.0, None), ("f4", "LOC-021", d(1), "transfer", 1.0, "L2")]
    rows += [("center", "LOC-025", d(n), "transfer", 4.0, "L2") for n in range(1, 80, 8)]
    master = make("sku_id string, unit_cost double", [("f5", 2.0)])
    snaps = make("sku_id string, location_id string, snapshot_date date, reorder_point double", [("f10", "L1", AS_OF, 3.0)])
    got = {r.sku_id: r for r in purchasing.stocking_gaps(_recs(make, rows), master, snaps, AS_OF).collect()}
    assert {k: (r.gap_classification, r.gap_score) for k, r in got.items()} == {
        "f4": ("OCCASIONAL", 0.32), "f5": ("RECURRING", 0.4), "s5": ("CHRONIC", 1.0), "f9": ("RECURRING", 0.64), "f10": ("CHRONIC", 1.0)}
    assert got["f5"].total_transfer_value == 40.0 and got["f5"].transfer_from_location == "L2"
    assert got["f10"].current_reorder_point == 3.0 and got["f10"].suggested_stock_increase == 7.2
    assert got["s5"].annual_cost_savings == pytest.approx(5 / 90 * 365 * 4 * 2.5, abs=0.005) and got["f5"].annual_cost_savings is None
    assert got["f4"].trend_direction == "INCREASING"


def test_churn_scores_halved_stopped_and_new(make):
    ddl = ("customer_id string, transaction_id string, invoice_number string, transaction_date date, total_revenue double, customer_type string,"
           " customer_status string, is_anomaly boolean, is_residual_demand boolean, is_warranty boolean, is_core_return boolean")
    rows = []
    def buy(c, day, rev, inv, status="ACTIVE"):
        rows.append((c, f"{c}{inv}{rev}", inv, d(day), rev, "RETAIL", status, False, False, False, False))
    for i, day in enumerate((80, 75, 70, 65)):
        buy("stopped", day, 100.0, f"s{i}"); buy("half", day, 100.0, f"h{i}")  # noqa: E702
    buy("stopped", 45, 1.0, "s9"), buy("half", 10, 100.0, "h9"), buy("half", 10, 20.0, "h9")
    for i, day in enumerate((30, 20, 0)):
        buy("new", day, 10.0, f"n{i}"); buy("closed", day, 10.0, f"c{i}", "Deleted")  # noqa: E702
    buy("few", 60, 1.0, "f1"), buy("few", 1, 1.0, "f2")
    got = {r.customer_id: r for r in customers.churn_scores(make(ddl, rows), AS_OF).collect()}
    assert set(got) == {"stopped", "half", "new"}
    assert (got["new"].frequency_score, got["new"].monetary_score, got["new"].risk_tier) == (50.0, 50.0, "LOW")
    assert got["stopped"].churn_score == 96.0 and got["stopped"].risk_tier == "HIGH" and got["stopped"].at_risk_flag
    assert got["half"].order_count_90d == 5 and got["half"].frequency_score == 50.0 and got["half"].monetary_score == 40.0


def test_average_churn_score_does_not_depend_on_the_order_of_rows(make):
    scores = [1.6, 37.6, 15.98, 10.4, 17.58, 11.2, 31.6, 10.85, 10.4, 34.94]  # 182.15 in all; sums of doubles end beside it in some orders
    for order in (scores, sorted(scores), sorted(scores, reverse=True)):
        rows = make("risk_tier string, churn_score double, revenue_90d double", [("LOW", x, 1.0) for x in order]).coalesce(1)
        assert [tuple(r) for r in reports.churn_tiers(rows).collect()] == [("LOW", 10, 18.22, 10.0)]


def test_churn_flag_segments(make):
    ddl = "customer_id string, location_id string, is_commercial boolean, baseline_sales double, baseline_tx int, baseline_months int, comparison_sales double, last_purchase_date date"
    base = 18 * 1000.0
    rows = [("a180", "L", True, base, 3, 3, 0.0, d(180)), ("c181", "L", True, base, 3, 3, 0.0, d(181)), ("c365", "L", True, base, 3, 3, 0.0, d(365)),
            ("l366", "L", True, base, 3, 3, 0.0, d(366)), ("decl", "L", True, base, 3, 3, 2100.0, d(1)), ("ok", "L", True, base, 3, 3, 2101.0, d(1)),
            ("tx2", "L", True, base, 2, 3, 0.0, d(1)), ("poor", "L", True, 18 * 332.0, 3, 3, 0.0, d(1)), ("two", "L", True, base, 3, 2, 0.0, d(1))]
    men = make("customer_id string, location_id string, salesman_id string", [("ok", "L", "S1")])
    got = {r.customer_id: r.flag for r in customers.churn_flags(make(ddl, rows), men, AS_OF).collect()}
    assert got == {"a180": "AT_RISK", "c181": "CHURNED", "c365": "CHURNED", "l366": "LOST", "decl": "DECLINING", "ok": "STABLE"}


def test_accuracy_definitions(make):
    from pyspark.sql import functions as F
    df = make("a double, p double", [(10.0, 8.0), (0.0, 0.0), (0.0, 1.0), (0.5, 1.0)])
    rows = df.select(accuracy.piecewise_error(F.col("a"), F.col("p")).alias("x"), accuracy.floored_error(F.col("a"), F.col("p")).alias("y")).collect()
    assert [r.x for r in rows] == [20.0, 0.0, 100.0, 100.0] and [r.y for r in rows] == [0.2, 0.0, 1.0, 0.5]


def _alerts(make, day, *keys):
    rows = [(d(day), kind, "critical", key, "L1", None, None, f"{key} on {day}", f"{kind}|{key}", float(day)) for kind, key in keys]
    return make("alert_date date, alert_type string, severity string, sku_id string, location_id string, supplier_id string, customer_id string,"
                " message string, alert_key string, financial_impact double", rows or [(None,) * 10]).filter("alert_key is not null")


def test_alert_lifecycle_over_four_runs(make):
    low, dead = ("LOW_SUPPLY", "a"), ("DEAD_STOCK", "b")
    state = alerts.empty_state(_alerts(make, 3, low))
    runs = {3: [low, dead], 2: [low], 1: [], 0: [low]}
    snaps = {}
    for day in (3, 2, 1, 0):
        current = _alerts(make, day, *runs[day])
        state = alerts.advance(state, current, d(day))
        once = sorted(map(str, state.collect()))
        again = alerts.advance(state, current, d(day))
        assert sorted(map(str, again.collect())) == once  # a second run of the same day changes nothing
        snaps[day] = {(r.alert_key, r.first_seen_date): r for r in state.collect()}
    assert snaps[2][("LOW_SUPPLY|a", d(3))].days_active == 2 and snaps[2][("LOW_SUPPLY|a", d(3))].message == "a on 2"
    assert snaps[1][("LOW_SUPPLY|a", d(3))].resolved and snaps[1][("LOW_SUPPLY|a", d(3))].resolved_date == d(1)
    assert not snaps[0][("DEAD_STOCK|b", d(3))].resolved  # never closed automatically
    assert snaps[0][("LOW_SUPPLY|a", d(0))].days_active == 1 and len(snaps[0]) == 3


def test_an_acknowledged_alert_stays_so_while_it_is_open(make):
    low = ("LOW_SUPPLY", "a"), ("LOW_SUPPLY", "b")
    state = alerts.advance(alerts.empty_state(_alerts(make, 3, *low)), _alerts(make, 3, *low), d(3))
    marks = make("alert_key string, alert_date date, acknowledged_by string, acknowledged_at date",
                 [("LOW_SUPPLY|a", d(3), "late", d(1)), ("LOW_SUPPLY|a", d(3), "first", d(3)), ("LOW_SUPPLY|b", d(4), "wrong day", d(3)),
                  ("LOW_SUPPLY|b", d(3), "no time", None), ("unknown", d(3), "x", d(3))])
    state = alerts.acknowledge(alerts.acknowledge(state, marks), marks.filter("acknowledged_by = 'late'"))
    assert state.columns == list(alerts.STATE_COLUMNS)
    state = alerts.advance(state, _alerts(make, 2, *low), d(2))
    got = {r.sku_id: (r.alert_date, r.is_acknowledged, r.acknowledged_by, r.acknowledged_at) for r in state.collect()}
    assert got == {"a": (d(2), True, "first", d(3)), "b": (d(2), False, None, None)}
    assert [r.sku_id for r in alerts.waiting(state).collect()] == ["b"]
    # Resolved, then back: a new row that is not acknowledged.
    back = alerts.advance(alerts.advance(state, _alerts(make, 1, low[1]), d(1)), _alerts(make, 0, *low), d(0))
    assert {(r.sku_id, r.alert_date, r.is_acknowledged) for r in back.collect()} == {("a", d(2), True), ("a", d(0), False), ("b", d(0), False)}


def test_freeze_alert_needs_a_cold_day_within_a_week(make):
    master = make("sku_id string, is_active boolean, part_category string, sub_category string",
                  [("a", True, "Electrical", ""), ("b", True, "body", "Batteries"), ("c", False, "cooling", ""), ("d", True, "body", "")])
    w = lambda *rows: make("log_date date, temp_min_f double", list(rows))
    assert {r.sku_id for r in alerts.freeze_alerts(w((AS_OF + timedelta(7), 19.9)), master, AS_OF).collect()} == {"a", "b"}
    assert alerts.freeze_alerts(w((AS_OF + timedelta(7), 20.0), (AS_OF + timedelta(8), 0.0)), master, AS_OF).count() == 0


def test_weather_streak_resets_and_carries_over_a_split(make):
    temps = [20.0, 31.9, None, 10.0, 5.0, 32.0, 1.0]
    rows = [(AS_OF + timedelta(i), t, 40.0) for i, t in enumerate(temps)]
    ddl = "log_date date, temp_min_f double, temp_max_f double"
    whole = forecast.freeze_features(make(ddl, rows))
    want = [r.consecutive_freeze_days for r in whole.orderBy("log_date").collect()]
    assert want == [1, 2, 0, 1, 2, 0, 1]
    for cut in range(1, len(rows)):
        stored = whole.filter(f"log_date < date'{AS_OF + timedelta(cut)}'")
        got = incremental.extend_streaks(stored, make(ddl, rows[cut:])).orderBy("log_date").collect()
        assert [r.consecutive_freeze_days for r in got] == want[cut:]


def test_streamed_load_is_the_same_after_a_replay(spark, make, tmp_path):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("id bigint, v int, day date")
    src, table = str(tmp_path / "src"), str(tmp_path / "table")
    make("id bigint, v int, day date", [(1, 1, d(1)), (2, 2, d(0))]).write.parquet(src)
    load = lambda cp: incremental.load_available(incremental.file_stream(spark, src, schema), table, str(tmp_path / cp), ["id"], "day")
    read = lambda: sorted((r.id, r.v) for r in spark.read.parquet(table).collect())
    load("cp")
    assert read() == [(1, 1), (2, 2)]
    make("id bigint, v int, day date", [(2, 9, d(0)), (3, 3, d(0))]).write.mode("append").parquet(src)
    load("cp")
    assert read() == [(1, 1), (2, 9), (3, 3)]


def test_resume_point(make):
    stored = make("day date", [(d(10),), (d(50),)])
    assert incremental.resume_from(stored, "day", d(300), 7).first().load_from == d(17)
    assert incremental.resume_from(stored.limit(0), "day", d(300)).first().load_from == d(300)


def test_stored_alert_versions(spark, make, tmp_path):
    folder = str(tmp_path / "state")
    alerts.empty_state(_alerts(make, 1, ("LOW_SUPPLY", "a"))).write.parquet(f"{folder}/version=0")
    assert incremental.advance_stored(spark, folder, 0, _alerts(make, 1, ("LOW_SUPPLY", "a")), d(1)) == 1
    assert incremental.advance_stored(spark, folder, 1, _alerts(make, 0, ("LOW_SUPPLY", "a")), d(0)) == 2
    assert [r.days_active for r in spark.read.parquet(f"{folder}/version=2").collect()] == [2]


def test_streaks_by_station_over_many_blocks(spark, make):
    """Blocks of five days: all cold ones, warm ones and gaps, with a seed from the days before."""
    rng = random.Random(6)
    rows = []
    for name, share in (("n", 0.97), ("s", 0.5), ("w", 1.0)):
        for i in range(120):
            if rng.random() < 0.9:
                rows.append((name, AS_OF + timedelta(i - 60), 10.0 if rng.random() < share else (40.0 if rng.random() < 0.8 else None), 40.0))
    want, streak = {}, {}
    for name, d, low, _ in sorted(rows):
        streak[name] = streak.get(name, 0) + 1 if low is not None and low < 32 else 0
        want[name, d] = streak[name]
    ddl = "station string, log_date date, temp_min_f double, temp_max_f double"
    whole = forecast.freeze_features(make(ddl, rows), "station", block_days=5)
    assert {(r.station, r.log_date): r.consecutive_freeze_days for r in whole.collect()} == want
    cut = AS_OF + timedelta(13)
    stored, new = whole.where(f"log_date < date'{cut}'"), make(ddl, [r for r in rows if r[1] >= cut])
    got = incremental.extend_streaks(stored, new, "station").collect()
    assert {(r.station, r.log_date): r.consecutive_freeze_days for r in got} == {k: v for k, v in want.items() if k[1] >= cut}
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan and all("_station" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window"))
