from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise import params
from shelfwise.operators import basket, reorder
from tests.conftest import AS_OF

POS = ("sku_id string, location_id string, qty_on_hand double, qty_on_order double, buyer_min double, abc_class string,"
       " xyz_class string, supplier_id string, risk_flag string, lead_days double, avg_daily double, model_used string")


def positions(make, rows):
    df = make(POS, rows)
    from pyspark.sql import functions as F
    demand = F.when(F.col("avg_daily") > 0, F.col("avg_daily"))
    return (df.withColumn("threshold", F.col("lead_days") + 7.0)
            .withColumn("days_of_supply", F.col("qty_on_hand") / demand)
            .withColumn("target", F.col("avg_daily") * F.col("threshold") * reorder.safety_multiplier(F.col("xyz_class")))
            .withColumn("shortfall", F.greatest(F.lit(0.0), F.col("target") - F.col("qty_on_hand") - F.col("qty_on_order"))))


def pos(sku, loc, hand, daily, order=0.0, xyz="X", lead=7.0, minimum=None):
    return (sku, loc, float(hand), float(order), minimum, "A", xyz, "V1", "red", float(lead), float(daily), "rolling_avg")


def recs(make, rows, chronic=()):
    chronic = make("sku_id string, location_id string", list(chronic) or [("none", "none")])
    return {(r.sku_id, r.location_id): r for r in reorder.recommend(positions(make, rows), chronic, AS_OF).collect()}


def test_urgency_and_threshold_edges(make):
    got = recs(make, [pos("a", "L1", 2.99, 1), pos("b", "L1", 3, 1), pos("c", "L1", 6.99, 1), pos("d", "L1", 7, 1),
                      pos("e", "L1", 13.99, 1), pos("f", "L1", 14, 1), pos("g", "L1", 5, 0)])
    assert {k[0]: r.urgency for k, r in got.items()} == {"a": "critical", "b": "warning", "c": "warning", "d": "normal"}
    assert "e" not in {k[0] for k in got}  # shortfall 0.01 short of the smallest order is 0.0099...
    assert got[("a", "L1")].recommendation_type == "po" and got[("a", "L1")].supplier_risk_flag == "red"


def test_quantities_round_half_even_and_open_orders_cover(make):
    got = recs(make, [pos("half", "L1", 13.5, 1), pos("one", "L1", 12.5, 1), pos("two", "L1", 11.5, 1), pos("cov", "L1", 5, 1, order=9)])
    assert {k[0]: r.qty_to_order for k, r in got.items()} == {"half": 1, "one": 2, "two": 2}


def test_chronic_boost_comes_after_the_transfer_check(make):
    rows = [pos("s", "L1", 4, 1), pos("s", "L2", 32, 1)]  # L2 can give 32 - 21 = 11, L1 needs 10, boosted 15
    got = recs(make, rows, [("s", "L1")])
    r = got[("s", "L1")]
    assert r.recommendation_type == "transfer" and r.transfer_from_location == "L2" and r.qty_to_order == 15
    assert r.supplier_id is None and r.supplier_risk_flag is None


def test_best_source_zero_demand_and_exact_surplus(make):
    rows = [pos("s", "L1", 4, 1), pos("s", "L2", 31, 1), pos("s", "L3", 400, 1), pos("s", "L4", 20, 0)]
    assert recs(make, rows)[("s", "L1")].transfer_from_location == "L4"  # half of 20 is exactly the 10 needed
    assert recs(make, rows[:3])[("s", "L1")].transfer_from_location == "L3"
    assert recs(make, rows[:2])[("s", "L1")].transfer_from_location == "L2"  # 31 - 21 is exactly 10
    assert recs(make, [rows[0], pos("s", "L5", 30.9, 1)])[("s", "L1")].recommendation_type == "po"


def test_xyz_multiplier(make):
    got = recs(make, [pos(x or "n", "L1", 0, 10, xyz=x) for x in ("X", "Y", "Z", None)])
    assert {k[0]: r.qty_to_order for k, r in got.items()} == {"X": 140, "Y": 182, "Z": 252, "n": 168}


def test_forecast_choice_order(make):
    fc = []
    def add(sku, loc, model, q, age=0, days=30):
        fc.extend((sku, loc, AS_OF + timedelta(days=k), model, AS_OF - timedelta(days=age), float(q)) for k in range(days))
    add("own", "L1", "lightgbm", 2); add("own", "ALL", "lightgbm", 9)  # noqa: E702
    add("own", "L1", "lightgbm", 50, age=3)
    add("net", "ALL", "rolling_avg", 10); add("gap", "ALL", "rolling_avg", 10); add("bare", "ALL", "rolling_avg", 23)  # noqa: E702
    add("pro", "L1", "prophet", 7); add("pro", "L1", "rolling_avg", 1); add("short", "L1", "rolling_avg", 3, days=10)  # noqa: E702
    means = reorder.forecast_means(make("sku_id string, location_id string, forecast_date date, model_type string, run_date date, predicted_qty double", fc), AS_OF)
    shares = make("sku_id string, location_id string, share double, run_date date",
                  [("net", "L1", 0.3, AS_OF), ("net", "L1", 0.9, AS_OF - timedelta(days=1)), ("gap", "L2", 1.0, AS_OF)])
    pairs = make("sku_id string, location_id string, abc_class string",
                 [("own", "L1", "A"), ("net", "L1", "C"), ("gap", "L1", "C"), ("bare", "L1", None), ("pro", "L1", "A"), ("pro", "L1", "B"), ("short", "L1", "C")])
    got = {(r.sku_id, r.abc_class): (pytest.approx(r.avg_daily), r.model_used) for r in reorder.select_forecast(pairs, means, shares).collect()}
    assert got == {("own", "A"): (2.0, "lightgbm"), ("net", "C"): (3.0, "rolling_avg_network"), ("bare", None): (1.0, "rolling_avg_network"),
                   ("pro", "A"): (7.0, "prophet"), ("pro", "B"): (1.0, "rolling_avg"), ("short", "C"): (1.0, "rolling_avg")}


def test_at_risk_rules(make):
    stock = make("sku_id string, location_id string, qty_on_hand double, qty_on_order double",
                 [("out", "L1", 0.0, 50.0), ("thin", "L1", 59.0, 0.0), ("safe", "L1", 60.0, 0.0), ("idle", "L1", 1.0, 0.0), ("gone", "L1", 0.0, 0.0)])
    skus = make("sku_id string, avg_weekly_units double", [("out", 0.0), ("thin", 7.0), ("safe", 7.0), ("idle", None)])
    scores = make("avg_lead_time_days double", [(5.0,), (None,)])
    assert {r.sku_id for r in reorder.at_risk_skus(stock, skus, scores).collect()} == {"out", "thin"}
    long_lead = make("avg_lead_time_days double", [(40.0,)])
    assert {r.sku_id for r in reorder.at_risk_skus(stock, skus, long_lead).collect()} == {"out", "thin", "safe"}


def test_dead_tail_edges(make):
    d = lambda n: AS_OF - timedelta(days=n)
    master = make("sku_id string, is_active boolean, is_dead_stock boolean, last_sale_date date",
                  [("a", True, True, d(180)), ("b", True, True, d(181)), ("c", True, True, None), ("d", True, False, None), ("e", False, False, d(1))])
    assert {r.sku_id for r in reorder.active_skus(master, AS_OF).collect()} == {"a", "d"}


def test_threshold_mismatch(make):
    rows = [pos("eq", "L1", 0, 1, minimum=14.0), pos("warn", "L1", 0, 1, minimum=8.0), pos("err", "L1", 0, 1, minimum=6.0),
            pos("low", "L1", 0, 1, minimum=100.0), pos("tiny", "L1", 0, 0.01, minimum=1.0), pos("none", "L1", 0, 1)]
    p = positions(make, rows)
    assert {r.source_id.split("|")[0]: r.severity for r in reorder.threshold_mismatches(p, AS_OF).collect()} == {
        "warn": "warning", "err": "error", "low": "warning"}
    assert {r.direction: r.positions for r in reorder.threshold_bias(p).collect()} == {"high": 2, "low": 1}


def test_basket_trigger_uses_recommended_skus_only(make):
    p = positions(make, [pos("a", "L1", 0, 1), pos("b", "L1", 13, 1, lead=5, xyz="Z"), pos("b", "L2", 14, 1, lead=5, xyz="Z"), pos("c", "L1", 13, 1, lead=5, xyz="Z")])
    none = make("sku_id string, location_id string", [("x", "x")])
    recommended = reorder.recommend(p.filter("sku_id = 'a'"), none, AS_OF)
    rules = make("antecedent_sku string, consequent_sku string, confidence double", [("a", "b", 0.3), ("b", "c", 0.9), ("a", "c", 0.29)])
    got = reorder.basket_triggered(recommended, p, rules, AS_OF).collect()
    assert [(r.sku_id, r.location_id, r.recommendation_type, r.urgency) for r in got] == [("b", "L1", "basket_triggered", "normal")]


def test_basket_rules_on_ten_invoices(make):
    rows = []
    def add(inv, *skus):
        rows.extend((AS_OF, "L1", inv, s) for s in skus)
    for i in range(6):
        add(f"i{i}", "a", "b")
    for i in range(6, 8):
        add(f"i{i}", "a", "c")
    for i in range(8, 10):
        add(f"i{i}", "d", "e", "d")
    add("single", "a"), add(None, "a", "b"), add("huge", *[f"h{i}" for i in range(51)])
    sales = make("transaction_date date, location_id string, invoice_number string, sku_id string", rows)
    items = basket.baskets(sales, AS_OF)
    assert items.select("basket").distinct().count() == 11  # an invoice of 51 SKUs is a basket like any other
    small = {("a", "b"): (0.545455, 0.75, 1.375), ("b", "a"): (0.545455, 1.0, 1.375), ("c", "a"): (0.181818, 1.0, 1.375),
             ("d", "e"): (0.181818, 1.0, 5.5), ("e", "d"): (0.181818, 1.0, 5.5)}
    huge = {(f"h{i}", f"h{j}"): (0.090909, 1.0, 11.0) for i in range(51) for j in range(51) if i != j}
    for block in (256, 7):  # whole, and in parts
        got = basket.basket_rules(items, AS_OF, min_lift=1.2, block=block).collect()
        assert len(got) == len(small) + len(huge)
        assert {(r.antecedent_sku, r.consequent_sku): (r.support, r.confidence, r.lift) for r in got} == small | huge


def test_pairs_of_a_very_large_invoice(spark):
    items = spark.range(5000).selectExpr("'big' as basket", "concat('s', id) as sku_id")
    pairs = basket._pairs(items.unionByName(spark.createDataFrame([("x", "s1"), ("x", "s2")], "basket string, sku_id string")), 256)
    got = pairs.agg(F.count("*").alias("n"), F.sum("together").alias("together")).first()
    assert (got.n, got.together) == (5000 * 4999 // 2, 5000 * 4999 // 2 + 1)
    assert pairs.where("together = 2").select("a", "b").collect() == [("s1", "s2")]


def test_params_hold_the_published_defaults():
    p = params.Reorder()
    assert (p.horizon_days, p.safety_days, p.basket_confidence, p.chronic_multiplier) == (30, 7.0, 0.30, 1.5)
