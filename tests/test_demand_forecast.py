import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import anomaly, demand, forecast, models
from tests.conftest import AS_OF

SALES = ("transaction_id string, sku_id string, location_id string, transaction_date date, qty_sold double, unit_price double,"
         " is_stockout boolean, lost_sales_imputation double, is_anomaly boolean, is_residual_demand boolean, is_warranty boolean")


def sale(i, sku="A", loc="L1", day=1, qty=1.0, out=False, lost=None, anomaly_flag=False):
    return (f"t{i}", sku, loc, AS_OF - timedelta(days=day), qty, 2.0, out, lost, anomaly_flag, None, False)


def test_imputation_edges_own_location_and_no_peers(make):
    rows = [sale(0, out=True, day=50)]
    rows += [sale(10 + d, loc="L2", day=50 + d, qty=float(q)) for d, q in ((-31, 100), (-30, 2), (0, 4), (30, 6), (31, 100))]
    rows += [sale(99, loc="L1", day=50, qty=1000.0), sale(200, sku="lonely", out=True)]
    got = {r.transaction_id: r.lost_sales_imputation for r in demand.lost_sales_imputation(make(SALES, rows)).collect()}
    assert got == {"t0": 4.0, "t200": 0.0}


def test_imputation_equals_the_naive_band_join(make):
    rng = random.Random(5)
    rows = [sale(i, sku=rng.choice("AAAB"), loc=f"L{rng.randrange(4)}", day=rng.randrange(200), qty=float(rng.randrange(1, 9)),
                 out=rng.random() < 0.2) for i in range(600)]
    got = {r.transaction_id: r.lost_sales_imputation for r in demand.lost_sales_imputation(make(SALES, rows)).collect()}
    for t in (r for r in rows if r[6]):
        peers = [r[4] for r in rows if not r[6] and r[1] == t[1] and r[2] != t[2] and abs((r[3] - t[3]).days) <= 30]
        assert got[t[0]] == pytest.approx(sum(peers) / len(peers) if peers else 0.0, abs=0.0051)
    assert len(got) == sum(r[6] for r in rows)


def test_daily_demand_uses_imputed_quantities_and_skips_bad_rows(make):
    rows = [sale(1, qty=3.0), sale(2, qty=9.0, out=True, lost=2.0), sale(3, qty=9.0, out=True), sale(4, qty=50.0, anomaly_flag=True)]
    got = demand.daily_demand(make(SALES, rows), AS_OF, 91).collect()
    assert [(r.demand, r.positive, r.sold) for r in got] == [(5.0, 5.0, 1)]


def _tiers(make):
    return (make("location_id string, location_tier int", [("L1", 1), ("L3", 3)]),
            make("sku_id string, location_id string, demand_quality_score double", [("A", "L3", 0.4), ("B", "L3", 0.5)]))


def test_rolling_needs_seven_sale_days_and_blends_weak_locations(make):
    rows = [sale(i, day=i + 1, qty=13.0) for i in range(7)] + [sale(100 + i, loc="L2", day=i + 1) for i in range(6)]
    rows += [sale(200 + i, loc="L3", day=i + 1, qty=26.0) for i in range(7)] + [sale(300, day=0, qty=999.0), sale(301, day=92, qty=999.0)]
    out = forecast.rolling_pairs(make(SALES, rows), *_tiers(make), AS_OF)
    got = {r.location_id: r for r in out.filter(F.col("forecast_date") == F.lit(AS_OF)).collect()}
    assert set(got) == {"L1", "L3"} and out.count() == 60
    x = np.zeros(91)
    x[:7] = 13.0
    assert got["L1"].predicted_qty == round(x.mean(), 4) and got["L1"].upper_bound == round(x.mean() + x.std(), 4)
    assert got["L1"].lower_bound == 0.0
    regional = (91.0 / 91 + 6.0 / 91) / 2
    assert got["L3"].predicted_qty == pytest.approx(0.4 * regional + 0.6 * 2.0, abs=1e-4)


def test_network_needs_three_days_and_shares_sum_to_one(make):
    rows = [sale(i, loc=f"L{i % 2}", day=i + 1, qty=float(i + 1)) for i in range(3)] + [sale(50 + i, sku="B", day=i + 1) for i in range(2)]
    rows += [sale(90, loc="L9", qty=-5.0)]
    sales = make(SALES, rows)
    assert {r.sku_id for r in forecast.rolling_network(sales, AS_OF).collect()} == {"A"}
    shares = forecast.demand_shares(sales, AS_OF).collect()
    assert {r.sku_id for r in shares} == {"A"} and sum(r.share for r in shares) == pytest.approx(1.0)
    assert "L9" not in {r.location_id for r in shares}


def test_flat_fallback_prefers_recent_days(make):
    rows = [sale(1, day=3, qty=4.0), sale(2, day=5, qty=6.0), sale(3, day=100, qty=100.0), sale(4, loc="L2", day=90, qty=8.0)]
    got = {r.location_id: (r.predicted_qty, r.lower_bound, r.upper_bound) for r in forecast.flat_fallback(make(SALES, rows), AS_OF).collect()}
    assert got == {"L1": (5.0, 3.5, 6.5), "L2": (8.0, 5.6, 10.4)}


def _features(make, days=200, noise=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = [sale(d, day=d, qty=float(max(0.0, 10 + 6 * np.sin(2 * np.pi * d / 7) + noise * rng.normal()))) for d in range(1, days)]
    rows += [(*sale(1000 + d, sku="B", day=d, qty=5.0),) for d in range(1, days)]
    weather = make("log_date date, is_forecast boolean, temp_min_f double, temp_max_f double, snowfall_in double",
                   [(AS_OF - timedelta(days=d), False, float(20 + d % 30), 60.0, 0.0) for d in range(0, 300)])
    skus = make("sku_id string", [("A",), ("B",)])
    master = make("sku_id string, xyz_class string", [("A", "X"), ("B", None)])
    quality = make("sku_id string, location_id string, demand_quality_score double", [("A", "L1", 0.9)])
    return forecast.feature_frame(make(SALES, rows), skus, weather, quality, master, AS_OF), quality


def test_feature_frame_lags_and_future(make):
    f, _ = _features(make, 60)
    rows = {r.day: r for r in f.filter("sku_id = 'A'").collect()}
    day = AS_OF - timedelta(days=10)
    assert rows[day].lag_7 == pytest.approx(rows[day - timedelta(days=7)].target)
    assert rows[day].rolling_mean_7 == pytest.approx(np.mean([rows[day - timedelta(days=k)].target for k in range(1, 8)]))
    recent = np.mean([rows[AS_OF - timedelta(days=k)].target for k in range(1, 29)])
    ahead = rows[AS_OF + timedelta(days=20)]
    assert ahead.target is None and ahead.lag_7 == pytest.approx(recent) and ahead.demand_quality_score == 0.9
    assert ahead.day_of_week == float((AS_OF + timedelta(days=20)).weekday())


def test_learned_models_beat_the_flat_mean_on_a_weekly_pattern(make):
    f, quality = _features(make, 240)
    tiers = make("location_id string, location_tier int", [("L1", 1)])
    truth = {AS_OF + timedelta(days=k): 10 + 6 * np.sin(2 * np.pi * -k / 7) for k in range(30)}
    error = lambda df: np.mean([abs(r.predicted_qty - truth[r.forecast_date]) for r in df.filter("sku_id = 'A'").collect()])
    flat = np.mean([abs(10.0 - v) for v in truth.values()])
    seasonal = models.seasonal_forecast(f, AS_OF)
    boosted = models.boosted_forecast(f, tiers, quality, AS_OF, trees=15, depth=4)
    assert error(seasonal) < 0.3 * flat
    assert error(boosted) < flat
    lean = make("sku_id string, location_id string, regional double, weak boolean", [("A", "L1", 10.0, False), ("B", "L1", 0.0, True)])
    mixed = models.ensemble(seasonal, boosted, boosted, lean, AS_OF)
    assert {round(r.predicted_qty, 1) for r in mixed.filter("sku_id = 'B'").collect()} == {3.0}  # 0.6 of 5
    assert error(mixed) < flat and mixed.filter("predicted_qty < 0").count() == 0 and mixed.count() == 60


def test_isolation_finds_planted_days_and_flags_about_five_percent(make):
    rng = np.random.default_rng(0)
    rows = [(("A"), AS_OF - timedelta(days=d), float(20 + rng.normal()), float(10 + rng.normal()), int(3 + rng.integers(0, 2))) for d in range(1, 201)]
    rows[17] = ("A", rows[17][1], 900.0, 10.0, 40)
    rows += [("few", AS_OF - timedelta(days=d), 1.0, 1.0, 1) for d in range(1, 30)]
    df = make("sku_id string, day date, daily_qty double, avg_price double, sales int", rows)
    got = anomaly.unusual_days(df).collect()
    assert {r.sku_id for r in got} == {"A"} and 5 <= len(got) <= 10
    assert min(got, key=lambda r: r.anomaly_score).day == rows[17][1]
    again = anomaly.unusual_days(df.repartition(5)).collect()
    assert sorted(got) == sorted(again)
    alerts = {r.day: r for r in anomaly.volume_alerts(anomaly.unusual_days(df), AS_OF).collect()}
    assert alerts[rows[17][1]].severity == "warning" and alerts[rows[17][1]].direction == "HIGH"


def test_stale_series(make):
    sales = make(SALES, [sale(1, day=3), sale(2, loc="L2", day=9), sale(3, loc="L3", day=1)])
    trained = make("sku_id string, location_id string, trained_on date", [("A", "L1", AS_OF - timedelta(days=5)), ("A", "L2", AS_OF - timedelta(days=5))])
    assert {r.location_id for r in models.stale_series(sales, trained).collect()} == {"L1", "L3"}


@pytest.mark.parametrize("tile", [128, 7])
def test_imputation_in_tiles_equals_a_plain_scan(make, tile):
    rng = random.Random(9)
    rows = [(f"t{k}", rng.choice("ab"), rng.choice(["L1", "L2", "L3", None]), AS_OF - timedelta(rng.randrange(300)), float(rng.randrange(9)), rng.random() < 0.2)
            for k in range(700)]
    sales = make("transaction_id string, sku_id string, location_id string, transaction_date date, qty_sold double, is_stockout boolean", rows)

    def want(first=None, last=None):
        out = {}
        for t, sku, loc, d, _, short in rows:
            if short and (first is None or d >= first) and (last is None or d <= last):
                near = [q for _, s, other, e, q, gone in rows if s == sku and not gone and other != loc and abs((e - d).days) <= 30]
                out[t] = sum(near) / len(near) if near else 0.0
        return out

    first, last = AS_OF - timedelta(200), AS_OF - timedelta(110)
    for bounds in ({}, {"first": first, "last": last}):
        got = {r.transaction_id: r.lost_sales_imputation for r in demand.lost_sales_imputation(sales, tile_days=tile, **bounds).collect()}
        assert got.keys() == want(**bounds).keys() and all(abs(got[t] - v) < 0.005 + 1e-9 for t, v in want(**bounds).items())
