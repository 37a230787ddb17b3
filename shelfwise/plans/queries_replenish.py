"""Registered queries: reorder engine, baskets and customers."""

from __future__ import annotations

from shelfwise import params
from shelfwise.operators import basket, customers, reorder
from shelfwise.plans.catalog import AS_OF, frame, query
from shelfwise.session import settle


@frame
def active_skus(c):
    return reorder.active_skus(c["sku_master"], AS_OF)


@query
def latest_stock(c):
    return reorder.latest_stock(c["inventory"], AS_OF)


@query
def at_risk_skus(c):
    return reorder.at_risk_skus(c["latest_stock"], c["active_skus"], c["supplier_scores"])


@query
def forecast_means(c):
    # Own and network means are both taken from it: stored once.
    return settle(reorder.forecast_means(c["forecasts"], AS_OF))


@query
def selected_forecasts(c):
    pairs = c["latest_stock"].join(c["active_skus"].select("sku_id", "abc_class"), "sku_id").select(
        "sku_id", "location_id", "abc_class")
    return reorder.select_forecast(pairs, c["forecast_means"], c["location_shares"])


@query
def stock_positions(c):
    # Needs, transfer sources, basket triggers and threshold checks all read it: stored once.
    return settle(reorder.stock_positions(c["latest_stock"], c["active_skus"], c["at_risk_skus"], c["supplier_scores"],
                                          c["purchase_orders"], c["forecast_means"], c["location_shares"], AS_OF))


@query
def chronic_gap_pairs(c):
    return c["stocking_gaps"].filter("gap_classification = 'CHRONIC'").select("sku_id", "location_id")


@query
def reorder_recommendations(c):
    return reorder.recommend(c["stock_positions"], c["chronic_gap_pairs"], AS_OF)


@query
def basket_items(c):
    return basket.baskets(c["sales"], AS_OF, lookback=2500).select("basket.*", "sku_id")


@query
def basket_rules(c):
    # Random baskets have no strong partners: low confidence and lift keep the rule set non-empty.
    return basket.basket_rules(basket.baskets(c["sales"], AS_OF, lookback=2500), AS_OF, min_support=0.00001,
                               min_confidence=0.004, min_lift=1.0)


@query
def basket_triggered(c):
    # A position under 14 days is already ordered here: leads are long, so the limit is wider.
    p = params.Reorder(basket_confidence=0.004, basket_supply_days=60.0)
    return reorder.basket_triggered(c["reorder_recommendations"], c["stock_positions"], c["basket_rules"], AS_OF, p)


@query
def threshold_mismatches(c):
    return reorder.threshold_mismatches(c["stock_positions"], AS_OF)


@query
def threshold_bias(c):
    return reorder.threshold_bias(c["stock_positions"])


@query
def churn_scores(c):
    # A wider window: synthetic customers order about once a season.
    return customers.churn_scores(c["sales"], AS_OF, lookback=365, recent_days=120)


@query
def churn_buckets(c):
    return customers.churn_buckets(c["sales_detail"], *customers.churn_windows(AS_OF))


@query
def modal_salesman(c):
    return customers.modal_salesman(c["sales"], customers.churn_windows(AS_OF)[2])


@query
def churn_flags(c):
    return customers.churn_flags(c["churn_buckets"], c["modal_salesman"], AS_OF)
