"""Registered queries: classification."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from shelfwise.operators import classify
from shelfwise.plans.catalog import AS_OF, frame, query
from shelfwise.session import settle


@query
def abc_revenue(c):
    return classify.abc_by_revenue(c["sales"], c["sku_master"], AS_OF)


@query
def xyz_class(c):
    return classify.xyz_by_variability(c["sales"], c["sku_master"], AS_OF)


@query
def supplier_scores(c):
    # Read by the supplier alerts and by the report sections: one row per supplier, stored once.
    return settle(classify.supplier_scores(c["purchase_orders"], AS_OF))


@query
def weather_sensitivity(c):
    return classify.weather_sensitivity(c["sales"], c["sku_master"], c["weather"], AS_OF)


@query
def sku_metrics(c):
    return classify.sku_metrics(c["sales"], AS_OF)


@query
def sku_metrics_resumed(c):
    done = c["sku_master"].filter("last_sale_date is not null")
    return classify.sku_metrics(c["sales"], AS_OF, done=done)


@query
def location_tiers(c):
    return classify.location_tiers(c["sales"], c["purchase_orders"], AS_OF)


@query
def residual_demand(c):
    return classify.residual_demand(c["sales"], c["inventory"], AS_OF)


@query
def demand_quality(c):
    return classify.demand_quality(c["sales"], AS_OF)


@frame
def recent_gross_profit(c):
    # The use-profit test and the ranking both read it: stored once.
    return settle(classify.recent_gross_profit(c["sales_detail"], AS_OF))


@query
def abc_gross_profit(c):
    # The synthetic catalogue is small, so profit ranks it from the first earning SKU on.
    return classify.abc_by_gross_profit(c["recent_gross_profit"], c["sku_master"])


@query
def abc_weighted_volume(c):
    return classify.abc_by_gross_profit(c["recent_gross_profit"], c["sku_master"], by_volume=True)


@query
def abc_by_location(c):
    return classify.abc_by_location(c["recent_gross_profit"], c["sku_master"])


@query
def abc_class_changes(c):
    return classify.class_changes(c["abc_gross_profit"])


@query
def generated_columns(c):
    """Stockout flag, lead-time variance and fill rate as stored columns would hold them."""
    po = c["purchase_orders"]
    return po.select(
        "po_number", "line_number", "sku_id", "qty_ordered",
        F.datediff("actual_delivery_date", "expected_delivery_date").alias("lead_time_variance"),
        classify.fill_rate(F.col("qty_received"), F.col("qty_ordered")).alias("fill_rate_pct"))


@query
def dead_tail_skus(c):
    """Active SKUs once the dead tail (flagged, no sale for 180 days) is left out."""
    stale = F.col("is_dead_stock") & (F.col("last_sale_date").isNull()
                                      | (F.col("last_sale_date") < F.lit(AS_OF - timedelta(days=180))))
    return c["sku_master"].filter(F.col("is_active") & ~F.coalesce(stale, F.lit(False))).select("sku_id", "last_sale_date")
