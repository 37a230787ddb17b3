"""Registered queries: report sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import forecast
from shelfwise.plans import reports
from shelfwise.plans.catalog import AS_OF, frame, query


@query
def report_alert_counts(c):
    return reports.alert_counts(c["alerts_today"])


@query
def report_alert_items(c):
    return reports.alert_items(c["alerts_today"], c["locations"])


@query
def report_reorder_kpis(c):
    return reports.reorder_kpis(c["recommendations"])


@query
def report_top_suppliers(c):
    r = reports.latest_recommendations(c["recommendations"]).filter("recommendation_type = 'po'")
    return reports.top_counts(r, "supplier_id")


@query
def report_top_destinations(c):
    return reports.top_counts(reports.latest_recommendations(c["recommendations"]), "location_id")


@query
def report_pending_recommendations(c):
    return reports.pending_recommendations(c["recommendations"], c["locations"])


@query
def report_dead_stock_top(c):
    return reports.dead_stock_top(c["dead_stock"])


@query
def report_dead_stock_document(c):
    order = [-F.col("total_inv_value"), F.col("sku_id"), F.col("location_id")]
    return reports.as_document(c["dead_stock_summary"], reports.dead_stock_top(c["dead_stock"], 20), order)


@query
def report_dead_stock_listed(c):
    """The rows of the document, read back from its JSON in their order."""
    row = "array<struct<sku_id: string, location_id: string, action: string, total_inv_value: double>>"
    rows = F.from_json("document", f"rows {row}")["rows"]
    return c["report_dead_stock_document"].select(F.posexplode(rows).alias("place", "r")).select("place", "r.*")


@query
def report_action_breakdown(c):
    return reports.action_breakdown(c["dead_stock"])


@query
def report_supplier_health(c):
    return reports.supplier_health(c["supplier_scores"])


@query
def report_red_suppliers(c):
    return reports.red_suppliers(c["supplier_scores"])


@query
def report_inventory_health(c):
    return reports.inventory_health(c["inventory"], c["locations"])


@query
def report_transfer_routes(c):
    return reports.transfer_routes(c["recommendations"])


@query
def report_transfer_skus(c):
    return reports.transfer_skus(c["recommendations"])


@query
def report_gross_profit_by_location(c):
    return reports.gross_profit_by_location(c["sales_detail"], AS_OF)


@query
def report_location_performance(c):
    return reports.location_performance(c["locations"].drop("location_tier"), c["location_tiers"],
                                        c["report_gross_profit_by_location"], c["churn_flags"], c["abc_by_location"])


@frame
def margin_alerts(c):
    return c["margin_drops"].select(F.lit(AS_OF).alias("alert_date"), F.lit("gp_anomaly").alias("alert_type"),
                                    F.lit("warning").alias("severity"), "sku_id", "location_id")


@query
def report_network_kpis(c):
    return reports.network_kpis(c["sku_master"], c["margin_alerts"], c["locations"], c["supplier_scores"], AS_OF)


@query
def report_top_skus(c):
    return reports.top_skus(c["sales_detail"], AS_OF)


@query
def report_anomaly_summary(c):
    return reports.anomaly_summary(c["margin_alerts"], AS_OF)


@query
def report_supplier_detail(c):
    return reports.supplier_detail(c["supplier_scores"], c["purchase_orders"])


@query
def report_open_orders(c):
    return reports.open_orders(c["purchase_orders"])


@query
def report_morning_brief(c):
    return reports.morning_brief(c["alerts_today"], c["recommendations"])


@query
def report_critical_actions(c):
    # A dozen readings of the order lines meet here, by alerts, orders and scores: joined and stored once.
    c.keep("order_lines")
    return reports.critical_actions(c["alerts_today"], c["purchase_orders"], c["supplier_scores"], AS_OF)


@query
def report_freshness(c):
    return reports.freshness({
        "extract": (c["sales"], "transaction_date"), "forecast": (c["forecasts"], "forecast_date"),
        "reorder": (c["recommendations"], "recommendation_date"), "inventory": (c["inventory"], "snapshot_date")})


@query
def report_stocking_gap_locations(c):
    return reports.stocking_gap_locations(c["stocking_gaps_confirmed"], c["locations"])


@query
def report_stocking_gap_rows(c):
    return reports.stocking_gap_rows(c["stocking_gaps_confirmed"])


@query
def report_understocking_locations(c):
    return reports.understocking_locations(c["chronic_understocking"], c["locations"])


@query
def report_churn_summary(c):
    return reports.churn_summary(c["churn_flags"])


@query
def report_churn_tiers(c):
    return reports.churn_tiers(c["churn_scores"])


@query
def report_outside_purchases(c):
    return reports.outside_purchase_report(c["outside_purchase_flags"])


@query
def weather_streaks(c):
    return forecast.freeze_features(c["weather"])


@query
def report_weather_outlook(c):
    return reports.weather_outlook(c["weather_streaks"], AS_OF)


@query
def report_weekly_accuracy(c):
    return c["weekly_error"].select("abc_class", "model_type", F.bround("mape", 4).alias("mape"), "observations")


@query
def report_top_rules(c):
    return reports.top_rules(c["basket_rules"])


@query
def report_run_metrics(c):
    return reports.run_metrics(c["alerts_today"], c["recommendations"], c["forecasts"], c["demand_quality"], AS_OF)
