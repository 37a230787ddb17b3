"""Registered queries: forecast accuracy, anomalies, models and alerts."""

from __future__ import annotations

from datetime import timedelta
from uuid import uuid4

from pyspark.sql import functions as F

from shelfwise.operators import accuracy, alerts, anomaly, forecast, models, purchasing, quality
from shelfwise.plans import reports
from shelfwise.plans.catalog import AS_OF, frame, query
from shelfwise.session import settle, shared_folder
from shelfwise.streaming import alert_stream


@frame
def past_forecasts(c):
    """The stored forecasts, moved back so that their days have been sold."""
    return c["forecasts"].withColumns({"forecast_date": F.date_sub("forecast_date", 28),
                                       "run_date": F.date_sub("run_date", 28)})


@frame
def evaluated_forecasts(c):
    return accuracy.evaluate(c["past_forecasts"], c["sales"], AS_OF)


@query
def forecast_backfill(c):
    return accuracy.backfill(c["evaluated_forecasts"])


@query
def accuracy_report(c):
    return accuracy.accuracy_report(c["evaluated_forecasts"], c["sku_master"], AS_OF)


@query
def sku_accuracy(c):
    return accuracy.sku_accuracy(c["evaluated_forecasts"])


@frame
def weekly_error(c):
    return accuracy.weekly_error(c["past_forecasts"], c["sales"], c["sku_master"], AS_OF, run_lookback=40)


@query
def daily_profile(c):
    return anomaly.daily_profile(c["sales"], AS_OF).withColumn("avg_price", F.bround("avg_price", 6))


@frame
def unusual_day_rows(c):
    return anomaly.unusual_days(anomaly.daily_profile(c["sales"], AS_OF))


@query
def unusual_days(c):
    return c["unusual_day_rows"]


@query
def volume_alerts(c):
    return anomaly.volume_alerts(c["unusual_day_rows"], AS_OF)


@query
def anomaly_issues(c):
    return quality.anomaly_issues(c["unusual_day_rows"], c["sales"])


@query
def margin_drops(c):
    # Synthetic pairs sell rarely within a week, so one recent sale is enough here.
    return anomaly.margin_drops(c["sales_detail"], AS_OF, min_recent=1)


@frame
def seasonal_features(c):
    a = c["sku_master"].filter("abc_class = 'A'").select("sku_id")
    return settle(forecast.feature_frame(c["sales"], a, c["weather"], c["demand_quality"], c["sku_master"], AS_OF, training_days=730))


@query
def boosted_forecast(c):
    return models.boosted_forecast(c["model_features"], c["locations"], c["demand_quality"], AS_OF)


@query
def seasonal_forecast(c):
    return models.seasonal_forecast(c["seasonal_features"], AS_OF)


@query
def ensemble_forecast(c):
    boosted = models.boosted_forecast(c["seasonal_features"], c["locations"], c["demand_quality"], AS_OF)
    flat = c["flat_forecast"].join(c["sku_master"].filter("abc_class = 'A'").select("sku_id"), "sku_id", "left_semi")
    means = c["seasonal_features"].groupBy("sku_id", "location_id").agg(F.max("active_mean").alias("mean"))
    lean = forecast.with_regional(means, c["locations"], c["demand_quality"])
    return models.ensemble(c["seasonal_forecast"], boosted, flat, lean, AS_OF)


@query
def stale_models(c):
    trained = c["past_forecasts"].filter("model_type = 'prophet'").select(
        "sku_id", "location_id", F.col("run_date").alias("trained_on"))
    return models.stale_series(c["sales"], trained)


@query
def alerts_critical_stockout(c):
    return alerts.critical_stockouts(c["inventory"], c["recommendations"], c["sku_master"], AS_OF)


@query
def alerts_low_supply(c):
    return alerts.low_supply(c["recommendations"], c["sku_master"], AS_OF)


@query
def alerts_freeze(c):
    # The part types stand in for freeze-sensitive categories.
    return alerts.freeze_alerts(c["weather"], c["sku_master"], AS_OF, categories=("large", "promo"))


@query
def alerts_supplier_risk(c):
    return alerts.supplier_risk(c["supplier_scores"], c["purchase_orders"], c["sku_master"], AS_OF)


@query
def alerts_dead_stock(c):
    # Every synthetic SKU sells, so the report of the previous scoring keeps its conflicts aside.
    return alerts.dead_stock_alerts(c["scored_dead_stock"], AS_OF)


@query
def alerts_dead_stock_by_flag(c):
    return alerts.dead_stock_by_flag(c["sku_master"], AS_OF)


@frame
def scored_dead_stock(c):
    return settle(c["dead_stock"].withColumn("data_conflict", F.col("sale_frequency") > 6))


@frame
def alerts_dead_stock_or_flag(c):
    return alerts.dead_stock_chain(c["scored_dead_stock"], c["sku_master"], AS_OF)


@query
def alerts_dead_stock_chained(c):
    """By report where it has rows; the flags of the master where it has none, as at the first run of a site."""
    unscored = c["scored_dead_stock"].where("location_id is null")
    return (c["alerts_dead_stock_or_flag"].withColumn("scored", F.lit(True))
            .unionByName(alerts.dead_stock_chain(unscored, c["sku_master"], AS_OF).withColumn("scored", F.lit(False))))


@query
def alerts_transfer_opportunity(c):
    return alerts.transfer_opportunity(c["recommendations"], AS_OF)


@query
def alerts_accuracy_drop(c):
    return alerts.accuracy_drop(c["weekly_error"], AS_OF)


@query
def alerts_churn_risk(c):
    return alerts.churn_risk(c["churn_flags"], AS_OF)


@query
def alerts_outside_gap(c):
    flags = purchasing.outside_flags(c["sales_detail"], c["recommendations"], AS_OF - timedelta(days=90), high=2, medium=1)
    return alerts.outside_gap(flags, AS_OF)


GENERATORS = ("alerts_critical_stockout", "alerts_low_supply", "alerts_freeze", "alerts_supplier_risk", "alerts_dead_stock_or_flag",
              "alerts_transfer_opportunity", "alerts_accuracy_drop", "alerts_churn_risk", "alerts_outside_gap")


@frame
def alerts_today(c):
    """All generators, written once: the report sections read it several times."""
    return settle(alerts.all_alerts({n: (lambda n=n: c[n]) for n in GENERATORS}))


@query
def alert_list(c):
    return c["alerts_today"].withColumn("severity_rank", alerts.severity_rank(F.col("severity")))


@query
def alert_lifecycle(c):
    """Three runs over consecutive days: keys appear, stay, vanish and return. After the second, one
    location acknowledges what is open there."""
    runs = [alerts.low_supply(c["recommendations"], c["sku_master"], AS_OF - timedelta(days=d)) for d in (2, 1, 0)]
    state = alerts.empty_state(runs[0])
    for back, current in zip((2, 1, 0), runs):
        state = settle(alerts.advance(state, current, AS_OF - timedelta(days=back)))
        if back == 1:
            seen = state.where("location_id = 'LOC-003' and not resolved").select(
                "alert_key", "alert_date", F.lit("buyer").alias("acknowledged_by"), F.col("alert_date").alias("acknowledged_at"))
            state = settle(alerts.acknowledge(state, seen))
    return state


@query
def streamed_alerts(c):
    """The three runs of ``alert_lifecycle`` as a stream that is stopped after each: every load goes on from the
    checkpoint, and keys that vanish are closed by their timers."""
    base = f"{shared_folder(c.spark)}/alerts-{uuid4().hex}"
    landed, log, checkpoint = f"{base}/landed", f"{base}/log", f"{base}/checkpoint"
    for back in (2, 1, 0):
        today = AS_OF - timedelta(days=back)
        alert_stream.land_run(alerts.low_supply(c["recommendations"], c["sku_master"], today), landed, today)
        alert_stream.load(c.spark, landed, log, checkpoint)
        if back == 1:
            seen = alert_stream.table(c.spark, log).where("location_id = 'LOC-003' and not resolved").select(
                "alert_key", "alert_date", F.lit("buyer").alias("acknowledged_by"), F.col("alert_date").alias("acknowledged_at"))
            alert_stream.land_marks(seen, landed, today)
            alert_stream.load(c.spark, landed, log, checkpoint)
    return alert_stream.table(c.spark, log)


@query
def report_waiting_alerts(c):
    """Today's open alerts that nobody has acknowledged, by severity."""
    return reports.alert_counts(c["alert_lifecycle"].where((F.col("alert_date") == F.lit(AS_OF)) & ~F.col("resolved")))
