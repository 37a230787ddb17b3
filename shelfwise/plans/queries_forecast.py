"""Registered queries: demand and baseline forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import demand, forecast
from shelfwise.plans.catalog import AS_OF, frame, query
from shelfwise.session import settle


@query
def daily_demand(c):
    return demand.daily_demand(c["sales"], AS_OF, 730)


@query
def lost_sales_imputation(c):
    return demand.lost_sales_imputation(c["sales"])


@query
def rolling_forecast_pairs(c):
    # The synthetic pairs sell on few days, so two sale days suffice here.
    return forecast.rolling_pairs(c["sales"], c["locations"], c["demand_quality"], AS_OF, min_days=2)


@query
def rolling_forecast_network(c):
    return forecast.rolling_network(c["sales"], AS_OF)


@query
def demand_shares(c):
    return forecast.demand_shares(c["sales"], AS_OF)


@query
def rolling_targets(c):
    return forecast.rolling_targets(c["sku_master"], c["forecasts"], AS_OF)


@query
def rolling_targets_covered(c):
    return forecast.covered_targets(c["sku_master"], c["forecasts"], AS_OF)


@query
def seasonal_targets(c):
    return forecast.seasonal_targets(c["sku_master"], c["sales_detail"], AS_OF)


@query
def seasonal_targets_by_volume(c):
    return forecast.seasonal_targets(c["sku_master"], c["sales_detail"], AS_OF, by_profit=False)


@query
def flat_forecast(c):
    return forecast.flat_fallback(c["sales"], AS_OF)


@frame
def feature_skus(c):
    return c["sku_master"].filter("abc_class = 'B'").select("sku_id")


@frame
def model_features(c):
    # Counted, trained on, scored and predicted from: stored once.
    return settle(forecast.feature_frame(c["sales"], c["feature_skus"], c["weather"], c["demand_quality"],
                                         c["sku_master"], AS_OF))


@query
def forecast_features(c):
    means = [n for n in forecast.FEATURES if n.startswith(("lag", "rolling")) or n in forecast.WEATHER_FEATURES]
    return c["model_features"].withColumns({n: F.round(n, 6) for n in means}).drop("recent", "last_day", "active_mean")
