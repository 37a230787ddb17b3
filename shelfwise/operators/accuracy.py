"""Forecast accuracy: forecasts against actual sales, reports per model and class, scores per SKU."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import params
from shelfwise.operators.common import count_if, day, num, total

KEYS = ["sku_id", "location_id"]


def piecewise_error(actual: Column, predicted: Column) -> Column:
    """Percentage error; 0 when both are zero, 100 when only the actual is."""
    return (F.when(actual > 0, F.abs(actual - predicted) / F.when(actual > 0, actual) * 100)
            .when((predicted == 0) & (actual == 0), 0.0).otherwise(100.0))


def floored_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted) / F.greatest(actual, F.lit(1.0))


def with_actuals(forecasts: DataFrame, sales: DataFrame, start: date, end: date) -> DataFrame:
    """Adds ``actual``: the location's sales that day, or the network's for an 'ALL' forecast.
    Sales shrink to one row per (sku, location, day) before either join."""
    local = (sales.filter(F.col("transaction_date").between(F.lit(start), F.lit(end)))
             .groupBy(*KEYS, F.col("transaction_date").alias("forecast_date")).agg(total("qty_sold").alias("q")))
    network = (local.groupBy("sku_id", "forecast_date").agg(F.sum("q").alias("q"))
               .withColumn("location_id", F.lit(params.NETWORK)))
    actual = local.unionByName(network)
    return (forecasts.join(actual, [*KEYS, "forecast_date"], "left")
            .withColumn("actual", F.coalesce("q", F.lit(0.0))).drop("q"))


def evaluate(forecasts: DataFrame, sales: DataFrame, as_of: date, lookback: int = 28) -> DataFrame:
    """Newest forecast per (sku, location, day, model) of the window, next to what was sold."""
    start, end = as_of - timedelta(days=lookback), as_of - timedelta(days=1)
    newest = (forecasts.filter(F.col("forecast_date").between(F.lit(start), F.lit(end)))
              .groupBy(*KEYS, "forecast_date", "model_type")
              .agg(num(F.max_by("predicted_qty", "run_date")).alias("predicted")))
    x = with_actuals(newest, sales, start, end)
    return x.withColumn("mape", piecewise_error(F.col("actual"), F.col("predicted")))


def backfill(evaluated: DataFrame) -> DataFrame:
    return evaluated.select(*KEYS, "forecast_date", "model_type", F.bround("predicted", 4).alias("predicted_qty"),
                            F.bround("actual", 4).alias("actual_qty_sold"), F.bround("mape", 4).alias("mape_error"))


def accuracy_report(evaluated: DataFrame, master: DataFrame, as_of: date, hit: float = 0.20) -> DataFrame:
    a, p = F.col("actual"), F.col("predicted")
    sold = a > 0
    near = sold & (F.abs(a - p) / F.when(sold, a) <= hit)
    x = evaluated.join(master.filter("abc_class is not null").select("sku_id", "abc_class"), "sku_id")
    g = x.groupBy("model_type", "abc_class").agg(
        F.avg("mape").alias("m"), F.avg(F.abs(a - p)).alias("e"), F.avg(p - a).alias("b"), count_if(near).alias("hits"),
        count_if(sold).alias("sold"), F.count(F.lit(1)).alias("total_forecasts_evaluated"),
        F.countDistinct("sku_id").alias("sku_count"))
    return g.select(
        day(as_of).alias("report_date"), "model_type", "abc_class", F.bround("m", 2).alias("avg_mape"),
        F.bround("e", 4).alias("avg_mae"), F.bround("b", 4).alias("bias"),
        F.bround(F.coalesce(F.col("hits") / F.when(F.col("sold") > 0, F.col("sold")) * 100, F.lit(0.0)), 2).alias("hit_rate_20pct"),
        "total_forecasts_evaluated", "sku_count")


def sku_accuracy(evaluated: DataFrame, review_above: float = 40.0) -> DataFrame:
    g = evaluated.groupBy("sku_id").agg(F.avg("mape").alias("m"))
    return g.select("sku_id", F.bround("m", 2).alias("accuracy_score"), (F.col("m") > review_above).alias("needs_review"))


def weekly_error(forecasts: DataFrame, sales: DataFrame, master: DataFrame, as_of: date, lookback: int = 7,
                 run_lookback: int = 7) -> DataFrame:
    """Mean floored error of the last week per class and model, over the newest run of each series."""
    start, end = as_of - timedelta(days=lookback), as_of - timedelta(days=1)
    recent = forecasts.filter(F.col("forecast_date").between(F.lit(start), F.lit(end))
                              & (F.col("run_date") >= day(as_of, -run_lookback))
                              & F.col("model_type").isin("lightgbm", "rolling_avg"))
    newest = recent.groupBy(*KEYS, "model_type").agg(F.max("run_date").alias("run_date"))
    rows = recent.join(newest, [*KEYS, "model_type", "run_date"], "left_semi").withColumn("predicted", num("predicted_qty"))
    x = (with_actuals(rows, sales, start, end).join(master.select("sku_id", "abc_class"), "sku_id", "left")
         .withColumn("abc_class", F.coalesce("abc_class", F.lit("?"))))
    return (x.groupBy("abc_class", "model_type")
            .agg((F.avg(floored_error(F.col("actual"), F.col("predicted"))) * 100).alias("mape"),
                 F.count(F.lit(1)).alias("observations")))
