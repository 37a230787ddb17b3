"""Learned forecasts: one boosted model for all series, and an additive seasonal model per series."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.common import day, spread
from shelfwise.operators.forecast import FEATURES, FORECAST_COLUMNS, WEATHER_FEATURES, leaned, with_regional

KEYS = ["sku_id", "location_id"]


def boosted_forecast(features: DataFrame, tiers: DataFrame, quality: DataFrame, as_of: date, min_days: int = 28,
                     holdout: int = 14, band: float = 1.28, trees: int = 500, depth: int = 5, seed: int = 42) -> DataFrame:
    """One gradient-boosted model over the features of every series.

    A model per pair would be hundreds of thousands of tiny fits; one model shares their strength
    and trains as a distributed job. ``trees`` is a ceiling: each series' last ``holdout`` days stop the
    boosting once a round gains less than a hundredth of their error, and give it its own error for the band. Only the lower bound is clamped."""
    series = (features.filter("target is not null").groupBy(*KEYS)
              .agg(F.count(F.lit(1)).alias("n"), F.max("active_mean").alias("mean")))
    wanted = series.filter(F.col("n") >= min_days).select(*KEYS)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features.join(wanted, KEYS, "left_semi"))
    held = F.col("day") > F.date_sub("last_day", holdout)
    train = spread(rows.filter("target is not null").select(*KEYS, "features", "target", held.alias("held_out")), KEYS)
    model = GBTRegressor(labelCol="target", featuresCol="features", validationIndicatorCol="held_out", maxIter=trees,
                         maxDepth=depth, seed=seed, stepSize=0.1).fit(train)
    error = (model.transform(train.filter("held_out")).groupBy(*KEYS)
             .agg(F.sqrt(F.avg((F.col("target") - F.col("prediction")) ** 2)).alias("rmse")))
    ahead = model.transform(rows.filter(F.col("day") >= day(as_of)).select(*KEYS, "day", "features", "recent"))
    lean = with_regional(series, tiers, quality).select(*KEYS, "regional", "weak")
    x = ahead.join(error, KEYS).join(lean, KEYS)
    p = leaned(F.col("prediction"), F.coalesce("regional", "recent"), F.col("weak"))
    return x.select(*KEYS, F.col("day").alias("forecast_date"), F.lit("lightgbm").alias("model_type"),
                    F.bround(p, 4).alias("predicted_qty"),
                    F.bround(F.greatest(F.lit(0.0), F.col("prediction") - band * F.col("rmse")), 4).alias("lower_bound"),
                    F.bround(F.col("prediction") + band * F.col("rmse"), 4).alias("upper_bound"),
                    F.lit(0.80).alias("confidence_pct"), day(as_of).alias("run_date"))


def seasonal_design(days: pd.Series, weather: np.ndarray) -> np.ndarray:
    """Trend, weekly and yearly waves, and standardised weather regressors."""
    t = (pd.to_datetime(days) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(float)
    cols = [np.ones_like(t), (t - t.min()) / max(np.ptp(t), 1.0)]
    for period, waves in ((7.0, 3), (365.25, 4)):
        for k in range(1, waves + 1):
            cols += [np.sin(2 * np.pi * k * t / period), np.cos(2 * np.pi * k * t / period)]
    sd = weather.std(axis=0)
    scaled = (weather - weather.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
    return np.column_stack([*cols, scaled])


def seasonal_forecast(features: DataFrame, as_of: date, min_days: int = 90, ridge: float = 1.0) -> DataFrame:
    """Additive model per series by a closed-form ridge fit. A group is one series' calendar,
    bounded by the training days."""
    schema = "sku_id string, location_id string, forecast_date date, predicted_qty double, lower_bound double, upper_bound double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["target"].notna().sum() < min_days:
            return pdf.head(0)[["sku_id", "location_id"]].assign(forecast_date=None, predicted_qty=0.0, lower_bound=0.0, upper_bound=0.0)
        pdf = pdf.sort_values("day", ignore_index=True)
        x = seasonal_design(pdf["day"], pdf[list(WEATHER_FEATURES)].to_numpy(float))
        known = pdf["target"].notna().to_numpy()
        ahead = pd.to_datetime(pdf["day"]).to_numpy() >= np.datetime64(as_of)
        y = pdf["target"].to_numpy(float)[known]
        penalty = ridge * np.eye(x.shape[1])
        penalty[0, 0] = 0.0
        a = x[known]
        beta = np.linalg.solve(a.T @ a + penalty, a.T @ y)
        sd = float(np.std(y - a @ beta))
        mean = x[ahead] @ beta
        out = pdf.loc[ahead, ["sku_id", "location_id"]].copy()
        out["forecast_date"] = pdf.loc[ahead, "day"]
        return out.assign(predicted_qty=mean, lower_bound=mean - 1.96 * sd, upper_bound=mean + 1.96 * sd)

    cols = [*KEYS, "day", "target", *WEATHER_FEATURES]
    fitted = spread(features.select(*cols), KEYS).groupBy(*KEYS).applyInPandas(fit, schema)
    return fitted.withColumns({"model_type": F.lit("seasonal"), "confidence_pct": F.lit(0.95), "run_date": day(as_of)})


def ensemble(seasonal: DataFrame, boosted: DataFrame, fallback: DataFrame, lean: DataFrame, as_of: date,
             weight: float = 0.60) -> DataFrame:
    """Weighted mean of the two models; one of them, or the flat fallback, where others are missing.
    ``lean`` holds (sku, location, regional, weak): weak locations lean on the regional mean."""
    on = [*KEYS, "forecast_date"]
    s = seasonal.select(*on, F.col("predicted_qty").alias("s"), F.col("lower_bound").alias("lo"), F.col("upper_bound").alias("hi"))
    b = boosted.select(*on, F.col("predicted_qty").alias("b"))
    f = fallback.select(*on, F.col("predicted_qty").alias("f"))
    x = s.join(b, on, "full").join(f, on, "full").join(lean.select(*KEYS, "regional", "weak"), KEYS, "left")
    mixed = F.coalesce(weight * F.col("s") + (1 - weight) * F.col("b"), "s", "b", "f")
    own = F.greatest(F.lit(0.0), mixed)
    weak = F.coalesce(F.col("weak") & F.col("regional").isNotNull(), F.lit(False))

    def bound(stored: str, part: float):
        return F.bround(F.greatest(F.lit(0.0), F.coalesce(F.col(stored), mixed * part)), 4)

    return x.select(*on, F.lit("prophet").alias("model_type"), F.bround(leaned(own, F.col("regional"), weak), 4).alias("predicted_qty"),
                    bound("lo", 0.7).alias("lower_bound"), bound("hi", 1.3).alias("upper_bound"),
                    F.lit(0.95).alias("confidence_pct"), day(as_of).alias("run_date")).select(*FORECAST_COLUMNS)


def stale_series(sales: DataFrame, models: DataFrame) -> DataFrame:
    """Series sold after their model was trained, or never trained. ``models`` holds ``trained_on``."""
    last = sales.groupBy(*KEYS).agg(F.max("transaction_date").alias("last_sale"))
    trained = models.groupBy(*KEYS).agg(F.max("trained_on").alias("trained_on"))
    return (last.join(trained, KEYS, "left").filter(F.col("trained_on").isNull() | (F.col("last_sale") > F.col("trained_on")))
            .select(*KEYS, "last_sale"))
