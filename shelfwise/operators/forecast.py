"""Baseline forecasts: rolling averages, network fallback, flat fallback and the feature frame."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise import params
from shelfwise.operators.common import count_if, day, num, pop_std
from shelfwise.operators.demand import daily_demand, effective_demand, training_sales
from shelfwise.session import settle

FORECAST_COLUMNS = ("sku_id", "location_id", "forecast_date", "model_type", "predicted_qty", "lower_bound",
                    "upper_bound", "confidence_pct", "run_date")


def _moments(daily: DataFrame, keys: list[str], as_of: date, lookback: int) -> DataFrame:
    """Mean and deviation over all ``lookback`` days; days without a row count as zero."""
    inside = F.col("day") < day(as_of)
    d = F.when(inside, F.col("demand")).otherwise(0.0)
    g = daily.groupBy(*keys).agg(F.sum(d).alias("s"), F.sum(d * d).alias("ss"),
                                 count_if(inside & (F.col("sold") == 1)).alias("sale_days"))
    return g.select(*keys, "sale_days", (F.col("s") / lookback).alias("mean"),
                    pop_std(F.col("s"), F.col("ss"), lookback).alias("sd"))


def with_regional(pairs: DataFrame, tiers: DataFrame, quality: DataFrame, low_quality: float = 0.50) -> DataFrame:
    """Adds ``regional``, the SKU's mean over first- and second-tier locations, and ``weak``, true for
    third-tier locations with poor demand quality. A SKU has one row per location here, so the
    regional mean is a plain aggregate joined back on the SKU."""
    p = (pairs.join(tiers.select("location_id", "location_tier"), "location_id", "left")
         .join(quality.select("sku_id", "location_id", "demand_quality_score"), ["sku_id", "location_id"], "left"))
    tier, score = F.coalesce("location_tier", F.lit(2)), F.coalesce("demand_quality_score", F.lit(1.0))
    regional = p.filter(tier <= 2).groupBy("sku_id").agg(F.avg("mean").alias("regional"))
    return p.join(regional, "sku_id", "left").withColumn("weak", (tier == 3) & (score < low_quality))


def leaned(own: Column, regional: Column, weak: Column, weight: float = 0.40) -> Column:
    """Weak locations lean on the regional mean."""
    return F.when(weak, F.lit(weight) * regional + F.lit(1.0 - weight) * own).otherwise(own)


def _over_horizon(df: DataFrame, as_of: date, horizon: int, model: str, confidence: float) -> DataFrame:
    dates = F.explode(F.sequence(day(as_of), day(as_of, horizon - 1))).alias("forecast_date")
    return (df.select("*", dates)
            .select("sku_id", "location_id", "forecast_date", F.lit(model).alias("model_type"), "predicted_qty",
                    "lower_bound", "upper_bound", F.lit(confidence).alias("confidence_pct"),
                    day(as_of).alias("run_date")))


def _band(mean: Column, sd: Column, predicted: Column) -> list[Column]:
    return [F.bround(predicted, 4).alias("predicted_qty"),
            F.bround(F.greatest(F.lit(0.0), mean - sd), 4).alias("lower_bound"),
            F.bround(mean + sd, 4).alias("upper_bound")]


def rolling_pairs(sales: DataFrame, tiers: DataFrame, quality: DataFrame, as_of: date, lookback: int = 91,
                  min_days: int = 7, horizon: int = 30) -> DataFrame:
    # Read twice below (own and regional means); stored, so the sales are scanned once.
    pairs = settle(_moments(daily_demand(sales, as_of, lookback), ["sku_id", "location_id"], as_of, lookback))
    m = with_regional(pairs, tiers, quality).filter(F.col("sale_days") >= min_days)
    blend = leaned(F.col("mean"), F.coalesce("regional", "mean"), F.col("weak"))
    rows = m.select("sku_id", "location_id", *_band(F.col("mean"), F.col("sd"), blend))
    return _over_horizon(rows, as_of, horizon, "rolling_avg", 0.6827)


def rolling_network(sales: DataFrame, as_of: date, lookback: int = 91, min_days: int = 3, horizon: int = 30) -> DataFrame:
    daily = (daily_demand(sales, as_of, lookback).groupBy("sku_id", "day")
             .agg(F.sum("demand").alias("demand"), F.max("sold").alias("sold")))
    m = _moments(daily, ["sku_id"], as_of, lookback).filter(F.col("sale_days") >= min_days)
    rows = m.select("sku_id", F.lit(params.NETWORK).alias("location_id"),
                    *_band(F.col("mean"), F.col("sd"), F.col("mean")))
    return _over_horizon(rows, as_of, horizon, "rolling_avg", 0.6827)


def demand_shares(sales: DataFrame, as_of: date, lookback: int = 91, min_days: int = 3) -> DataFrame:
    """Each location's part of a SKU's positive demand, for SKUs with enough network sale days."""
    daily = settle(daily_demand(sales, as_of, lookback).filter(F.col("day") < day(as_of)))
    enough = (daily.filter("sold = 1").groupBy("sku_id").agg(F.countDistinct("day").alias("n"))
              .filter(F.col("n") >= min_days).select("sku_id"))
    local = daily.groupBy("sku_id", "location_id").agg(F.sum("positive").alias("q")).filter("q > 0")
    whole = local.groupBy("sku_id").agg(F.sum("q").alias("total"))
    return (local.join(whole, "sku_id").join(enough, "sku_id", "left_semi")
            .select("sku_id", "location_id", F.bround(F.col("q") / F.col("total"), 6).alias("share"),
                    day(as_of).alias("run_date")))


def rolling_targets(master: DataFrame, forecasts: DataFrame, as_of: date, fresh_days: int = 7) -> DataFrame:
    """C-class SKUs, and A-class SKUs without a fresh seasonal forecast."""
    fresh = (forecasts.filter((F.col("model_type") == "prophet") & (F.col("run_date") >= day(as_of, -fresh_days)))
             .select("sku_id").distinct())
    a = master.filter("abc_class = 'A'").select("sku_id").join(fresh, "sku_id", "left_anti")
    return master.filter("abc_class = 'C'").select("sku_id").union(a).distinct()


def covered_targets(master: DataFrame, forecasts: DataFrame, as_of: date, fresh_days: int = 7) -> DataFrame:
    """A-class SKUs that do have a fresh seasonal forecast."""
    fresh = forecasts.filter((F.col("model_type") == "prophet") & (F.col("run_date") >= day(as_of, -fresh_days)))
    return master.filter("abc_class = 'A'").select("sku_id").intersect(fresh.select("sku_id"))


def seasonal_targets(master: DataFrame, detail: DataFrame, as_of: date, lookback: int = 90, by_profit: bool = True) -> DataFrame:
    """All A-class SKUs for the seasonal model with their rank value: recent profit, or stock value moved."""
    a = master.filter("abc_class = 'A'").select("sku_id", "avg_weekly_units", "unit_cost")
    gp = (detail.filter((F.col("tran_date") >= day(as_of, -lookback)) & F.col("tran_code").isin(*params.SALE_CODES))
          .groupBy(F.col("prod_line_pn").alias("sku_id")).agg(F.sum("gross_profit").cast("double").alias("gp"))
          .filter("gp > 0"))
    hits = a.join(gp, "sku_id", "left")
    units, cost = num("avg_weekly_units"), num("unit_cost")
    moved = F.when(cost > 0, units * cost).otherwise(units)
    value = F.coalesce("gp", F.lit(0.0)) if by_profit else moved
    return hits.select("sku_id", F.bround(value, 4).alias("rank_value"))


def flat_fallback(sales: DataFrame, as_of: date, days: int = 28, spread: float = 0.30, horizon: int = 30,
                  history: int = 730) -> DataFrame:
    """Mean over the active days of the last ``days`` (of all history if none), with a fixed band."""
    daily = daily_demand(sales, as_of, history).filter(F.col("day") < day(as_of))
    recent = F.avg(F.when(F.col("day") >= day(as_of, -days), F.col("demand")))
    m = daily.groupBy("sku_id", "location_id").agg(F.coalesce(recent, F.avg("demand")).alias("mean"))
    mean = F.greatest(F.lit(0.0), F.col("mean"))
    rows = m.select("sku_id", "location_id", F.bround(mean, 4).alias("predicted_qty"),
                    F.bround(mean * (1 - spread), 4).alias("lower_bound"),
                    F.bround(mean * (1 + spread), 4).alias("upper_bound"))
    return _over_horizon(rows, as_of, horizon, "prophet", 0.95)


def freeze_features(weather: DataFrame, station: str | None = None, before: DataFrame | None = None, block_days: int = 1024) -> DataFrame:
    """Freeze-thaw flag and running streak of freezing days of each station; a missing minimum ends the streak.

    A segmented scan in two levels: a station's days are cut into blocks, each counted by itself and
    summed up in one row (does it hold a warm day, and how many cold ones follow its last); the rows of a
    station's blocks, in order, give the streak that reaches into each block. So a station is many tasks.
    ``before`` (station, streak) is the streak that each station brings along: one more block."""
    days = ["_station", "_block"]
    cold = F.coalesce(F.col("temp_min_f") < 32, F.lit(False)).cast("int")
    number = F.floor(F.datediff(F.col("log_date"), F.lit(date(1970, 1, 1))) / block_days)
    w = weather.withColumns({"_station": F.lit("") if station is None else F.col(station).cast("string"), "_cold": cold,
                             "_block": F.coalesce(number, F.lit(-(1 << 40)))})
    so_far = Window.partitionBy(*days).orderBy("log_date").rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(*days, "_warm").orderBy("log_date").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("_warm", F.sum(1 - F.col("_cold")).over(so_far)).withColumn("_run", F.sum("_cold").over(run))
    blocks = (w.groupBy(*days, "_warm").agg(F.sum("_cold").alias("_tail")).groupBy(*days)
              .agg(F.max_by("_tail", "_warm").alias("_tail"), F.max("_warm").alias("_warm")))
    if before is not None:
        name = F.lit("") if station is None else F.col(station).cast("string")
        blocks = blocks.unionByName(before.select(name.alias("_station"), F.lit(-(1 << 41)).alias("_block"),
                                                  F.col("streak").cast("long").alias("_tail"), F.lit(1).cast("long").alias("_warm")))
    order = Window.partitionBy("_station").orderBy("_block")
    blocks = blocks.withColumn("_part", F.sum((F.col("_warm") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("_station", "_part").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    carried = (blocks.withColumn("_reach", F.sum("_tail").over(within))
               .select(F.col("_station").alias("_s"), F.col("_block").alias("_b"), F.lag("_reach", 1, 0).over(order).alias("_carry")))
    joined = w.join(carried, F.col("_station").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    streak = F.col("_run") + F.when(F.col("_warm") == 0, F.col("_carry")).otherwise(0)
    return (joined.withColumn("consecutive_freeze_days", streak.cast("int"))
            .withColumn("freeze_thaw_cycle", F.coalesce((F.col("temp_min_f") < 32) & (F.col("temp_max_f") >= 32), F.lit(False)))
            .drop("_station", "_cold", "_block", "_warm", "_run", "_s", "_b", "_carry"))


WEATHER_FEATURES = ("temp_min_f", "freeze_thaw_cycle", "snowfall_in", "consecutive_freeze_days")
FEATURES = ("day_of_week", "week_of_year", "month", "lag_7", "lag_14", "lag_28", "rolling_mean_7", "rolling_mean_28",
            *WEATHER_FEATURES, "demand_quality_score", "xyz_code")


def feature_frame(sales: DataFrame, skus: DataFrame, weather: DataFrame, quality: DataFrame, master: DataFrame,
                  as_of: date, training_days: int = 365, horizon: int = 30) -> DataFrame:
    """Fourteen features per (sku, location, day), from the pair's first sale to the end of the
    horizon. ``target`` is the day's demand, null after the pair's last sale; lags that reach into
    the future take ``recent``, the mean of the last 28 days up to that sale. ``active_mean`` is the
    mean over days with a sale. Each window partition is one pair's calendar, bounded by the
    training days."""
    d = effective_demand()
    seen = settle(training_sales(sales).join(skus.select("sku_id"), "sku_id", "left_semi")
            .filter(F.col("transaction_date").between(day(as_of, -training_days), day(as_of, -1)))
            .groupBy("sku_id", "location_id", F.col("transaction_date").alias("day")).agg(F.sum(d).alias("demand")))
    keys = ["sku_id", "location_id"]
    ends = seen.groupBy(*keys).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                                   F.avg("demand").alias("active_mean"))
    tail = F.sum(F.when(F.col("day") > F.date_sub("last_day", 28), F.col("demand")).otherwise(0.0))
    length = F.least(F.datediff("last_day", "first_day") + 1, F.lit(28))
    pairs = (seen.join(ends, keys).groupBy(*keys, "first_day", "last_day", "active_mean").agg(tail.alias("tail"))
             .withColumn("recent", F.col("tail") / length))
    calendar = pairs.select(*keys, "recent", "last_day", "active_mean",
                            F.explode(F.sequence("first_day", day(as_of, horizon - 1))).alias("day"))
    past = F.col("day") < day(as_of)
    filled = (calendar.join(seen, ["sku_id", "location_id", "day"], "left")
              .withColumn("v", F.when(past, F.coalesce("demand", F.lit(0.0))).otherwise(F.col("recent"))))
    w = Window.partitionBy("sku_id", "location_id").orderBy("day")

    def mean_before(k):
        return F.coalesce(F.sum("v").over(w.rowsBetween(-k, -1)), F.lit(0.0)) / float(k)

    lags = [F.coalesce(F.lag("v", k).over(w), F.lit(0.0)).alias(f"lag_{k}") for k in (7, 14, 28)]
    base = filled.select(*keys, "day", "recent", "last_day", "active_mean",
                         F.when(F.col("day") <= F.col("last_day"), F.col("v")).alias("target"), *lags,
                         mean_before(7).alias("rolling_mean_7"), mean_before(28).alias("rolling_mean_28"))
    wx = freeze_features(weather).select(
        F.col("log_date").alias("day"), F.coalesce("temp_min_f", F.lit(32.0)).alias("temp_min_f"),
        F.col("freeze_thaw_cycle").cast("double").alias("freeze_thaw_cycle"),
        F.coalesce("snowfall_in", F.lit(0.0)).alias("snowfall_in"),
        F.col("consecutive_freeze_days").cast("double").alias("consecutive_freeze_days"))
    wx = wx.filter(F.col("day") >= day(as_of, -training_days))
    climate = wx.filter(F.col("day") <= day(as_of)).agg(*[F.avg(c).alias(f"mean_{c}") for c in WEATHER_FEATURES])
    codes = master.select("sku_id", F.when(F.col("xyz_class") == "X", 0.0).when(F.col("xyz_class") == "Z", 2.0)
                          .otherwise(1.0).alias("xyz_code"))
    return (base.join(wx, "day", "left").crossJoin(F.broadcast(climate))  # one row
            .join(quality.select("sku_id", "location_id", "demand_quality_score"), ["sku_id", "location_id"], "left")
            .join(codes, "sku_id", "left")
            .select(*keys, "day", "target", "recent", "last_day", "active_mean",
                    F.weekday("day").cast("double").alias("day_of_week"),
                    F.weekofyear("day").cast("double").alias("week_of_year"), F.month("day").cast("double").alias("month"),
                    "lag_7", "lag_14", "lag_28", "rolling_mean_7", "rolling_mean_28",
                    *[F.coalesce(c, F.col(f"mean_{c}")).alias(c) for c in WEATHER_FEATURES],
                    F.coalesce("demand_quality_score", F.lit(1.0)).alias("demand_quality_score"),
                    F.coalesce("xyz_code", F.lit(1.0)).alias("xyz_code")))
