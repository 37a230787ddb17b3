"""Stocking gaps, outside purchases and the combined transfer-intelligence report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import params
from shelfwise.operators.common import (count_if, day, longest_streak, most_frequent, newest_run, num,
                                        total)
from shelfwise.session import settle


def trend(last: Column, prior: Column, up: float, down: float) -> Column:
    r = last / F.when(prior != 0, prior)
    return (F.when(prior == 0, F.when(last > 0, "INCREASING").otherwise("STABLE"))
            .when(r >= up, "INCREASING").when(r <= down, "DECREASING").otherwise("STABLE"))


def stocking_gaps(recommendations: DataFrame, master: DataFrame, snapshots: DataFrame, as_of: date,
                  p: params.StockingGap = params.StockingGap(),
                  excluded: tuple[str, ...] = params.NOT_BRANCHES) -> DataFrame:
    """Repeated transfers of a SKU to a branch, scored as a stocking gap. The distribution center stocks
    for others, so what it receives is no gap."""
    keys = ["sku_id", "location_id"]
    moved = recommendations.filter((F.col("recommendation_type") == "transfer")
                                   & (F.col("recommendation_date") >= day(as_of, -p.lookback_days))
                                   & ~F.col("location_id").isin(*excluded))
    # One row per (pair, day), so later steps see at most the days of the window per pair.
    daily = settle(moved.groupBy(*keys, "recommendation_date").agg(
        F.sum(F.when(F.col("qty_to_order") > 0, F.col("qty_to_order"))).alias("q"),
        count_if(F.col("qty_to_order") > 0).alias("n")))
    d = F.col("recommendation_date")
    g = daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("transfer_frequency"), F.sum("q").alias("q"), F.sum("n").alias("n"),
        count_if(d >= day(as_of, -30)).alias("last30"),
        count_if(d.between(day(as_of, -60), day(as_of, -31))).alias("prior30"))
    sources = most_frequent(moved.filter("transfer_from_location is not null"), keys, "transfer_from_location",
                            "transfer_from_location")
    points = newest_run(snapshots, "snapshot_date").select(*keys, F.col("reorder_point").cast("double").alias("rop"))
    x = (g.join(longest_streak(daily, keys, "recommendation_date"), keys).join(sources, keys, "left")
         .join(master.select("sku_id", F.col("unit_cost").cast("double").alias("cost")), "sku_id", "left")
         .join(points, keys, "left")
         .withColumn("avg_qty", F.coalesce(F.col("q") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0))))
    freq, streak = F.col("transfer_frequency"), F.col("streak")
    chronic = (freq >= p.chronic_frequency) | (streak >= p.chronic_streak)
    strength = F.greatest(F.least(freq / float(p.chronic_frequency), F.lit(1.0)),
                          F.least(streak / float(p.chronic_streak), F.lit(1.0)))
    score = (F.when(chronic, F.least(0.70 + 0.30 * strength, F.lit(1.0)))
             .when(freq >= p.recurring_frequency, F.least(0.40 + 0.30 * (freq - 5) / 5.0, F.lit(0.699)))
             .otherwise(freq / 5.0 * 0.40))
    avg = F.col("avg_qty")
    return x.select(
        *keys, day(as_of).alias("analysis_date"), "transfer_from_location", "transfer_frequency",
        streak.alias("transfer_streak"), F.bround(avg, 4).alias("avg_qty_recommended"),
        F.bround(avg * F.coalesce("cost", F.lit(0.0)) * freq, 2).alias("total_transfer_value"),
        F.bround(score, 4).alias("gap_score"),
        F.when(chronic, "CHRONIC").when(freq >= p.recurring_frequency, "RECURRING").otherwise("OCCASIONAL").alias("gap_classification"),
        F.when(chronic, F.bround(avg * p.boost * p.safety, 2)).alias("suggested_stock_increase"),
        F.bround("rop", 2).alias("current_reorder_point"),
        F.when(chronic, F.bround(freq / float(p.lookback_days) * 365 * avg * p.cost_per_unit, 2)).alias("annual_cost_savings"),
        trend(F.col("last30"), F.col("prior30"), p.trend_up, p.trend_down).alias("trend_direction"))


def outside_summary(detail: DataFrame, start: date) -> DataFrame:
    """Sales filled by buying outside (not stocked), per part and location."""
    return (detail.filter((F.col("tran_date") >= F.lit(start)) & (F.col("stock_flag") == "N") & (F.col("tran_code") == "SL"))
            .groupBy("prod_line_pn", "location_id")
            .agg(F.count(F.lit(1)).alias("opsl_count"), total("sales").alias("total_opsl_sales"),
                 total("gross_profit").alias("total_opsl_gp"), F.max("tran_date").alias("last_opsl_date")))


def margin_baselines(detail: DataFrame, start: date) -> DataFrame:
    return (detail.filter((F.col("tran_date") >= F.lit(start)) & F.col("tran_code").isin(*params.SALE_CODES) & (F.col("sales") > 0))
            .groupBy("location_id")
            .agg(F.try_divide(total("gross_profit"), total("sales")).alias("avg_gp_pct")))


def outside_flags(detail: DataFrame, recommendations: DataFrame, start: date, normal_margin: float = 0.35,
                  high: int = 5, medium: int = 2) -> DataFrame:
    base = margin_baselines(detail, start).select("location_id", F.bround("avg_gp_pct", 4).alias("base"))
    queue = (newest_run(recommendations, "recommendation_date")
             .select(F.col("sku_id").alias("prod_line_pn"), "location_id").distinct().withColumn("queued", F.lit(True)))
    s = F.col("total_opsl_sales")
    x = (outside_summary(detail, start).join(base, "location_id", "left")
         .join(queue, ["prod_line_pn", "location_id"], "left")
         .withColumn("base", F.coalesce("base", F.lit(normal_margin)))
         .withColumn("avg_gp_pct", F.when(s > 0, F.bround(F.col("total_opsl_gp") / F.when(s > 0, s), 4)).otherwise(0.0)))
    n = F.col("opsl_count")
    return x.select(
        "prod_line_pn", "location_id", "opsl_count", F.bround(s, 4).alias("total_opsl_sales"),
        F.bround("total_opsl_gp", 4).alias("total_opsl_gp"), "avg_gp_pct", F.col("base").alias("baseline_gp_pct"),
        F.bround(F.greatest(F.lit(0.0), F.col("base") - F.col("avg_gp_pct")) * s, 4).alias("estimated_margin_recovery"),
        F.when(n >= high, "HIGH").when(n >= medium, "MEDIUM").otherwise("LOW").alias("flag"), "last_opsl_date",
        F.coalesce("queued", F.lit(False)).alias("in_reorder_queue"))


def outside_orders(flags: DataFrame, as_of: date) -> DataFrame:
    """An order for each often bought part that is not queued yet."""
    return (flags.filter("flag = 'HIGH' and not in_reorder_queue")
            .select(F.col("prod_line_pn").alias("sku_id"), "location_id", day(as_of).alias("recommendation_date"),
                    (F.col("opsl_count") * 2).cast("double").alias("qty_to_order"), F.lit("po").alias("recommendation_type"),
                    F.lit("warning").alias("urgency"), F.lit("OPSL").alias("source")))


def confirm_gaps(gaps: DataFrame, flags: DataFrame, detail: DataFrame, start: date, normal_margin: float = 0.35) -> DataFrame:
    """Cross-check with outside purchases; measured margin loss replaces the estimate of chronic gaps."""
    keys = ["sku_id", "location_id"]
    base = margin_baselines(detail, start)
    loss = F.coalesce("avg_gp_pct", F.lit(normal_margin)) * F.col("total_opsl_sales") - F.col("total_opsl_gp")
    measured = (outside_summary(detail, start).filter("total_opsl_sales > 0").join(base, "location_id", "left")
                .withColumn("loss", loss).filter("loss > 0")
                .select(F.col("prod_line_pn").alias("sku_id"), "location_id", F.bround(F.col("loss") * 4, 2).alias("actual")))
    hot = (flags.filter(F.col("flag").isin("HIGH", "MEDIUM")).select(F.col("prod_line_pn").alias("sku_id"), "location_id")
           .distinct().withColumn("hot", F.lit(True)))
    chronic = F.col("gap_classification") == "CHRONIC"
    return (gaps.join(hot, keys, "left").join(measured, keys, "left")
            .withColumn("double_confirmed", F.coalesce("hot", F.lit(False)))
            .withColumn("confidence", F.when(F.col("double_confirmed"), "HIGH").otherwise("MEDIUM"))
            .withColumn("savings_source", F.when(chronic, F.when(F.col("actual").isNotNull(), "OPSL_ACTUAL")
                                                 .otherwise("TRANSFER_ESTIMATE")))
            .withColumn("annual_cost_savings", F.when(chronic, F.coalesce("actual", "annual_cost_savings")))
            .drop("hot", "actual"))


def transfer_intelligence(gaps: DataFrame, understocked: DataFrame, master: DataFrame, cover_days: float = 21.0) -> DataFrame:
    """Both signals side by side: confirmed by both, transfers only, understocked only."""
    keys = ["sku_id", "location_id"]
    g = (newest_run(gaps, "analysis_date").filter(F.col("gap_classification").isin("CHRONIC", "RECURRING"))
         .select(*keys, F.lit(True).alias("in_gap"), "transfer_frequency", "transfer_streak", "gap_score",
                 "gap_classification", "avg_qty_recommended", "total_transfer_value", "suggested_stock_increase",
                 "current_reorder_point", "annual_cost_savings"))
    u = understocked.select(*keys, F.lit(True).alias("in_under"), "stockout_days_pct", "days_below_reorder", "days_observed",
                            "avg_daily_demand", "inventory_value_at_risk", "current_min_qty", "suggested_min_qty",
                            "min_qty_gap", F.col("unit_cost").alias("u_cost"), "priority_score", "sku_description")
    m = master.select("sku_id", "description", "avg_weekly_units", F.col("unit_cost").cast("double").alias("m_cost"))
    in_gap, in_under = F.coalesce("in_gap", F.lit(False)), F.coalesce("in_under", F.lit(False))
    x = (g.join(u, keys, "full").join(m, "sku_id", "left")
         .withColumn("tier", F.when(in_gap & in_under, 1).when(in_gap, 2).otherwise(3))
         .withColumn("cost", F.coalesce("u_cost", "m_cost"))
         .withColumn("daily", F.coalesce("avg_daily_demand", F.when(num("avg_weekly_units") > 0, num("avg_weekly_units") / 7.0)))
         .withColumn("min_now", F.coalesce("current_min_qty", "current_reorder_point")))
    increase = F.when(F.col("current_reorder_point").isNotNull(), F.col("suggested_stock_increase"))
    risk = F.coalesce(F.bround("inventory_value_at_risk", 2),
                      F.when(F.col("cost") != 0, F.bround(F.col("daily") * F.col("cost") * cover_days, 2)))
    priority = (F.when(F.col("tier") == 1, num("inventory_value_at_risk") * (1.0 + num("gap_score")))
                .when(F.col("tier") == 2, F.coalesce("annual_cost_savings", num("gap_score") * num("total_transfer_value")))
                .otherwise(num("priority_score")))
    return x.select(
        *keys, F.coalesce(F.when(F.col("sku_description") != "", F.col("sku_description")), F.col("description"), F.lit(""))
        .alias("sku_description"), "tier",
        F.when(F.col("tier") == 1, "CONFIRMED_GAP").when(F.col("tier") == 2, "TRANSFER_PATTERN_ONLY").otherwise("UNDERSTOCKED_ONLY").alias("tier_label"),
        "transfer_frequency", "transfer_streak", "gap_score", "gap_classification", "avg_qty_recommended",
        F.bround("annual_cost_savings", 2).alias("annual_transfer_savings"), "stockout_days_pct", "days_below_reorder",
        "days_observed", F.bround("daily", 4).alias("avg_daily_demand"), risk.alias("inventory_value_at_risk"),
        F.bround("min_now", 2).alias("current_min_qty"),
        F.bround(F.when(in_under, F.col("suggested_min_qty")).otherwise(F.col("current_reorder_point") + increase), 2)
        .alias("suggested_min_qty"),
        F.bround(F.when(in_under, num("min_qty_gap")).otherwise(F.coalesce(increase, F.lit(0.0))), 2).alias("min_qty_gap"),
        F.bround("cost", 2).alias("unit_cost"), F.bround(priority, 4).alias("priority_score"))
