"""Report sections over the result tables. Each is a flat frame; limits are the top-k of the report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import params
from shelfwise.operators.alerts import severity_rank, waiting
from shelfwise.operators.common import (count_if, day, latest_row, newest_run, num, ratio, top_per_group, total, total_if)
from shelfwise.session import settle



def with_names(df: DataFrame, locations: DataFrame, key: str = "location_id", out: str = "location_display") -> DataFrame:
    """Location name from the dimension, the id where it has none."""
    names = locations.select(F.col("location_id").alias(key), F.col("location_name").alias("_name"))
    return df.join(names, key, "left").withColumn(out, F.coalesce("_name", key)).drop("_name")


def alert_counts(alerts: DataFrame) -> DataFrame:
    return waiting(alerts).groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"),
                                          F.bround(total("financial_impact"), 2).alias("financial_impact"))


def alert_items(alerts: DataFrame, locations: DataFrame) -> DataFrame:
    """Every alert not acknowledged, with its place name; readers sort by (severity_rank, impact)."""
    rows = waiting(alerts).select("alert_type", "severity", "sku_id", "location_id", "alert_key", "financial_impact",
                         severity_rank(F.col("severity")).alias("severity_rank"))
    return with_names(rows, locations)


def latest_recommendations(recs: DataFrame) -> DataFrame:
    return newest_run(recs, "recommendation_date")


def reorder_kpis(recs: DataFrame) -> DataFrame:
    r = latest_recommendations(recs)
    done = F.coalesce(F.col("is_approved"), F.lit(False))
    by = [count_if(F.col("urgency") == u).alias(f"{u}_count") for u in ("critical", "warning", "normal")]
    kinds = [count_if(F.col("recommendation_type") == t).alias(f"{t}_count") for t in ("po", "transfer")]
    return r.agg(F.max("recommendation_date").alias("recommendation_date"), F.count(F.lit(1)).alias("total_recommendations"),
                 count_if(done).alias("approved"), count_if(~done).alias("pending"),
                 F.bround(total("qty_to_order"), 1).alias("total_qty_recommended"), *by, *kinds)


def top_counts(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    return (df.filter(F.col(col).isNotNull() & (F.col(col) != "")).groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), col).limit(k))


def urgency_rank(u: Column) -> Column:
    return F.when(u == "critical", 0).when(u.isin("warning", "high"), 1).when(u.isin("normal", "medium"), 2).otherwise(3)


def pending_recommendations(recs: DataFrame, locations: DataFrame, k: int = 20) -> DataFrame:
    r = latest_recommendations(recs).filter(~F.coalesce(F.col("is_approved"), F.lit(False)))
    top = r.orderBy(urgency_rank(F.col("urgency")), F.desc("qty_to_order"), "sku_id", "location_id").limit(k)
    cols = ("sku_id", "location_id", "recommendation_type", "urgency", "qty_to_order", "supplier_id",
            "days_of_supply_remaining", "transfer_from_location")
    return with_names(top.select(*cols), locations)


def dead_stock_top(scored: DataFrame, k: int = 10) -> DataFrame:
    return (scored.filter("classification = 'LIQUIDATE'").orderBy(F.desc("total_inv_value"), "sku_id", "location_id").limit(k)
            .select("sku_id", "location_id", "action", "action_type", "data_conflict", "total_inv_value", "qty_on_hand",
                    "days_since_sale", "sale_frequency", "abc_class", "supplier_id"))


def as_document(summary: DataFrame, rows: DataFrame, order: list[Column]) -> DataFrame:
    """One JSON document {kpis, rows}: ``summary`` has one row and ``rows`` is already a top-k."""
    numbered = rows.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_o"), F.struct(*rows.columns).alias("_r"))
    listed = numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_r"))), lambda x: x["_r"]).alias("rows"))
    return (summary.select(F.struct(*summary.columns).alias("kpis")).crossJoin(F.broadcast(listed))
            .select(F.to_json(F.struct("kpis", "rows")).alias("document")))


def action_breakdown(scored: DataFrame) -> DataFrame:
    return (scored.filter("classification = 'LIQUIDATE'").groupBy("action")
            .agg(F.count(F.lit(1)).alias("positions"), F.bround(total("total_inv_value"), 2).alias("value")))


def latest_scores(scores: DataFrame) -> DataFrame:
    return latest_row(scores, ["supplier_id"], ["score_date"])


def supplier_health(scores: DataFrame) -> DataFrame:
    return latest_scores(scores).groupBy("risk_flag").agg(F.count(F.lit(1)).alias("suppliers"),
                                                          F.bround(F.avg("composite_score"), 2).alias("avg_score"))


def red_suppliers(scores: DataFrame) -> DataFrame:
    return latest_scores(scores).filter("risk_flag = 'red'").select("supplier_id", "composite_score", "fill_rate_pct",
                                                                    "on_time_delivery_pct")


def inventory_health(snapshots: DataFrame, locations: DataFrame, excluded: tuple[str, ...] = params.EXCLUDED_LOCATIONS) -> DataFrame:
    s = newest_run(snapshots, "snapshot_date").filter(~F.col("location_id").isin(*excluded))
    below = num("qty_on_hand") < F.col("reorder_point")
    g = s.groupBy("location_id").agg(
        F.max("snapshot_date").alias("snapshot_date"), F.count(F.lit(1)).alias("snapshots"), count_if(F.col("is_stockout")).alias("stockouts"),
        count_if(below).alias("below_reorder"), total("qty_on_hand").alias("on_hand"), total("qty_on_order").alias("on_order"))
    return with_names(g.withColumn("stockout_pct", F.bround(100.0 * F.col("stockouts") / F.col("snapshots"), 1)), locations)


def transfers_of_latest_run(recs: DataFrame, excluded: tuple[str, ...] = params.EXCLUDED_LOCATIONS) -> DataFrame:
    t = newest_run(recs.filter("recommendation_type = 'transfer'"), "recommendation_date")
    return t.filter("transfer_from_location <> '' and location_id <> ''").filter(
        ~F.col("transfer_from_location").isin(*excluded) & ~F.col("location_id").isin(*excluded))


def transfer_routes(recs: DataFrame, k: int = 8) -> DataFrame:
    return (transfers_of_latest_run(recs).groupBy(F.col("transfer_from_location").alias("from_location"),
                                                  F.col("location_id").alias("to_location"))
            .agg(F.bround(total("qty_to_order"), 1).alias("qty"), F.count(F.lit(1)).alias("transfer_count"),
                 count_if(F.col("urgency") == "critical").alias("critical_count"))
            .orderBy(F.desc("qty"), "from_location", "to_location").limit(k))


def transfer_skus(recs: DataFrame, k: int = 5) -> DataFrame:
    return (transfers_of_latest_run(recs).groupBy("sku_id").agg(F.bround(total("qty_to_order"), 1).alias("qty"))
            .orderBy(F.desc("qty"), "sku_id").limit(k))


def gross_profit_by_location(detail: DataFrame, as_of: date) -> DataFrame:
    """Current and prior ninety days per location."""
    d = F.col("tran_date")
    now, prior = d >= day(as_of, -90), d.between(day(as_of, -180), day(as_of, -91))
    return (detail.filter((d >= day(as_of, -180)) & F.col("sales").isNotNull()).groupBy("location_id")
            .agg(total_if(now, F.col("sales")).alias("sales_90d"), total_if(now, F.col("gross_profit")).alias("gp_90d"),
                 total_if(prior, F.col("sales")).alias("prior_sales_90d")))


def location_performance(locations: DataFrame, tiers: DataFrame, profit: DataFrame, churn: DataFrame, classes: DataFrame,
                         excluded: tuple[str, ...] = params.EXCLUDED_LOCATIONS) -> DataFrame:
    leaving = (churn.filter(F.col("flag").isin("CHURNED", "DECLINING")).groupBy("location_id")
               .agg(F.count(F.lit(1)).alias("churn_count")))
    a_class = classes.filter("abc_class = 'A'").groupBy("location_id").agg(F.count(F.lit(1)).alias("a_class_count"))
    base = locations.filter(F.coalesce(F.col("is_active"), F.lit(True)) & ~F.col("location_id").isin(*excluded)).select(
        "location_id", F.coalesce("location_name", "location_id").alias("location_name"))
    x = base
    for other in (tiers.drop("classified_date"), profit, leaving, a_class):
        x = x.join(other, "location_id", "left")
    s, p = F.col("sales_90d"), F.col("prior_sales_90d")
    return x.select(
        "location_id", "location_name", F.coalesce("location_tier", F.lit(2)).alias("location_tier"),
        F.coalesce("composite_tier_score", F.lit(0.0)).alias("composite_tier_score"), F.bround(s, 2).alias("sales_90d"),
        F.bround("gp_90d", 2).alias("gp_90d"), F.bround(ratio(F.col("gp_90d"), s) * 100, 1).alias("gp_pct"),
        F.bround(ratio(s - p, p) * 100, 1).alias("sales_trend_pct"), F.coalesce("churn_count", F.lit(0)).alias("churn_count"),
        F.coalesce("a_class_count", F.lit(0)).alias("a_class_count"))


def network_kpis(master: DataFrame, anomalies: DataFrame, locations: DataFrame, scores: DataFrame, as_of: date) -> DataFrame:
    """Four one-row aggregates side by side."""
    skus = master.agg(F.count(F.lit(1)).alias("total_skus"),
                      *[count_if(F.col("abc_class") == k).alias(f"class_{k.lower()}") for k in "ABC"])
    found = anomalies.filter(F.col("alert_date") >= day(as_of, -30)).agg(F.count(F.lit(1)).alias("anomaly_count"))
    places = locations.agg(count_if(F.coalesce(F.col("is_active"), F.lit(True))).alias("location_count"))
    suppliers = scores.agg(F.countDistinct("supplier_id").alias("supplier_count"))
    out = skus
    for one_row in (found, places, suppliers):
        out = out.crossJoin(F.broadcast(one_row))
    return out


def top_skus(detail: DataFrame, as_of: date, k: int = 10) -> DataFrame:
    g = (detail.filter((F.col("tran_date") >= day(as_of, -90)) & (F.col("gross_profit") > 0) & F.col("prod_line_pn").isNotNull())
         .groupBy(F.col("prod_line_pn").alias("sku_id"))
         .agg(total("gross_profit").alias("gp"), total("sales").alias("s"), F.countDistinct("location_id").alias("location_count")))
    return (g.orderBy(F.desc("gp"), "sku_id").limit(k)
            .select("sku_id", F.bround("gp", 2).alias("total_gp"), F.bround("s", 2).alias("total_sales"),
                    F.bround(ratio(F.col("gp"), F.col("s")) * 100, 1).alias("gp_pct"), "location_count"))


def anomaly_summary(alerts: DataFrame, as_of: date) -> DataFrame:
    return (alerts.filter(F.col("alert_date") >= day(as_of, -30)).groupBy("alert_type", "severity", "location_id")
            .agg(F.count(F.lit(1)).alias("alerts")))


def supplier_detail(scores: DataFrame, orders: DataFrame) -> DataFrame:
    """Score next to what the order lines show. Open lines are neither received nor cancelled."""
    value = num("qty_ordered") * num("unit_cost")
    open_line, got = F.col("status").isin("open", "partial"), F.col("status").isin("received", "partial")
    late = F.when(got, F.datediff("actual_delivery_date", "expected_delivery_date"))
    g = orders.groupBy("supplier_id").agg(
        count_if(open_line).alias("open_po_count"), F.bround(F.coalesce(F.sum(F.when(open_line, value)), F.lit(0.0)), 2).alias("open_po_value"),
        count_if(got).alias("delivered_count"), total_if(got, F.col("qty_ordered")).alias("o"),
        total_if(got, F.col("qty_received")).alias("r"), F.bround(F.avg(late), 1).alias("avg_lead_time_variance"))
    return (latest_scores(scores).join(g, "supplier_id", "left")
            .select("supplier_id", "composite_score", "risk_flag", "fill_rate_pct", "on_time_delivery_pct", "avg_lead_time_days",
                    F.bround(ratio(F.col("r"), F.col("o")) * 100, 1).alias("actual_fill_rate"), "avg_lead_time_variance",
                    F.coalesce("open_po_count", F.lit(0)).alias("open_po_count"),
                    F.coalesce("open_po_value", F.lit(0.0)).alias("open_po_value"),
                    F.coalesce("delivered_count", F.lit(0)).alias("delivered_count")))


def open_orders(orders: DataFrame, k: int = 6) -> DataFrame:
    rows = orders.filter(F.col("status").isin("open", "partial")).select(
        "supplier_id", "po_number", "line_number", "sku_id", "qty_ordered", "status", "expected_delivery_date",
        F.bround(num("qty_ordered") * num("unit_cost"), 2).alias("value"))
    order = [F.asc("expected_delivery_date"), F.asc("po_number"), F.asc("line_number"), F.asc("sku_id"), F.asc("value")]
    return top_per_group(rows, ["supplier_id"], order, k)


def morning_brief(alerts: DataFrame, recs: DataFrame) -> DataFrame:
    critical = waiting(alerts).agg(count_if(F.col("severity") == "critical").alias("critical_alerts"))
    pending = ~F.coalesce(F.col("is_approved"), F.lit(False)) & F.col("urgency").isin("critical", "warning", "high")
    work = latest_recommendations(recs).agg(count_if(pending).alias("urgent_reorders"),
                                            count_if(F.col("recommendation_type") == "transfer").alias("transfer_ops"))
    return critical.crossJoin(F.broadcast(work))  # one row each


def critical_actions(alerts: DataFrame, orders: DataFrame, scores: DataFrame, as_of: date, k: int = 30) -> DataFrame:
    """Critical and commercial alerts, overdue orders and red suppliers with open orders, by impact."""
    wanted = (F.col("severity") == "critical") | F.col("alert_type").isin("CHURN_RISK", "OPSL_GAP")
    null = F.lit(None).cast("string")
    a = (waiting(alerts).filter(wanted)
         .select(F.lit("alert").alias("kind"), "severity", "alert_key", "sku_id", "location_id", "supplier_id", "financial_impact"))
    # Read for overdue orders and for suppliers with any: a stored tenth of the orders, not two passes over all.
    open_orders = settle(orders.filter("status = 'open'").select("po_number", "line_number", "sku_id", "supplier_id",
                                                                 "expected_delivery_date", "qty_ordered", "unit_cost"))
    late = open_orders.filter(F.col("expected_delivery_date") < day(as_of))
    value = F.bround(num("qty_ordered") * num("unit_cost"), 2)
    o = (late.withColumn("v", value)
         .select(F.lit("overdue_po").alias("kind"), F.lit("critical").alias("severity"),
                 F.concat_ws("|", F.lit("overdue_po"), F.col("po_number").cast("string"), F.col("line_number").cast("string"), "sku_id").alias("alert_key"),
                 "sku_id", null.alias("location_id"), "supplier_id", F.col("v").alias("financial_impact")))
    has_open = open_orders.select("supplier_id").distinct()
    r = (red_suppliers(scores).join(has_open, "supplier_id", "left_semi")
         .select(F.lit("red_supplier").alias("kind"), F.lit("warning").alias("severity"),
                 F.concat_ws("|", F.lit("red_supplier"), "supplier_id").alias("alert_key"), null.alias("sku_id"),
                 null.alias("location_id"), "supplier_id", F.lit(0.0).alias("financial_impact")))
    return (a.unionByName(o).unionByName(r)
            .orderBy(F.desc("financial_impact"), severity_rank(F.col("severity")), "alert_key").limit(k))


def freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Newest date of each table and the rows it holds for that date, in one pass per table."""
    out = None
    for name, (df, col) in tables.items():
        per_day = df.groupBy(F.col(col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
        row = per_day.agg(F.max("d").alias("last_run"), F.max_by("n", "d").alias("row_count")).select(
            F.lit(name).alias("stage"), "last_run", "row_count")
        out = row if out is None else out.unionByName(row)
    return out


def stocking_gap_locations(gaps: DataFrame, locations: DataFrame, hub: str = params.DISTRIBUTION_CENTER) -> DataFrame:
    chronic = F.col("gap_classification") == "CHRONIC"
    g = (newest_run(gaps, "analysis_date").filter((F.col("location_id") != hub) & ~F.col("location_id").isin(*params.EXCLUDED_LOCATIONS))
         .groupBy("location_id").agg(count_if(chronic).alias("chronic_count"), F.count(F.lit(1)).alias("gap_count"),
                                     F.bround(total_if(chronic, F.col("annual_cost_savings")), 2).alias("total_annual_savings")))
    return with_names(g, locations)


def stocking_gap_rows(gaps: DataFrame, k: int = 20, hub: str = params.DISTRIBUTION_CENTER) -> DataFrame:
    rank = F.when(F.col("gap_classification") == "CHRONIC", 0).when(F.col("gap_classification") == "RECURRING", 1).otherwise(2)
    rows = newest_run(gaps, "analysis_date").filter((F.col("location_id") != hub) & ~F.col("location_id").isin(*params.EXCLUDED_LOCATIONS))
    order = [F.desc("double_confirmed"), rank.asc(), F.desc(num("annual_cost_savings")), F.desc("transfer_frequency"), F.asc("sku_id")]
    return top_per_group(rows.select("sku_id", "location_id", "transfer_from_location", "transfer_frequency", "gap_score",
                                     "gap_classification", "annual_cost_savings", "double_confirmed", "confidence"),
                         ["location_id"], order, k)


def understocking_locations(rows: DataFrame, locations: DataFrame) -> DataFrame:
    g = rows.groupBy("location_id").agg(F.count(F.lit(1)).alias("sku_count"),
                                        F.bround(total("inventory_value_at_risk"), 2).alias("total_value_at_risk"),
                                        count_if(F.col("double_confirmed")).alias("double_confirmed_count"),
                                        count_if(F.col("network_flag")).alias("network_count"))
    return with_names(g, locations)


def churn_summary(flags: DataFrame) -> DataFrame:
    names = ("AT_RISK", "CHURNED", "LOST", "DECLINING", "STABLE")
    return flags.agg(*[count_if(F.col("flag") == n).alias(n.lower()) for n in names], F.count(F.lit(1)).alias("total"),
                     F.bround(total_if(F.col("flag") != "STABLE", F.col("baseline_monthly_spend")) * 12, 0).alias("annual_revenue_at_risk"))


def churn_tiers(scores: DataFrame) -> DataFrame:
    # Scores have two decimals; their exact sum keeps an average on the edge of rounding from depending on the order of rows.
    average = total(F.col("churn_score").cast("decimal(12,2)")) / F.count("churn_score")
    return scores.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customers"), F.bround(average, 2).alias("avg_score"),
                                           F.bround(total("revenue_90d"), 2).alias("revenue_90d"))


def outside_purchase_report(flags: DataFrame) -> DataFrame:
    return flags.groupBy("flag").agg(F.count(F.lit(1)).alias("pairs"),
                                     F.bround(total("estimated_margin_recovery"), 2).alias("total_recovery"),
                                     count_if(~F.col("in_reorder_queue")).alias("not_queued"))


def weather_outlook(weather: DataFrame, as_of: date, ahead: int = 7, freeze_f: float = 32.0) -> DataFrame:
    return (weather.filter(F.col("log_date").between(day(as_of), day(as_of, ahead)))
            .select("log_date", "temp_min_f", "temp_max_f", "precipitation_in", "snowfall_in", "consecutive_freeze_days",
                    "freeze_thaw_cycle", F.coalesce((F.col("log_date") > day(as_of)) & (F.col("temp_min_f") < freeze_f), F.lit(False))
                    .alias("freeze_warning")))


def top_rules(rules: DataFrame, k: int = 15) -> DataFrame:
    return rules.orderBy(F.desc("lift"), "antecedent_sku", "consequent_sku").limit(k)


def run_metrics(alerts: DataFrame, recs: DataFrame, forecasts: DataFrame, quality: DataFrame, as_of: date) -> DataFrame:
    sev = [count_if(F.col("severity") == s).alias(f"alerts_{s}") for s in ("critical", "warning", "info")]
    out = alerts.filter(F.col("alert_date") == day(as_of)).agg(F.count(F.lit(1)).alias("alerts_total"), *sev)
    others = (recs.filter(F.col("recommendation_date") == day(as_of)).agg(F.count(F.lit(1)).alias("reorders")),
              forecasts.filter(F.col("run_date") == day(as_of)).agg(F.count(F.lit(1)).alias("forecasts")),
              quality.agg(F.count(F.lit(1)).alias("scored_pairs")))
    for one_row in others:
        out = out.crossJoin(F.broadcast(one_row))
    return out
