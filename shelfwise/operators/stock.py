"""Stock health: dead stock, chronic understocking and the network trigger."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise import params
from shelfwise.operators.common import count_if, day, newest_first, newest_run, num, top_per_group, total, total_if
from shelfwise.session import settle


def resolved_costs(snapshots: DataFrame, master: DataFrame, orders: DataFrame) -> DataFrame:
    """Unit cost per SKU: newest snapshot, then the master, then the newest received order line."""
    snap = (newest_run(snapshots, "snapshot_date").filter("unit_cost > 0")
            .groupBy("sku_id").agg(F.max("unit_cost").cast("double").alias("snap_cost")))
    bought = (orders.filter("status = 'received' and unit_cost is not null").groupBy("sku_id")
              .agg(F.max_by("unit_cost", F.struct("actual_delivery_date", "po_number", "line_number", "unit_cost"))
                   .cast("double").alias("po_cost")))
    known = master.select("sku_id", F.when(F.col("unit_cost") > 0, F.col("unit_cost").cast("double")).alias("master_cost"))
    return (known.join(snap, "sku_id", "full").join(bought, "sku_id", "full")
            .select("sku_id", F.coalesce("snap_cost", "master_cost", "po_cost").alias("unit_cost")))


def dead_stock(snapshots: DataFrame, master: DataFrame, orders: DataFrame, sales: DataFrame, detail: DataFrame,
               needs: DataFrame, shortages: DataFrame, as_of: date,
               p: params.DeadStock = params.DeadStock()) -> DataFrame:
    """Every stocked position scored by age and value. ``needs`` are the day's recommendations and
    ``shortages`` the understocking rows; either turns a sell-off into a transfer."""
    stocked = (snapshots.groupBy("sku_id", "location_id")
               .agg(F.max_by(F.col("qty_on_hand").cast("double"), newest_first("snapshot_date", "qty_on_hand")).alias("qty_on_hand"))
               .filter("qty_on_hand > 0"))
    moved = (sales.filter(F.col("transaction_date") >= day(as_of, -p.lookback_days))
             .filter(~F.coalesce(F.col("is_warranty"), F.lit(False)))
             .groupBy("sku_id", "location_id")
             .agg(F.max("transaction_date").alias("last_sale"), F.countDistinct("transaction_date").alias("freq")))
    supplier = (orders.filter("status = 'received' and supplier_id <> ''").groupBy("sku_id")
                .agg(F.max_by("supplier_id", F.struct("actual_delivery_date", "po_number", "line_number", "supplier_id"))
                     .alias("supplier_id")))
    wanted = (needs.filter((F.col("recommendation_date") == day(as_of)) & (F.col("qty_to_order") > 0))
              .select("sku_id", "location_id", F.lit(0).alias("p"))
              .unionByName(shortages.select("sku_id", "location_id", F.lit(1).alias("p")))
              .groupBy("sku_id").agg(F.min_by("location_id", F.struct("p", "location_id")).alias("transfer_candidate_location")))
    active = (detail.filter(F.col("tran_date") >= day(as_of, -365)).select(F.col("prod_line_pn").alias("sku_id"))
              .distinct().withColumn("data_conflict", F.lit(True)))
    info = master.select("sku_id", "abc_class", "avg_weekly_units", "last_sale_date")
    x = (stocked.join(info, "sku_id", "left").join(resolved_costs(snapshots, master, orders), "sku_id", "left")
         .join(supplier, "sku_id", "left").join(wanted, "sku_id", "left").join(active, "sku_id", "left")
         .join(moved, ["sku_id", "location_id"], "left"))
    x = (x.withColumn("unit_cost", F.coalesce("unit_cost", F.lit(p.default_cost)))
         .withColumn("sale_frequency", F.coalesce("freq", F.lit(0)))
         .withColumn("days_since_sale", F.coalesce(F.datediff(day(as_of), F.coalesce("last_sale", "last_sale_date")),
                                                   F.lit(p.lookback_days)))
         .withColumn("value", F.col("qty_on_hand") * F.col("unit_cost"))
         .withColumn("age", F.col("days_since_sale") / 365.0)
         .withColumn("urgency", F.col("age") * F.log10(F.col("value") + 1)))
    healthy = (F.col("sale_frequency") >= p.frequent_sales) | (F.col("days_since_sale") < p.idle_days)
    cls = (F.when(healthy, "HEALTHY").when(F.col("urgency") >= p.liquidate_urgency, "LIQUIDATE")
           .when(F.col("urgency") >= p.markdown_urgency, "MARKDOWN").otherwise("MONITOR"))
    abc = F.coalesce("abc_class", F.lit("C"))
    action = (F.when(F.col("classification") == "MARKDOWN", params.ACTION_MARKDOWN)
              .when(F.col("classification") != "LIQUIDATE", "")
              .when(F.col("value") < p.write_off_value, params.ACTION_WRITE_OFF)
              .when(F.col("supplier_id").isNotNull(), params.ACTION_RETURN)
              .when((num("avg_weekly_units") >= p.fast_units) | abc.isin("A", "B"), params.ACTION_MARKDOWN)
              .otherwise(params.ACTION_LIQUIDATE))
    sell = F.col("classification").isin("LIQUIDATE", "MARKDOWN")
    return x.withColumn("classification", cls).select(
        "sku_id", "location_id", "classification", action.alias("action"),
        F.bround(F.col("value") * (F.col("days_since_sale") / float(p.lookback_days)) / (F.col("sale_frequency") + 1), 4)
        .alias("dead_stock_score"),
        F.bround(F.when(F.col("classification") == "HEALTHY", 0.0).otherwise(F.col("urgency")), 4).alias("urgency_score"),
        F.bround("value", 4).alias("total_inv_value"), "qty_on_hand", "unit_cost", "days_since_sale", "sale_frequency",
        abc.alias("abc_class"), "supplier_id",
        F.when(sell & F.col("transfer_candidate_location").isNotNull(), "TRANSFER").otherwise(F.col("classification"))
        .alias("action_type"),
        "transfer_candidate_location", F.coalesce("data_conflict", F.lit(False)).alias("data_conflict"))


def dead_stock_flags(scored: DataFrame) -> DataFrame:
    """True for SKUs to liquidate anywhere, False for SKUs healthy somewhere and liquidated nowhere."""
    g = scored.groupBy("sku_id").agg(F.bool_or(F.col("classification") == "LIQUIDATE").alias("bad"),
                                     F.bool_or(F.col("classification") == "HEALTHY").alias("good"))
    return g.filter("bad or good").select("sku_id", F.col("bad").alias("is_dead_stock"))


def dead_stock_summary(scored: DataFrame, min_alert_value: float = 500.0) -> DataFrame:
    v, c = F.col("total_inv_value"), F.col("classification")
    liq, mark = c == "LIQUIDATE", c == "MARKDOWN"
    sell = liq | mark
    clean = sell & ~F.col("data_conflict")
    return scored.agg(
        F.count(F.lit(1)).alias("total_positions_scored"), count_if(liq).alias("liquidate_count"),
        count_if(mark).alias("markdown_count"), count_if(c == "MONITOR").alias("monitor_count"),
        count_if(c == "HEALTHY").alias("healthy_count"), F.bround(total_if(sell, v), 2).alias("capital_at_risk"),
        F.bround(total_if(clean, v), 2).alias("clean_capital_at_risk"), F.bround(total_if(liq, v), 2).alias("liquidate_value"),
        F.bround(total_if(mark, v), 2).alias("markdown_value"),
        count_if(sell & (F.col("action_type") == "TRANSFER")).alias("transfer_count"),
        count_if(sell & F.col("data_conflict")).alias("data_conflict_count"),
        count_if(clean & (v >= min_alert_value)).alias("alert_eligible_count"))


def profit_per_unit(detail: DataFrame, as_of: date, lookback: int = 90) -> DataFrame:
    g = (detail.filter((F.col("tran_date") >= day(as_of, -lookback)) & F.col("tran_code").isin(*params.SALE_CODES))
         .groupBy(F.col("prod_line_pn").alias("sku_id")).agg(total("gross_profit").alias("gp"), total("qty_ship").alias("q")))
    return g.select("sku_id", F.when(F.col("q") > 0, F.col("gp") / F.when(F.col("q") > 0, F.col("q"))).otherwise(0.0)
                    .alias("gp_per_unit"))


def chronic_understocking(snapshots: DataFrame, master: DataFrame, detail: DataFrame, recommendations: DataFrame,
                          outside_flags: DataFrame, as_of: date, lookback: int = 90, min_share: float = 0.30,
                          cover_days: float = 21.0, network_locations: int = 5, severe_share: float = 0.50,
                          excluded: tuple[str, ...] = params.NOT_BRANCHES) -> DataFrame:
    """Branch positions below their reorder point on at least ``min_share`` of the observed days."""
    seen = snapshots.filter((F.col("snapshot_date") >= day(as_of, -lookback)) & (F.col("reorder_point") > 0)
                            & ~F.col("location_id").isin(*excluded))
    costed = F.when(F.col("unit_cost").isNotNull(), newest_first("snapshot_date", "unit_cost"))
    stats = (seen.groupBy("sku_id", "location_id")
             .agg(F.count(F.lit(1)).alias("days_observed"),
                  count_if(num("qty_on_hand") < F.col("reorder_point")).alias("days_below_reorder"),
                  F.max_by(F.col("reorder_point").cast("double"), newest_first("snapshot_date", "reorder_point")).alias("current_min"),
                  F.max_by(F.col("unit_cost").cast("double"), costed).alias("cost"))
             .withColumn("pct", F.col("days_below_reorder") / F.col("days_observed"))
             .filter(F.col("pct") >= min_share))
    transfers = (recommendations.filter((F.col("recommendation_type") == "transfer")
                                        & (F.col("recommendation_date") >= day(as_of, -30)))
                 .groupBy("sku_id", "location_id").agg(F.count(F.lit(1)).alias("transfers")))
    confirmed = (outside_flags.filter(F.col("flag").isin("HIGH", "MEDIUM"))
                 .select(F.col("prod_line_pn").alias("sku_id"), "location_id").distinct().withColumn("double", F.lit(True)))
    x = (stats.join(master.select("sku_id", "description", "avg_weekly_units", F.col("unit_cost").alias("master_cost")), "sku_id")
         .join(profit_per_unit(detail, as_of, lookback), "sku_id", "left")
         .join(transfers, ["sku_id", "location_id"], "left").join(confirmed, ["sku_id", "location_id"], "left")
         .withColumn("daily", num("avg_weekly_units") / 7.0)
         .withColumn("unit", F.coalesce("cost", F.col("master_cost").cast("double"), F.lit(0.0)))
         .filter("daily > 0 and unit > 0 and pct > 0"))
    suggested = F.col("daily") * cover_days
    rows = settle(x.select(
        "sku_id", "location_id", F.coalesce("description", F.lit("")).alias("sku_description"),
        "days_observed", "days_below_reorder", F.bround("pct", 4).alias("stockout_days_pct"),
        F.bround("daily", 4).alias("avg_daily_demand"), F.bround("current_min", 2).alias("current_min_qty"),
        F.bround(suggested, 2).alias("suggested_min_qty"), F.bround(suggested - F.col("current_min"), 2).alias("min_qty_gap"),
        F.bround("unit", 2).alias("unit_cost"), F.bround(F.col("daily") * F.col("unit") * cover_days, 2).alias("inventory_value_at_risk"),
        F.coalesce("transfers", F.lit(0)).alias("transfer_recommended_count"),
        F.bround(F.col("pct") * F.col("daily") * F.col("unit"), 4).alias("priority_score"),
        F.bround(F.col("pct") * num("gp_per_unit") * F.col("daily"), 2).alias("financial_severity"),
        F.bround(num("gp_per_unit"), 4).alias("avg_gp_pct"),
        F.coalesce("double", F.lit(False)).alias("double_confirmed")))
    wide = (rows.filter(F.col("stockout_days_pct") > severe_share).groupBy("sku_id")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= network_locations)
            .select("sku_id", F.lit(True).alias("network_flag")))
    return rows.join(wide, "sku_id", "left").withColumn("network_flag", F.coalesce("network_flag", F.lit(False)))


def understocking_report(rows: DataFrame, top_n: int = 20) -> DataFrame:
    order = [F.desc("double_confirmed"), F.desc("financial_severity"), F.asc("sku_id")]
    return top_per_group(rows, ["location_id"], order, top_n).drop("rank_in_group")


def network_orders(rows: DataFrame, as_of: date, hub: str = params.DISTRIBUTION_CENTER, severe_share: float = 0.50,
                   buffer: float = 1.5) -> DataFrame:
    """One order to the hub per SKU short across the network. The list of locations is as long as
    the number of locations, never as the number of rows."""
    short = rows.filter(F.col("network_flag") & (F.col("stockout_days_pct") > severe_share))
    entry = F.struct((-F.col("stockout_days_pct")).alias("k"), "location_id",
                     F.concat("location_id", F.lit(" ("), F.bround(F.col("stockout_days_pct") * 100).cast("int").cast("string"),
                              F.lit("%)")).alias("t"))
    g = short.groupBy("sku_id").agg(F.sum(F.col("min_qty_gap").cast("decimal(18,2)")).cast("double").alias("gap"),
                                    F.array_sort(F.collect_list(entry)).alias("e"))
    return g.select("sku_id", F.lit(hub).alias("location_id"), day(as_of).alias("recommendation_date"),
                    F.bround(F.greatest(F.col("gap") * buffer, F.lit(1.0)), 2).alias("qty_to_order"),
                    F.lit("po").alias("recommendation_type"), F.lit("critical").alias("urgency"),
                    F.lit("NETWORK_UNDERSTOCK").alias("source"),
                    F.concat(F.lit("Network understocking trigger: "),
                             F.array_join(F.transform("e", lambda s: s["t"]), ", ")).alias("notes"))
