"""Alert generators (one row per alert) and the lifecycle of alerts across days."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import params
from shelfwise.operators.common import count_if, day, latest_row, num

AUTO_RESOLVED = ("CRITICAL_STOCKOUT", "LOW_SUPPLY", "CHURN_RISK", "OPSL_GAP")
FREEZE_SUB_CATEGORIES = ("batteries", "antifreeze", "coolant", "water pumps", "radiator hoses")
ALERT_COLUMNS = ("alert_date", "alert_type", "severity", "sku_id", "location_id", "supplier_id", "customer_id",
                 "message", "alert_key", "financial_impact")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def alert(df: DataFrame, as_of: date, kind: str, severity: str, key: list[str], message: Column,
          impact: Column | None = None, **ids: str) -> DataFrame:
    """Alert rows: the key joins the type and the key columns; ids not given are null."""
    id_cols = [(F.col(ids[c]) if c in ids else F.lit(None).cast("string")).alias(c)
               for c in ("sku_id", "location_id", "supplier_id", "customer_id")]
    return df.select(day(as_of).alias("alert_date"), F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"),
                     *id_cols, message.alias("message"), F.concat_ws("|", F.lit(kind), *[_text(k) for k in key]).alias("alert_key"),
                     F.bround(F.coalesce(impact, F.lit(0.0)) if impact is not None else F.lit(0.0), 2).alias("financial_impact"))


def _costs(master: DataFrame) -> DataFrame:
    return master.select("sku_id", num("unit_cost").alias("cost"))


def critical_stockouts(snapshots: DataFrame, recommendations: DataFrame, master: DataFrame, as_of: date,
                       lookback: int = 7) -> DataFrame:
    keys = ["sku_id", "location_id"]
    last = latest_row(snapshots.filter(F.col("snapshot_date") >= day(as_of, -lookback))
                      .select(*keys, "snapshot_date", "is_stockout"), keys, ["snapshot_date"]).filter("is_stockout")
    wanted = (recommendations.filter(F.col("recommendation_date") == day(as_of)).groupBy(*keys)
              .agg(F.max(num("qty_to_order")).alias("qty")))
    x = last.join(wanted, keys, "left").join(_costs(master), "sku_id", "left")
    return alert(x, as_of, "CRITICAL_STOCKOUT", "critical", keys, F.concat("sku_id", F.lit(" is out of stock at "), "location_id"),
                 num("qty") * num("cost"), sku_id="sku_id", location_id="location_id")


def low_supply(recommendations: DataFrame, master: DataFrame, as_of: date, below: float = 3.0) -> DataFrame:
    d = num("days_of_supply_remaining")
    x = (recommendations.filter((F.col("recommendation_date") == day(as_of)) & (d > 0) & (d < below))
         .join(_costs(master), "sku_id", "left"))
    text = F.concat("sku_id", F.lit(" at "), "location_id", F.lit(" has "), _text(F.bround(d, 1)), F.lit(" days of supply left"))
    return alert(x, as_of, "LOW_SUPPLY", "critical", ["sku_id", "location_id"], text, num("qty_to_order") * num("cost"),
                 sku_id="sku_id", location_id="location_id")


def freeze_alerts(weather: DataFrame, master: DataFrame, as_of: date, below_f: float = 20.0, ahead: int = 7,
                  categories: tuple[str, ...] = params.FREEZE_CATEGORIES,
                  sub_categories: tuple[str, ...] = FREEZE_SUB_CATEGORIES) -> DataFrame:
    cold = F.col("temp_min_f") < below_f
    outlook = (weather.filter(F.col("log_date").between(day(as_of), day(as_of, ahead)) & cold)
               .agg(F.count(F.lit(1)).alias("cold_days"), F.min("temp_min_f").alias("coldest")).filter("cold_days > 0"))
    exposed = master.filter(F.col("is_active") & (F.lower("part_category").isin(*categories)
                                                  | F.lower("sub_category").isin(*sub_categories)))
    x = exposed.crossJoin(F.broadcast(outlook))  # one row
    text = F.concat(F.lit("Freeze ahead: "), _text("cold_days"), F.lit(" cold days, coldest "), _text("coldest"),
                    F.lit("F; review "), F.col("sku_id"))
    return alert(x, as_of, "FREEZE_ALERT", "warning", ["sku_id"], text, sku_id="sku_id")


def supplier_risk(scores: DataFrame, orders: DataFrame, master: DataFrame, as_of: date, lookback: int = 90) -> DataFrame:
    red = (latest_row(scores.filter(F.col("score_date") >= day(as_of, -lookback))
                      .select("supplier_id", "score_date", "risk_flag", "composite_score"), ["supplier_id"], ["score_date"])
           .filter("risk_flag = 'red'"))
    x = (orders.filter(F.col("status").isin("open", "partial")).join(red, "supplier_id").join(_costs(master), "sku_id", "left"))
    text = F.concat(F.lit("Open order "), _text("po_number"), F.lit(" for "), "sku_id", F.lit(" is with red supplier "), "supplier_id")
    return alert(x, as_of, "SUPPLIER_RISK", "warning", ["supplier_id", "sku_id", "po_number"], text,
                 num("qty_ordered") * num("cost"), sku_id="sku_id", supplier_id="supplier_id")


def dead_stock_alerts(scored: DataFrame, as_of: date, min_value: float = 500.0) -> DataFrame:
    g = (scored.filter(~F.coalesce(F.col("data_conflict"), F.lit(False))).groupBy("sku_id")
         .agg(F.sum("total_inv_value").alias("value"), F.max("days_since_sale").alias("idle"))
         .filter(F.col("value") >= min_value))
    text = F.concat("sku_id", F.lit(" is dead stock, "), _text("idle"), F.lit(" days idle"))
    return alert(g, as_of, "DEAD_STOCK", "info", ["sku_id"], text, F.col("value"), sku_id="sku_id")


def dead_stock_by_flag(master: DataFrame, as_of: date, dead_days: int = 180) -> DataFrame:
    """The fallback while no dead-stock report exists."""
    x = master.filter(F.col("is_dead_stock") & (F.col("last_sale_date").isNull()
                                                | (F.col("last_sale_date") < day(as_of, -dead_days))))
    return alert(x, as_of, "DEAD_STOCK", "info", ["sku_id"], F.concat("sku_id", F.lit(" is flagged dead stock")), sku_id="sku_id")


def dead_stock_chain(scored: DataFrame, master: DataFrame, as_of: date) -> DataFrame:
    """Alerts of the report, or of the flags in the master while the report has no rows."""
    unreported = scored.limit(1).agg(F.count(F.lit(1))).scalar() == 0
    return dead_stock_alerts(scored, as_of).unionByName(dead_stock_by_flag(master, as_of).where(unreported))


def transfer_opportunity(recommendations: DataFrame, as_of: date) -> DataFrame:
    """One summary of all transfers waiting for approval."""
    g = (recommendations.filter((F.col("recommendation_date") == day(as_of)) & (F.col("recommendation_type") == "transfer")
                                & ~F.coalesce(F.col("is_approved"), F.lit(False)))
         .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sku_id").alias("skus"),
              F.countDistinct("location_id").alias("locs"), F.sum(num("qty_to_order")).cast("long").alias("qty")).filter("n > 0"))
    text = F.concat(_text("n"), F.lit(" transfers of "), _text("skus"), F.lit(" SKUs to "), _text("locs"),
                    F.lit(" locations, "), _text("qty"), F.lit(" units, await approval"))
    return alert(g.withColumn("scope", F.lit("SUMMARY")), as_of, "TRANSFER_OPPORTUNITY", "info", ["scope"], text)


def accuracy_drop(weekly: DataFrame, as_of: date, above: float = 25.0) -> DataFrame:
    x = weekly.filter(F.col("mape") > above)
    text = F.concat("abc_class", F.lit("-class "), "model_type", F.lit(" weekly error is "), _text(F.bround("mape", 0).cast("long")),
                    F.lit("% over "), _text("observations"), F.lit(" forecasts"))
    return alert(x, as_of, "FORECAST_ACCURACY_DROP", "warning", ["abc_class", "model_type"], text)


def churn_risk(flags: DataFrame, as_of: date, quarter: float = 3.0) -> DataFrame:
    x = flags.filter(F.col("flag").isin("AT_RISK", "CHURNED", "LOST"))
    text = F.concat(F.lit("Customer "), "customer_id", F.lit(" at "), "location_id", F.lit(" is "), "flag",
                    F.lit(", last purchase "), _text("last_purchase_date"))
    return alert(x, as_of, "CHURN_RISK", "warning", ["customer_id", "location_id"], text,
                 num("baseline_monthly_spend") * quarter, customer_id="customer_id", location_id="location_id")


def outside_gap(flags: DataFrame, as_of: date) -> DataFrame:
    x = flags.filter("flag = 'HIGH' and not in_reorder_queue")
    text = F.concat("prod_line_pn", F.lit(" at "), "location_id", F.lit(" was bought outside "), _text("opsl_count"), F.lit(" times"))
    return alert(x, as_of, "OPSL_GAP", "info", ["prod_line_pn", "location_id"], text, num("estimated_margin_recovery"),
                 sku_id="prod_line_pn", location_id="location_id")


def all_alerts(generators: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    out = None
    for make in generators.values():
        out = make() if out is None else out.unionByName(make())
    return out


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


MARKS = {"is_acknowledged": "boolean", "acknowledged_by": "string", "acknowledged_at": "date"}
STATE_COLUMNS = (*ALERT_COLUMNS, "first_seen_date", "days_active", "resolved", "resolved_date", *MARKS)


def empty_state(alerts: DataFrame) -> DataFrame:
    return (alerts.withColumn("first_seen_date", F.lit(None).cast("date")).withColumn("days_active", F.lit(None).cast("int"))
            .withColumn("resolved", F.lit(None).cast("boolean")).withColumn("resolved_date", F.lit(None).cast("date"))
            .withColumns({c: F.lit(None).cast(t) for c, t in MARKS.items()}).limit(0))


def acknowledge(state: DataFrame, marks: DataFrame) -> DataFrame:
    """The alert table after readers have acknowledged rows, given by (alert_key, alert_date) with who and
    when. The earliest of several marks counts, and a row that is acknowledged keeps its mark."""
    keys = ["alert_key", "alert_date"]
    first = (marks.where("acknowledged_at is not null").groupBy(*keys)
             .agg(F.min(F.struct("acknowledged_at", "acknowledged_by")).alias("_mark")))
    new = F.col("_mark").isNotNull() & ~F.coalesce(F.col("is_acknowledged"), F.lit(False))
    return (state.join(first, keys, "left")
            .withColumn("_new", new)
            .withColumns({"is_acknowledged": F.col("_new") | F.coalesce("is_acknowledged", F.lit(False)),
                          **{c: F.when(F.col("_new"), F.col(f"_mark.{c}")).otherwise(F.col(c))
                             for c in ("acknowledged_by", "acknowledged_at")}})
            .select(*STATE_COLUMNS))


def waiting(alerts: DataFrame) -> DataFrame:
    """Alerts that nobody has acknowledged; fresh alert rows have no mark yet."""
    if "is_acknowledged" not in alerts.columns:
        return alerts
    return alerts.where(~F.coalesce("is_acknowledged", F.lit(False)))


def advance(state: DataFrame, current: DataFrame, as_of: date, lookback: int = 30,
            auto: tuple[str, ...] = AUTO_RESOLVED) -> DataFrame:
    """The alert table after one more run.

    Per key, the newest row of the look-back decides: written today already, leave it; open, move it
    to today with one more active day and fresh text, acknowledged or not as it was; resolved or absent, start a new row. Open rows
    of the auto-resolved types whose key no longer occurs are closed. Returns the whole new table,
    to be written as a new version."""
    cutoff = day(as_of, -lookback)
    # One alert per key and run: the one with the largest impact.
    now = latest_row(current.select(*ALERT_COLUMNS), ["alert_key"], ["financial_impact"])
    fresh = [c for c in ALERT_COLUMNS if c not in ("alert_date", "alert_key")]
    in_reach = F.col("alert_date") >= cutoff
    newest = state.filter(in_reach).groupBy("alert_key").agg(F.max("alert_date").alias("_newest"))
    rows = (state.join(newest, "alert_key", "left")
            .withColumn("_last", F.coalesce(F.col("alert_date") == F.col("_newest"), F.lit(False)))
            .join(now.select("alert_key", F.lit(True).alias("_now"), *[F.col(c).alias(f"_new_{c}") for c in fresh]),
                  "alert_key", "left"))
    here = F.coalesce(F.col("_now"), F.lit(False))
    moved = F.col("_last") & here & ~F.col("resolved") & (F.col("alert_date") < day(as_of))
    closed = ~here & in_reach & F.col("alert_type").isin(*auto) & ~F.col("resolved")
    kept = rows.select(
        F.when(moved, day(as_of)).otherwise(F.col("alert_date")).alias("alert_date"), "alert_key",
        *[F.when(moved, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in fresh], "first_seen_date",
        F.when(moved, F.coalesce("days_active", F.lit(1)) + 1).otherwise(F.col("days_active")).alias("days_active"),
        (F.col("resolved") | closed).alias("resolved"),
        F.when(closed, day(as_of)).otherwise(F.col("resolved_date")).alias("resolved_date"), *MARKS)
    # A key gets a new row unless its newest row in reach is open or was written today.
    settled = (state.join(newest, "alert_key").filter(F.col("alert_date") == F.col("_newest"))
               .filter(~F.col("resolved") | (F.col("alert_date") == day(as_of))).select("alert_key"))
    added = (now.join(settled, "alert_key", "left_anti")
             .select(day(as_of).alias("alert_date"), "alert_key", *fresh, day(as_of).alias("first_seen_date"),
                     F.lit(1).alias("days_active"), F.lit(False).alias("resolved"), F.lit(None).cast("date").alias("resolved_date"),
                     *[F.lit(False if t == "boolean" else None).cast(t).alias(c) for c, t in MARKS.items()]))
    return kept.unionByName(added).select(*STATE_COLUMNS)
