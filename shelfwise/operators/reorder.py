"""Reorder engine: at-risk filter, forecast selection, recommendations, transfers, basket triggers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import params
from shelfwise.operators.common import day, latest_row, num
from shelfwise.operators.quality import issues

KEYS = ["sku_id", "location_id"]


def active_skus(master: DataFrame, as_of: date, dead_days: int = 180) -> DataFrame:
    """Active SKUs without the dead tail: flagged and not sold for ``dead_days`` (strictly)."""
    stale = F.coalesce(F.col("is_dead_stock"), F.lit(False)) & (
        F.col("last_sale_date").isNull() | (F.col("last_sale_date") < day(as_of, -dead_days)))
    return master.filter(F.col("is_active") & ~stale)


def latest_stock(snapshots: DataFrame, as_of: date, lookback: int = 7,
                 excluded: tuple[str, ...] = params.EXCLUDED_LOCATIONS) -> DataFrame:
    recent = snapshots.filter((F.col("snapshot_date") >= day(as_of, -lookback)) & ~F.col("location_id").isin(*excluded))
    cols = recent.select(*KEYS, "snapshot_date", num("qty_on_hand").alias("qty_on_hand"),
                         num("qty_on_order").alias("qty_on_order"), F.col("reorder_point").cast("double").alias("buyer_min"))
    return latest_row(cols, KEYS, ["snapshot_date"]).drop("snapshot_date")


def at_risk_skus(stock: DataFrame, skus: DataFrame, scores: DataFrame, p: params.Reorder = params.Reorder()) -> DataFrame:
    """SKUs short anywhere: out of stock, or covered for less than the network's longest lead allows."""
    longest = scores.agg(F.greatest(F.lit(p.default_lead_days), F.max("avg_lead_time_days")).alias("max_lead"))
    limit = F.greatest(F.lit(p.coverage_days), 2.0 * (F.col("max_lead") + p.safety_days))
    weekly = num("avg_weekly_units")
    out = (F.col("qty_on_hand") <= 0) | (F.col("qty_on_hand") + F.col("qty_on_order") <= 0)
    thin = (weekly > 0) & (F.col("qty_on_hand") / F.when(weekly > 0, weekly / 7.0) < limit)
    return (stock.join(skus.select("sku_id", "avg_weekly_units"), "sku_id").crossJoin(F.broadcast(longest))  # one row
            .filter(out | F.coalesce(thin, F.lit(False))).select("sku_id").distinct())


def forecast_means(forecasts: DataFrame, as_of: date, p: params.Reorder = params.Reorder()) -> DataFrame:
    """Mean daily forecast over the horizon of the newest run per (sku, location, model). Days
    without a row count as zero."""
    runs = (forecasts.filter(F.col("forecast_date").between(day(as_of), day(as_of, p.horizon_days - 1)))
            .groupBy(*KEYS, "model_type", "run_date").agg(F.sum(num("predicted_qty")).alias("q")))
    return (runs.groupBy(*KEYS, "model_type").agg(F.max_by("q", "run_date").alias("q"))
            .select(*KEYS, "model_type", (F.col("q") / float(p.horizon_days)).alias("avg_daily")))


def select_forecast(pairs: DataFrame, means: DataFrame, shares: DataFrame, p: params.Reorder = params.Reorder()) -> DataFrame:
    """Adds ``avg_daily`` and ``model_used`` to (sku, location, abc_class) rows; pairs without any
    usable forecast drop out. Per model: the pair's own forecast, then the network one; the
    network rolling mean is scaled by the location's share."""
    models = sorted({m for ms in params.MODEL_PREFERENCE.values() for m in ms})

    def per_model(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.max(F.when(F.col("model_type") == m, F.col("avg_daily"))).alias(f"{prefix}_{m}")
                                       for m in models])

    network = F.col("location_id") == params.NETWORK
    exact = per_model(means.filter(~network), KEYS, "own")
    whole = per_model(means.filter(network), ["sku_id"], "net")
    newest = shares.groupBy("sku_id").agg(F.max("run_date").alias("run_date"))
    current = shares.join(newest, ["sku_id", "run_date"], "left_semi").select(*KEYS, "share")
    known = current.select("sku_id").distinct().withColumn("has_shares", F.lit(True))
    x = (pairs.join(exact, KEYS, "left").join(whole, "sku_id", "left").join(current, KEYS, "left")
         .join(known, "sku_id", "left"))
    scale = F.coalesce("share", F.when(F.col("has_shares").isNull(), F.lit(p.equal_share)))

    def option(value: Column, label: str, usable: Column | None = None) -> Column:
        ok = value.isNotNull() if usable is None else value.isNotNull() & usable
        return F.when(ok, F.struct(value.alias("avg_daily"), F.lit(label).alias("model_used")))

    def choice(order: tuple[str, ...]) -> Column:
        options = []
        for m in order:
            options.append(option(F.col(f"own_{m}"), m))
            if m == "rolling_avg":
                options.append(option(F.col(f"net_{m}") * scale, params.NETWORK_MODEL, F.coalesce(scale > 0, F.lit(False))))
            else:
                options.append(option(F.col(f"net_{m}"), m))
        return F.coalesce(*options)

    picked = choice(params.DEFAULT_MODELS)
    for cls, order in params.MODEL_PREFERENCE.items():
        picked = F.when(F.col("abc_class") == cls, choice(order)).otherwise(picked)
    return x.withColumn("_pick", picked).filter("_pick is not null").select(*pairs.columns, "_pick.*")


def stock_positions(stock: DataFrame, skus: DataFrame, at_risk: DataFrame, scores: DataFrame, orders: DataFrame,
                    means: DataFrame, shares: DataFrame, as_of: date, p: params.Reorder = params.Reorder(),
                    supplier_lookback: int = 180) -> DataFrame:
    """Every at-risk position with its forecast, supplier, lead time and days of supply."""
    bought = (orders.filter((F.col("po_date") >= day(as_of, -supplier_lookback)) & (F.col("supplier_id") != "")
                            & F.col("status").isin("open", "received", "partial"))
              .groupBy("sku_id").agg(F.max_by("supplier_id", F.struct("po_date", "supplier_id")).alias("fallback")))
    info = (skus.select("sku_id", "abc_class", "xyz_class", "primary_supplier_id").join(at_risk, "sku_id", "left_semi")
            .join(bought, "sku_id", "left")
            .withColumn("supplier_id", F.coalesce(F.nullif("primary_supplier_id", F.lit("")), "fallback"))
            .join(scores.select("supplier_id", "avg_lead_time_days", "risk_flag"), "supplier_id", "left")
            .withColumn("lead_days", F.coalesce(F.when(F.col("avg_lead_time_days") != 0, F.col("avg_lead_time_days")),
                                                F.lit(p.default_lead_days)))
            .select("sku_id", "abc_class", "xyz_class", "supplier_id", "risk_flag", "lead_days"))
    x = select_forecast(stock.join(info, "sku_id"), means, shares, p)
    demand = F.when(F.col("avg_daily") > 0, F.col("avg_daily"))
    return (x.withColumn("threshold", F.col("lead_days") + p.safety_days)
            .withColumn("days_of_supply", F.col("qty_on_hand") / demand)  # null: it never ends
            .withColumn("target", F.col("avg_daily") * F.col("threshold") * safety_multiplier(F.col("xyz_class")))
            .withColumn("shortfall", F.greatest(F.lit(0.0), F.col("target") - F.col("qty_on_hand") - F.col("qty_on_order"))))


def safety_multiplier(xyz: Column) -> Column:
    out = F.lit(params.XYZ_SAFETY[None])
    for cls in ("X", "Y", "Z"):
        out = F.when(xyz == cls, params.XYZ_SAFETY[cls]).otherwise(out)
    return out


def urgency(days: Column, p: params.Reorder = params.Reorder()) -> Column:
    return F.when(days < p.critical_days, "critical").when(days < p.warning_days, "warning").otherwise("normal")


def whole_units(qty: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(qty).cast("long"))


def transfer_sources(needs: DataFrame, positions: DataFrame, p: params.Reorder = params.Reorder()) -> DataFrame:
    """Best source per needing position: enough surplus, and most days left after giving.

    Only positions with a surplus join, so the work per SKU is needing times giving locations and
    the choice is an aggregate that starts on the map side."""
    keep = F.col("avg_daily") * (F.col("lead_days") + p.safety_days + p.transfer_padding_days)
    surplus = F.when(F.col("avg_daily") > 0, F.greatest(F.lit(0.0), F.col("qty_on_hand") - keep)).otherwise(F.col("qty_on_hand") * 0.5)
    giving = positions.select("sku_id", F.col("location_id").alias("source"), surplus.alias("surplus"),
                              F.col("qty_on_hand").alias("source_on_hand"), F.col("avg_daily").alias("source_daily")).filter("surplus > 0")
    left_after = F.coalesce((F.col("source_on_hand") - F.col("shortfall")) / F.when(F.col("source_daily") > 0, F.col("source_daily")),
                            F.lit(float("inf")))
    return (needs.select(*KEYS, "shortfall").join(giving, "sku_id")
            .filter((F.col("source") != F.col("location_id")) & (F.col("surplus") >= F.col("shortfall")))
            .groupBy(*KEYS).agg(F.min_by("source", F.struct((-left_after).alias("o"), "source")).alias("transfer_from_location")))


REC_COLUMNS = ("sku_id", "location_id", "recommendation_date", "qty_to_order", "supplier_id", "recommendation_type",
               "transfer_from_location", "days_of_supply_remaining", "urgency", "forecast_model_used", "supplier_risk_flag")


def recommend(positions: DataFrame, chronic: DataFrame, as_of: date, p: params.Reorder = params.Reorder()) -> DataFrame:
    """Orders and transfers for positions whose supply ends before the next delivery could arrive.
    The transfer test uses the shortfall before the boost of chronic gaps."""
    needs = positions.filter((F.col("days_of_supply") < F.col("threshold")) & (F.col("shortfall") >= p.min_order_qty))
    boosted = chronic.select(*KEYS).distinct().withColumn("boost", F.lit(p.chronic_multiplier))
    x = (needs.join(transfer_sources(needs, positions, p), KEYS, "left").join(boosted, KEYS, "left"))
    moved = F.col("transfer_from_location").isNotNull()
    days = F.col("days_of_supply")
    return x.select(
        *KEYS, day(as_of).alias("recommendation_date"),
        whole_units(F.col("shortfall") * F.coalesce("boost", F.lit(1.0))).alias("qty_to_order"),
        F.when(~moved, F.col("supplier_id")).alias("supplier_id"),
        F.when(moved, "transfer").otherwise("po").alias("recommendation_type"), "transfer_from_location",
        F.bround(days, 2).alias("days_of_supply_remaining"),
        urgency(days, p).alias("urgency"), F.col("model_used").alias("forecast_model_used"),
        F.when(~moved, F.col("risk_flag")).alias("supplier_risk_flag"))


def basket_triggered(recommended: DataFrame, positions: DataFrame, rules: DataFrame, as_of: date,
                     p: params.Reorder = params.Reorder()) -> DataFrame:
    """Low positions of SKUs that sell together with a recommended SKU."""
    partners = (rules.filter(F.col("confidence") >= p.basket_confidence)
                .join(recommended.select(F.col("sku_id").alias("antecedent_sku")), "antecedent_sku", "left_semi")
                .select(F.col("consequent_sku").alias("sku_id")).distinct())
    low = (positions.join(partners, "sku_id", "left_semi").join(recommended.select(*KEYS), KEYS, "left_anti")
           .filter((F.col("days_of_supply") < p.basket_supply_days) & (F.col("shortfall") >= p.min_order_qty)))
    return low.select(
        *KEYS, day(as_of).alias("recommendation_date"), whole_units(F.col("shortfall")).alias("qty_to_order"), "supplier_id",
        F.lit("basket_triggered").alias("recommendation_type"), F.lit(None).cast("string").alias("transfer_from_location"),
        F.bround("days_of_supply", 2).alias("days_of_supply_remaining"), urgency(F.col("days_of_supply"), p).alias("urgency"),
        F.col("model_used").alias("forecast_model_used"), F.col("risk_flag").alias("supplier_risk_flag"))


def threshold_gaps(positions: DataFrame, p: params.Reorder = params.Reorder()) -> DataFrame:
    """Positions where the computed level and the buyer's minimum differ by more than the allowed ratio."""
    base = F.greatest(F.col("buyer_min"), F.lit(1.0))
    return (positions.filter(F.col("days_of_supply") < F.col("threshold"))
            .filter(F.col("buyer_min").isNotNull() & ((F.col("buyer_min") > 1) | (F.col("target") > 1)))
            .withColumn("gap", (F.col("target") - F.col("buyer_min")) / base)
            .filter(F.abs("gap") > p.mismatch_ratio))


def threshold_mismatches(positions: DataFrame, as_of: date, p: params.Reorder = params.Reorder()) -> DataFrame:
    rows = threshold_gaps(positions, p).withColumn("id", F.concat_ws("|", *KEYS, F.lit(as_of.isoformat())))
    kinds = [issues(rows.filter(cond), "reorder_recommendations", "id", "reorder_threshold_mismatch",
                    "computed level and buyer minimum disagree", "reorder_point", severity, F.col("buyer_min"))
             for cond, severity in ((F.abs("gap") > 1.0, "error"), (F.abs("gap") <= 1.0, "warning"))]
    return kinds[0].unionByName(kinds[1])


def threshold_bias(positions: DataFrame, p: params.Reorder = params.Reorder()) -> DataFrame:
    """How often, and by how much, the computed level lies above or below the buyer's."""
    g = F.col("gap")
    return (threshold_gaps(positions, p).groupBy(F.when(g > 0, "high").otherwise("low").alias("direction"))
            .agg(F.count(F.lit(1)).alias("positions"), F.bround(F.avg(F.abs(g)) * 100, 4).alias("avg_gap_pct")))
