"""Classification of SKUs, suppliers and locations."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import params
from shelfwise.operators.common import count_if, day, fraction_class, global_rank, num, share_class, total
from shelfwise.session import settle


def _since(df: DataFrame, col: str, as_of: date, days: int) -> DataFrame:
    return df.filter(F.col(col).between(day(as_of, -days), day(as_of)))


def abc_by_revenue(sales: DataFrame, master: DataFrame, as_of: date, lookback: int = 90) -> DataFrame:
    """Top 20 % of the selling SKUs are A, the next 30 % B; the others, and unsold SKUs, C."""
    revenue = (_since(sales, "transaction_date", as_of, lookback).filter("sku_id <> ''")
               .groupBy("sku_id").agg(total("total_revenue").alias("revenue")))
    ranked = global_rank(revenue, [F.desc("revenue"), F.asc("sku_id")])
    classed = ranked.select("sku_id", "revenue",
                            fraction_class(F.col("rank_idx"), F.col("rank_n"), 0.20, 0.50).alias("abc_class"))
    return (master.select("sku_id").join(classed, "sku_id", "full")
            .select("sku_id", F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
                    F.coalesce("abc_class", F.lit("C")).alias("abc_class")))


def listed_weeks(as_of: date, lookback: int) -> list[date]:
    """Mondays of the days as_of-lookback, +7, ... up to as_of."""
    out: list[date] = []
    d = as_of - timedelta(days=lookback)
    while d <= as_of:
        monday = d - timedelta(days=d.weekday())
        if monday not in out:
            out.append(monday)
        d += timedelta(days=7)
    return out


def xyz_by_variability(sales: DataFrame, master: DataFrame, as_of: date, lookback: int = 90, min_weeks: int = 4,
                       x_below: float = 0.5, y_below: float = 1.0) -> DataFrame:
    """Class by the variation of weekly demand. Weeks without a sale count as zero without being
    materialised: the moments come from the sums of the weeks that exist."""
    weeks = listed_weeks(as_of, lookback)
    weekly = (_since(sales, "transaction_date", as_of, lookback).filter("sku_id <> ''")
              .groupBy("sku_id", F.to_date(F.date_trunc("week", "transaction_date")).alias("week"))
              .agg(total("qty_sold").alias("q")))
    q = F.when(F.col("week").isin(weeks), F.col("q")).otherwise(F.lit(0.0))
    n = float(len(weeks))
    stats = weekly.groupBy("sku_id").agg(count_if(F.col("q") > 0).alias("active"), F.sum(q).alias("s"),
                                         F.sum(q * q).alias("ss"))
    mean = F.col("s") / n
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / n - mean * mean))
    enough = F.coalesce(F.col("active"), F.lit(0)) >= min_weeks
    cv = F.when(enough & (mean != 0), sd / F.when(mean != 0, mean))
    return (master.select("sku_id", "abc_class").join(stats, "sku_id", "left")
            .withColumn("cv", cv)
            .withColumn("xyz_class", F.when(~enough, None).when(F.col("cv").isNull(), "Z")
                        .when(F.col("cv") < x_below, "X").when(F.col("cv") < y_below, "Y").otherwise("Z"))
            .select("sku_id", "xyz_class",
                    F.concat(F.coalesce("abc_class", F.lit("C")), F.col("xyz_class")).alias("abc_xyz_class"),
                    F.bround("cv", 4).alias("cv_score")))


def fill_rate(received: Column, ordered: Column) -> Column:
    return F.when(ordered > 0, F.least(received.cast("double") / F.when(ordered > 0, ordered).cast("double"),
                                       F.lit(1.0)))


def supplier_scores(orders: DataFrame, as_of: date, lookback: int = 90) -> DataFrame:
    recent = orders.filter((F.col("po_date") >= day(as_of, -lookback)) & (F.col("supplier_id") != ""))
    both = F.col("actual_delivery_date").isNotNull() & F.col("expected_delivery_date").isNotNull()
    late = F.datediff("actual_delivery_date", "expected_delivery_date")
    filled = F.when(F.col("status").isin("received", "partial"), fill_rate(F.col("qty_received"), F.col("qty_ordered")))
    g = recent.groupBy("supplier_id").agg(
        F.coalesce(F.avg(filled), F.lit(0.0)).alias("fill"),
        F.avg(F.when(both, F.datediff("actual_delivery_date", "po_date"))).alias("lead"),
        F.avg(F.when(both, F.abs(late))).alias("var"),
        F.avg(F.when(both, (late <= 0).cast("int"))).alias("ontime"))
    on_time = F.coalesce(F.col("ontime") * 100, F.lit(50.0))
    steady = F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.col("var"), F.lit(0.0)) * 10.0)
    score = F.col("fill") * 100 * 0.40 + on_time * 0.40 + steady * 0.20
    return g.withColumn("score", score).select(
        "supplier_id", day(as_of).alias("score_date"), F.bround("fill", 4).alias("fill_rate_pct"),
        F.bround("lead", 2).alias("avg_lead_time_days"), F.bround("var", 2).alias("lead_time_variance_avg"),
        F.bround("ontime", 4).alias("on_time_delivery_pct"), F.bround("score", 2).alias("composite_score"),
        F.when(F.col("score") > 80, "green").when(F.col("score") >= 60, "amber").otherwise("red").alias("risk_flag"))


def pearson(x: Column, y: Column, min_pairs: int = 5) -> Column:
    """Correlation from sums; null under ``min_pairs`` pairs or without variance."""
    n, sx, sy = F.count(F.lit(1)), F.sum(x), F.sum(y)
    spread = (n * F.sum(x * x) - sx * sx) * (n * F.sum(y * y) - sy * sy)
    r = (n * F.sum(x * y) - sx * sy) / F.sqrt(F.when(spread > 0, spread))
    return F.when(n >= min_pairs, r)


def weather_sensitivity(sales: DataFrame, master: DataFrame, weather: DataFrame, as_of: date,
                        lookback: int = 730) -> DataFrame:
    """Correlation of a category's daily demand with the day's minimum temperature, per SKU."""
    temps = (weather.filter("not is_forecast and temp_min_f is not null")
             .filter(F.col("log_date") >= day(as_of, -lookback))
             .select(F.col("log_date").alias("transaction_date"), F.col("temp_min_f").cast("double").alias("t")))
    by_sku_day = (_since(sales, "transaction_date", as_of, lookback)
                  .groupBy("sku_id", "transaction_date").agg(total("qty_sold").alias("q")))
    categories = master.filter("part_category <> ''").select("sku_id", "part_category")
    daily = (by_sku_day.join(categories, "sku_id").groupBy("part_category", "transaction_date")
             .agg(F.sum("q").alias("q")).join(temps, "transaction_date"))
    corr = daily.groupBy("part_category").agg(pearson(F.col("t"), F.col("q")).alias("r"))
    return (categories.join(corr.filter("r is not null"), "part_category")
            .select("sku_id", F.bround("r", 4).alias("weather_sensitivity_score")))


def sku_metrics(sales: DataFrame, as_of: date, lookback: int = 365, done: DataFrame | None = None) -> DataFrame:
    """Last sale and average weekly units; ``done`` holds SKUs to skip when a run is resumed."""
    m = (_since(sales, "transaction_date", as_of, lookback).filter("sku_id <> ''").groupBy("sku_id")
         .agg(F.max("transaction_date").alias("last_sale_date"),
              F.bround(total("qty_sold") / F.lit(lookback / 7.0), 2).alias("avg_weekly_units")))
    return m if done is None else m.join(done.select("sku_id"), "sku_id", "left_anti")


def _minmax(c: str) -> Column:
    lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
    return F.when(hi == lo, F.lit(0.5)).otherwise((F.col(c) - lo) / F.when(hi != lo, hi - lo))


def location_tiers(sales: DataFrame, orders: DataFrame, as_of: date, lookback: int = 180) -> DataFrame:
    """Terciles of a weighted score of order fill, volume, breadth and returns."""
    q = num("qty_sold")
    recent = _since(sales, "transaction_date", as_of, lookback).filter("location_id <> ''")
    moved = recent.groupBy("location_id").agg(
        F.sum(F.greatest(q, F.lit(0.0))).alias("volume"),
        F.countDistinct(F.coalesce("sku_id", F.lit(""))).cast("double").alias("breadth"),
        (count_if(q < 0) / F.count(F.lit(1))).alias("returns"))
    fills = (orders.withColumn("f", fill_rate(F.col("qty_received"), F.col("qty_ordered")))
             .groupBy("location_id").agg(F.avg("f").alias("fill")))
    raw = settle(moved.join(fills, "location_id", "left").withColumn("fill", F.coalesce("fill", F.lit(0.5))))
    metrics = ("fill", "volume", "breadth", "returns")
    bounds = raw.agg(*[f(m).alias(f"{m}_{s}") for m in metrics for f, s in ((F.min, "lo"), (F.max, "hi"))])
    scored = (raw.crossJoin(F.broadcast(bounds))  # one row of bounds
              .select("location_id", *[_minmax(m).alias(m) for m in metrics])
              .withColumn("score", 0.40 * F.col("fill") + 0.30 * F.col("volume") + 0.20 * F.col("breadth")
                          + 0.10 * (1.0 - F.col("returns"))))
    ranked = global_rank(scored, [F.desc("score"), F.asc("location_id")])
    first = F.ceil(F.col("rank_n") / 3)
    second = first + F.floor(F.col("rank_n") / 3)
    return ranked.select(
        "location_id",
        F.when(F.col("rank_idx") < first, 1).when(F.col("rank_idx") < second, 2).otherwise(3).alias("location_tier"),
        F.bround("fill", 4).alias("fill_rate_score"), F.bround("volume", 4).alias("revenue_score"),
        F.bround("breadth", 4).alias("sku_breadth_score"), F.bround(1.0 - F.col("returns"), 4).alias("return_rate_score"),
        F.bround("score", 4).alias("composite_tier_score"))


def residual_demand(sales: DataFrame, snapshots: DataFrame, as_of: date, lookback: int = 180, baseline_days: int = 90,
                    min_stockouts: int = 2, spike: float = 2.0) -> DataFrame:
    """Sales that spilled over from stocked-out peers: at least ``min_stockouts`` other locations
    out of the SKU that day, the seller in stock, and a quantity at or over ``spike`` baselines."""
    outs = settle(snapshots.filter(F.col("is_stockout") & (F.col("snapshot_date") >= day(as_of, -lookback)))
            .select("sku_id", "location_id", F.col("snapshot_date").alias("transaction_date")).distinct())
    hot = (outs.groupBy("sku_id", "transaction_date").agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") >= min_stockouts))
    base = (sales.filter((F.col("transaction_date") >= day(as_of, -baseline_days)) & (F.col("qty_sold") > 0))
            .groupBy("sku_id", "location_id")
            .agg((total("qty_sold") / F.count(F.lit(1))).alias("baseline")))
    return (sales.filter("qty_sold > 0").join(hot.select("sku_id", "transaction_date"), ["sku_id", "transaction_date"], "left_semi")
            .join(outs, ["sku_id", "location_id", "transaction_date"], "left_anti")
            .join(base, ["sku_id", "location_id"])
            .filter(F.col("qty_sold").cast("double") >= F.col("baseline") * spike)
            .select("transaction_id", "sku_id", "location_id", "transaction_date",
                    F.col("qty_sold").cast("double").alias("qty_sold"), F.bround("baseline", 4).alias("baseline")))


def demand_quality(sales: DataFrame, as_of: date, lookback: int = 730) -> DataFrame:
    g = (_since(sales, "transaction_date", as_of, lookback).filter("sku_id <> '' and location_id <> ''")
         .groupBy("sku_id", "location_id")
         .agg(F.count(F.lit(1)).alias("total_sale_count"),
              count_if(F.col("is_residual_demand")).alias("residual_sale_count")))
    return g.select("sku_id", "location_id",
                    F.bround(1.0 - F.col("residual_sale_count") / F.col("total_sale_count"), 3).alias("demand_quality_score"),
                    (F.col("total_sale_count") - F.col("residual_sale_count")).alias("organic_sale_count"),
                    "residual_sale_count", "total_sale_count")


def catch_all_sku(sku: Column) -> Column:
    return F.upper(sku).rlike("|".join(params.SKU_EXCLUSION_WORDS))


def months_back(as_of: date, d: Column) -> Column:
    return F.lit(as_of.year * 12 + as_of.month) - (F.year(d) * 12 + F.month(d))


def decay_weight(months: Column, decay: float = 0.9, cap: int = 11) -> Column:
    """decay ** clamp(months, 0, cap), as a constant table."""
    table = F.array(*[F.lit(decay ** i) for i in range(cap + 1)])
    return F.element_at(table, (F.least(F.greatest(months, F.lit(0)), F.lit(cap)) + 1).cast("int"))


def recent_gross_profit(detail: DataFrame, as_of: date, months: int = 12) -> DataFrame:
    """Recency-weighted gross profit per (sku, location)."""
    w = decay_weight(months_back(as_of, F.col("tran_date")), cap=months - 1)
    gp, qty = num("gross_profit"), num("qty_ship")
    return (_since(detail, "tran_date", as_of, months * 31)
            .filter(F.col("tran_code").isin(*params.SALE_CODES) & (F.col("prod_line_pn") != ""))
            .filter(~catch_all_sku(F.col("prod_line_pn")))
            .groupBy(F.col("prod_line_pn").alias("sku_id"), F.coalesce("location_id", F.lit("")).alias("location_id"))
            .agg(F.sum(gp * w).alias("gp_weighted"), total("gross_profit").alias("gp_12m"),
                 total("sales").alias("sales_12m"), F.sum(qty * w).alias("qty_weighted")))


def abc_by_gross_profit(profit: DataFrame, master: DataFrame, by_volume: bool = False, a: float = 0.10,
                        b: float = 0.20) -> DataFrame:
    """Rank over the whole master by weighted profit, or by weighted volume where the caller says so."""
    per_sku = profit.groupBy("sku_id").agg(F.sum("gp_weighted").alias("gpw"), F.sum("gp_12m").alias("gp"),
                                           F.sum("qty_weighted").alias("qw"))
    pool = (master.filter(~catch_all_sku(F.col("sku_id"))).select("sku_id", F.col("abc_class").alias("old_class"))
            .join(per_sku, "sku_id", "left")
            .withColumn("metric", F.coalesce("qw" if by_volume else "gpw", F.lit(0.0))))
    ranked = global_rank(pool, [F.desc(F.round("metric", 6)), F.asc("sku_id")])
    return ranked.select("sku_id", share_class(F.col("rank_idx"), F.col("rank_n"), a, b).alias("abc_class"),
                         F.coalesce("old_class", F.lit("C")).alias("old_class"),
                         F.bround(F.coalesce("gp", F.lit(0.0)), 4).alias("gp_12m"))


def abc_by_location(profit: DataFrame, master: DataFrame, a: float = 0.10, b: float = 0.20) -> DataFrame:
    """The same ranking inside each location. The rank is distributed, so one location may hold
    any share of the rows."""
    ranked = global_rank(profit.filter("location_id <> ''"),
                         [F.desc(F.round("gp_weighted", 6)), F.asc("sku_id")], ["location_id"])
    return (ranked.withColumn("abc_class", share_class(F.col("rank_idx"), F.col("rank_n"), a, b))
            .join(master.select("sku_id", "xyz_class"), "sku_id", "left")
            .select("sku_id", "location_id", "abc_class", "xyz_class", F.bround("gp_12m", 4).alias("gp_12m"),
                    F.bround("sales_12m", 4).alias("sales_12m")))


def class_changes(classed: DataFrame) -> DataFrame:
    return classed.groupBy("old_class", "abc_class").agg(F.count(F.lit(1)).alias("skus"))
