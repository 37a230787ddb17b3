"""Customer churn: recency/frequency/monetary scores and spend-decline flags."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import params
from shelfwise.operators.common import count_if, day, most_frequent, total, total_if
from shelfwise.operators.demand import training_sales


def eligible_sales(sales: DataFrame) -> DataFrame:
    """Sales that count for churn; a missing customer status is kept."""
    closed = F.upper(F.trim(F.coalesce("customer_status", F.lit("")))).isin(*params.CHURN_CLOSED_STATUSES)
    return (training_sales(sales).filter(~F.coalesce(F.col("is_core_return"), F.lit(False)))
            .filter(F.col("customer_id").isNotNull() & (F.col("customer_id") != "") & ~closed))


def churn_scores(sales: DataFrame, as_of: date, lookback: int = 90, recent_days: int = 30, full_recency: int = 50,
                 min_orders: int = 3, min_span: int = 30) -> DataFrame:
    """Orders are first reduced to one row per (customer, order), so distinct counts need no
    expansion and a customer with a large share of the rows is pre-aggregated on the map side."""
    order_key = F.coalesce(F.nullif("invoice_number", F.lit("")), "transaction_id")
    recent = F.col("transaction_date") >= day(as_of, -recent_days)
    rows = eligible_sales(sales).filter(F.col("transaction_date").between(day(as_of, -lookback), day(as_of)))
    per_order = rows.groupBy("customer_id", order_key.alias("order_key")).agg(
        F.max(recent.cast("int")).alias("in_recent"), F.max((~recent).cast("int")).alias("in_prior"),
        F.sum(F.when(recent, F.col("total_revenue"))).alias("rev_recent"),
        F.sum(F.when(~recent, F.col("total_revenue"))).alias("rev_prior"),
        F.min("transaction_date").alias("first"), F.max("transaction_date").alias("last"),
        F.min("customer_type").alias("customer_type"), F.min("customer_status").alias("customer_status"))
    g = per_order.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count_90d"), F.sum("in_recent").alias("order_count_30d"),
        F.sum("in_prior").alias("order_count_prior_60d"), total("rev_recent").alias("r30"), total("rev_prior").alias("rp"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("customer_type").alias("customer_type"),
        F.min("customer_status").alias("customer_status"))
    periods = max(1.0, (lookback - recent_days) / recent_days)

    def drop(now: Column, prior: Column) -> Column:
        base = prior / periods
        return F.when(base <= 0, 50.0).otherwise(
            F.least(F.lit(100.0), 100.0 * F.greatest(F.lit(0.0), 1.0 - now / F.when(base > 0, base))))

    x = (g.filter((F.col("order_count_90d") >= min_orders) & (F.datediff("last", "first") >= min_span))
         .withColumn("days", F.datediff(day(as_of), "last"))
         .withColumn("rec", F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * F.col("days") / float(full_recency))))
         .withColumn("freq", drop(F.col("order_count_30d"), F.col("order_count_prior_60d")))
         .withColumn("mon", drop(F.col("r30"), F.col("rp")))
         .withColumn("score", 0.40 * F.col("rec") + 0.30 * F.col("freq") + 0.30 * F.col("mon")))
    score = F.col("score")
    return x.select(
        "customer_id", day(as_of).alias("run_date"), "customer_type", "customer_status", "order_count_90d",
        "order_count_30d", "order_count_prior_60d", F.bround(F.col("r30") + F.col("rp"), 2).alias("revenue_90d"),
        F.bround("r30", 2).alias("revenue_30d"), F.bround("rp", 2).alias("revenue_prior_60d"),
        F.col("days").alias("days_since_last_order"), F.bround("rec", 2).alias("recency_score"),
        F.bround("freq", 2).alias("frequency_score"), F.bround("mon", 2).alias("monetary_score"),
        F.bround(score, 2).alias("churn_score"),
        F.when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW").alias("risk_tier"),
        (score >= 70).alias("at_risk_flag"))


def customer_of(ship_to: Column) -> Column:
    return F.trim(F.split_part(ship_to, F.lit("-"), F.lit(1)))


def churn_buckets(detail: DataFrame, start: date, base_end: date, compare_start: date) -> DataFrame:
    """Baseline and comparison spend of every customer at every location in one pass."""
    d = F.col("tran_date")
    base, cmp = d.between(F.lit(start), F.lit(base_end)), d >= F.lit(compare_start)
    rows = (detail.filter((d >= F.lit(start)) & F.col("ship_to").isNotNull() & F.col("sales").isNotNull())
            .withColumn("customer_id", customer_of(F.col("ship_to"))).filter("customer_id <> ''")
            .withColumn("job", F.trim(F.split_part("ship_to", F.lit("-"), F.lit(2))) != ""))
    return rows.groupBy("customer_id", "location_id").agg(
        F.bool_or("job").alias("is_commercial"), total_if(base, F.col("sales")).alias("baseline_sales"),
        count_if(base).alias("baseline_tx"), F.countDistinct(F.when(base, F.trunc(d, "MM"))).alias("baseline_months"),
        total_if(cmp, F.col("sales")).alias("comparison_sales"), F.max(d).alias("last_purchase_date"))


def modal_salesman(sales: DataFrame, start: date) -> DataFrame:
    """Salesman with most sales per (customer, location); ties go to the smallest id."""
    rows = (sales.filter((F.col("transaction_date") >= F.lit(start)) & (F.trim("salesman_id") != ""))
            .withColumn("customer_id", F.trim("customer_id")).filter("customer_id <> ''"))
    return most_frequent(rows, ["customer_id", "location_id"], "salesman_id", "salesman_id")


def churn_windows(as_of: date, lookback: int = 730, base_months: int = 18, compare_days: int = 90) -> tuple[date, date, date]:
    """(start, end of baseline, start of comparison)."""
    start = as_of - timedelta(days=lookback)
    return start, start + timedelta(days=30 * base_months), as_of - timedelta(days=compare_days)


def churn_flags(buckets: DataFrame, salesmen: DataFrame, as_of: date, base_months: int = 18, min_tx: int = 3,
                min_monthly: float = 333.0, min_months: int = 3, compare_days: int = 90, decline: float = 0.30) -> DataFrame:
    x = (buckets.withColumn("monthly", F.col("baseline_sales") / float(base_months))
         .filter((F.col("baseline_tx") >= min_tx) & (F.col("monthly") >= min_monthly) & (F.col("baseline_months") >= min_months))
         .withColumn("days", F.datediff(day(as_of), "last_purchase_date"))
         .join(salesmen, ["customer_id", "location_id"], "left"))
    expected = F.col("monthly") * (compare_days / 30.0)
    pct = (F.col("comparison_sales") - expected) / expected * 100.0
    gone = F.col("comparison_sales") == 0
    segment = F.when(gone, F.when(F.col("days").isNull() | (F.col("days") > 365), "LOST").when(F.col("days") > 180, "CHURNED")
                     .otherwise("AT_RISK"))
    return x.withColumn("risk_segment", segment).select(
        "customer_id", "location_id", "is_commercial", "salesman_id", F.bround("monthly", 4).alias("baseline_monthly_spend"),
        F.bround("comparison_sales", 4).alias("last_90_days_spend"),
        F.when(gone, -100.0).otherwise(F.bround(pct, 2)).alias("pct_change"),
        F.when(gone, F.col("risk_segment")).when(pct <= -decline * 100, "DECLINING").otherwise("STABLE").alias("flag"),
        "risk_segment", F.col("days").alias("days_since_last_purchase"), "last_purchase_date")
