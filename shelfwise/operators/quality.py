"""Data-quality checks. Each returns issue rows of one shape, so checks can be unioned."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise import params
from shelfwise.operators.common import day

ISSUE_COLUMNS = ("source_table", "source_id", "issue_type", "issue_detail", "field_name", "field_value", "severity")


def issues(df: DataFrame, table: str, source_id: str, kind: str, detail: Column | str, field: str,
           severity: str = "error", value: Column | None = None) -> DataFrame:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    value = F.col(field) if value is None else value
    return df.select(F.lit(table).alias("source_table"), F.col(source_id).alias("source_id"),
                     F.lit(kind).alias("issue_type"), detail.alias("issue_detail"), F.lit(field).alias("field_name"),
                     value.cast("string").alias("field_value"), F.lit(severity).alias("severity"))


def negative_quantity(sales: DataFrame) -> DataFrame:
    return issues(sales.filter("qty_sold < 0"), "sales_transactions", "transaction_id", "negative_qty_sold",
                  "quantity below zero: code it as a return", "qty_sold")


def future_dated(sales: DataFrame, as_of: date) -> DataFrame:
    ahead = F.datediff("transaction_date", day(as_of)).cast("string")
    return issues(sales.filter(F.col("transaction_date") > day(as_of)), "sales_transactions", "transaction_id",
                  "future_transaction_date", F.concat(ahead, F.lit(" days after the as-of date")), "transaction_date")


def duplicate_ids(sales: DataFrame) -> DataFrame:
    counted = (sales.groupBy(F.coalesce("transaction_id", F.lit("")).alias("transaction_id"))
               .agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return issues(counted, "sales_transactions", "transaction_id", "duplicate_transaction_id",
                  F.concat(F.lit("occurs "), F.col("n").cast("string"), F.lit(" times")), "transaction_id")


def orphaned_skus(sales: DataFrame, master: DataFrame) -> DataFrame:
    orphans = sales.filter("sku_id <> ''").join(master.select("sku_id"), "sku_id", "left_anti")
    return issues(orphans, "sales_transactions", "transaction_id", "orphaned_sku_id", "not in the SKU master", "sku_id")


def zero_price(sales: DataFrame) -> DataFrame:
    free = sales.filter("qty_sold > 0 and (unit_price is null or unit_price = 0)")
    return issues(free, "sales_transactions", "transaction_id", "zero_price_nonzero_qty",
                  "sold without a price", "unit_price", "warning")


def invalid_locations(sales: DataFrame, valid: DataFrame) -> DataFrame:
    unknown = sales.filter("location_id <> ''").join(valid.select("location_id"), "location_id", "left_anti")
    return issues(unknown, "sales_transactions", "transaction_id", "invalid_location_id",
                  "not a known location", "location_id")


def quantity_outliers(sales: DataFrame, sigma: float = 4.0, min_rows: int = 3) -> DataFrame:
    """Beyond ``sigma`` sample deviations of the SKU's mean. Statistics are aggregated per SKU and
    joined back, so a SKU with a large share of the rows is never sorted into one task."""
    rows = sales.filter("sku_id <> '' and qty_sold is not null").select(
        "transaction_id", "sku_id", F.col("qty_sold").cast("double").alias("qty_sold"))
    q = F.col("qty_sold")
    stats = (rows.groupBy("sku_id")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(q).alias("s"), F.sum(q * q).alias("ss"))
             .filter(F.col("n") >= max(min_rows, 2))
             .select("sku_id", (F.col("s") / F.col("n")).alias("mean"),
                     F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
                                       / (F.col("n") - 1))).alias("sd"))
             .filter("sd > 0"))
    far = rows.join(stats, "sku_id").filter(F.abs(q - F.col("mean")) > F.lit(sigma) * F.col("sd"))
    return issues(far, "sales_transactions", "transaction_id", "qty_sold_outlier",
                  f"more than {sigma:g} deviations from the SKU mean", "qty_sold", "warning")


def suspicious_names(master: DataFrame) -> DataFrame:
    """Descriptions that name a service or an event rather than a part."""
    desc = F.trim(F.coalesce("description", F.lit("")))
    token = F.upper(desc)
    listed = token.isin(*params.SUSPICIOUS_NAMES)
    lone = token.rlike(params.LONE_CAPS_WORD) & ~desc.contains(" ")
    found = master.withColumn("description", desc).filter((desc != "") & (listed | lone))
    token = F.upper(F.col("description"))
    reason = F.when(token.isin(*params.SUSPICIOUS_NAMES), "listed word").otherwise("single word")
    return issues(found, "sku_master", "sku_id", "suspicious_sku_name", reason, "description", "warning",
                  F.col("description"))


def negative_inventory(snapshots: DataFrame) -> DataFrame:
    bad = snapshots.filter("qty_on_hand < 0").withColumn(
        "id", F.concat_ws("|", "sku_id", "location_id", F.col("snapshot_date").cast("string")))
    return issues(bad, "inventory_snapshots", "id", "negative_inventory", "on-hand below zero", "qty_on_hand", "warning")


def anomaly_issues(flagged_days: DataFrame, sales: DataFrame) -> DataFrame:
    """One issue per sale on a flagged (sku, day)."""
    hit = sales.join(flagged_days.select("sku_id", F.col("day").alias("transaction_date")),
                     ["sku_id", "transaction_date"], "left_semi")
    return issues(hit, "sales_transactions", "transaction_id", "isolation_forest_anomaly",
                  "sold on a day with an unusual pattern", "qty_sold", "warning")


def run_checks(checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All checks of a registry in one frame."""
    frames = [check() for check in checks.values()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("issues"))


def violations(df: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """Rows breaking a rule, one row per (row, rule). A rule that evaluates to null passes, as a
    CHECK constraint does."""
    tests = F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()])
    return (df.select(*key, F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("rule")))
