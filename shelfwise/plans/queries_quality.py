"""Registered queries: data-quality checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from shelfwise.operators import quality
from shelfwise.operators.common import latest_row
from shelfwise.plans.catalog import query

# The synthetic quantities are uniform, so nothing lies beyond the default four deviations.
SIGMA = 2.0
CHECK_DATE = date(2001, 7, 1)


@query
def check_negative_quantity(c):
    return quality.negative_quantity(c["sales"])


@query
def check_future_dated(c):
    return quality.future_dated(c["sales"], CHECK_DATE)


@query
def check_duplicate_ids(c):
    return quality.duplicate_ids(c["sales"])


@query
def check_orphaned_skus(c):
    return quality.orphaned_skus(c["sales"], c["sku_master"].filter("is_active"))


@query
def check_zero_price(c):
    return quality.zero_price(c["sales"])


@query
def check_invalid_locations(c):
    return quality.invalid_locations(c["sales"], c["locations"].filter("is_active"))


@query
def check_quantity_outliers(c):
    return quality.quantity_outliers(c["sales"], SIGMA)


@query
def check_suspicious_names(c):
    return quality.suspicious_names(c["sku_master"])


@query
def check_negative_inventory(c):
    return quality.negative_inventory(latest_row(c["inventory"], ["sku_id", "location_id"], ["snapshot_date"]))


@query
def data_quality_issues(c):
    names = ("check_negative_quantity", "check_future_dated", "check_duplicate_ids", "check_orphaned_skus",
             "check_zero_price", "check_invalid_locations", "check_quantity_outliers", "check_suspicious_names",
             "check_negative_inventory")
    return quality.run_checks({n: (lambda n=n: c[n]) for n in names})


@query
def data_quality_summary(c):
    return quality.issue_counts(c["data_quality_issues"])


@query
def constraint_violations(c):
    rules = {
        "qty_received_not_negative": F.col("qty_received") >= 0,
        "received_within_ordered": F.col("qty_received") <= F.col("qty_ordered"),
        "status_known": F.col("status").isin("open", "received", "partial"),
        "delivery_after_order": F.col("actual_delivery_date") >= F.col("po_date"),
    }
    return (quality.violations(c["purchase_orders"], rules, ["po_number", "line_number", "sku_id"])
            .groupBy("rule").agg(F.count(F.lit(1)).alias("violations")))
