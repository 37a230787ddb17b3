"""SQL twins of the data-quality queries."""

from oracles import VIEWS


def _issue(source: str, table: str, sid: str, kind: str, detail: str, field: str, sev: str = "error", value: str = "") -> str:
    return f"""SELECT '{table}' AS source_table, {sid} AS source_id, '{kind}' AS issue_type, {detail} AS issue_detail,
  '{field}' AS field_name, CAST({value or field} AS VARCHAR) AS field_value, '{sev}' AS severity FROM {source}"""


VIEWS["check_negative_quantity"] = _issue(
    "sales WHERE qty_sold < 0", "sales_transactions", "transaction_id", "negative_qty_sold",
    "'quantity below zero: code it as a return'", "qty_sold")
VIEWS["check_future_dated"] = _issue(
    "sales WHERE transaction_date > DATE '2001-07-01'", "sales_transactions", "transaction_id", "future_transaction_date",
    "(transaction_date - DATE '2001-07-01') || ' days after the as-of date'", "transaction_date")
VIEWS["check_duplicate_ids"] = _issue(
    "(SELECT transaction_id, count(*) AS n FROM sales GROUP BY 1 HAVING count(*) > 1)", "sales_transactions",
    "transaction_id", "duplicate_transaction_id", "'occurs ' || n || ' times'", "transaction_id")
VIEWS["check_orphaned_skus"] = _issue(
    "sales WHERE sku_id NOT IN (SELECT sku_id FROM sku_master WHERE is_active)", "sales_transactions",
    "transaction_id", "orphaned_sku_id", "'not in the SKU master'", "sku_id")
VIEWS["check_zero_price"] = _issue(
    "sales WHERE qty_sold > 0 AND (unit_price IS NULL OR unit_price = 0)", "sales_transactions", "transaction_id",
    "zero_price_nonzero_qty", "'sold without a price'", "unit_price", "warning")
VIEWS["check_invalid_locations"] = _issue(
    "sales WHERE location_id NOT IN (SELECT location_id FROM locations WHERE is_active)", "sales_transactions",
    "transaction_id", "invalid_location_id", "'not a known location'", "location_id")
VIEWS["check_quantity_outliers"] = _issue(
    """sales JOIN (SELECT sku_id AS k, avg(qty_sold) AS m, stddev_samp(qty_sold) AS sd FROM sales GROUP BY 1
    HAVING count(*) >= 3 AND stddev_samp(qty_sold) > 0) st ON st.k = sku_id
    WHERE abs(qty_sold - m) > 2.0 * sd""", "sales_transactions", "transaction_id", "qty_sold_outlier",
    "'more than 2 deviations from the SKU mean'", "qty_sold", "warning")
_WORDS = ("'DELIVERY','BIRTHDAY','AUTORAMA','ZAMBONI','MISC','MISCELLANEOUS','TEST','DUMMY','PLACEHOLDER','SAMPLE',"
          "'DONATION','GIFT','RAFFLE','PROMOTION'")
VIEWS["check_suspicious_names"] = _issue(
    f"sku_master WHERE upper(description) IN ({_WORDS}) OR regexp_matches(upper(description), '^[A-Z]{{5,20}}$')",
    "sku_master", "sku_id", "suspicious_sku_name",
    f"CASE WHEN upper(description) IN ({_WORDS}) THEN 'listed word' ELSE 'single word' END", "description", "warning")
VIEWS["check_negative_inventory"] = _issue(
    "inventory WHERE snapshot_date = DATE '2001-08-01' AND qty_on_hand < 0", "inventory_snapshots",
    "sku_id || '|' || location_id || '|' || snapshot_date", "negative_inventory", "'on-hand below zero'",
    "qty_on_hand", "warning")
VIEWS["data_quality_issues"] = "\nUNION ALL\n".join(f"SELECT * FROM {n}" for n in (
    "check_negative_quantity", "check_future_dated", "check_duplicate_ids", "check_orphaned_skus", "check_zero_price",
    "check_invalid_locations", "check_quantity_outliers", "check_suspicious_names", "check_negative_inventory"))
VIEWS["data_quality_summary"] = "SELECT issue_type, severity, count(*) AS issues FROM data_quality_issues GROUP BY ALL"
VIEWS["constraint_violations"] = """
SELECT 'received_within_ordered' AS rule, count(*) AS violations FROM purchase_orders WHERE qty_received > qty_ordered
HAVING count(*) > 0
UNION ALL SELECT 'status_known', count(*) FROM purchase_orders WHERE status NOT IN ('open', 'received', 'partial')
HAVING count(*) > 0
UNION ALL SELECT 'qty_received_not_negative', count(*) FROM purchase_orders WHERE qty_received < 0 HAVING count(*) > 0
UNION ALL SELECT 'delivery_after_order', count(*) FROM purchase_orders WHERE actual_delivery_date < po_date
HAVING count(*) > 0
"""
