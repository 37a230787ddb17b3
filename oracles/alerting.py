"""SQL twins of the accuracy, anomaly and alert queries."""

from oracles import VIEWS

D = "DATE '2001-08-01'"

VIEWS["past_forecasts"] = """
SELECT * REPLACE (forecast_date - 28 AS forecast_date, run_date - 28 AS run_date) FROM forecasts
"""
VIEWS["actual_sales"] = """
SELECT sku_id, location_id, transaction_date AS d, sum(qty_sold) AS q FROM sales GROUP BY 1, 2, 3
UNION ALL SELECT sku_id, 'ALL', transaction_date, sum(qty_sold) FROM sales GROUP BY 1, 3
"""
VIEWS["evaluated_forecasts"] = f"""
SELECT f.sku_id, f.location_id, f.forecast_date, f.model_type, f.predicted_qty AS predicted, coalesce(a.q, 0)::DOUBLE AS actual,
  CASE WHEN coalesce(a.q, 0) > 0 THEN abs(a.q - predicted_qty) / a.q * 100
    WHEN predicted_qty = 0 AND coalesce(a.q, 0) = 0 THEN 0 ELSE 100 END::DOUBLE AS mape
FROM (SELECT *, row_number() OVER (PARTITION BY sku_id, location_id, forecast_date, model_type ORDER BY run_date DESC) AS r
  FROM past_forecasts WHERE forecast_date BETWEEN {D} - 28 AND {D} - 1) f
LEFT JOIN actual_sales a ON a.sku_id = f.sku_id AND a.location_id = f.location_id AND a.d = f.forecast_date
WHERE r = 1
"""
VIEWS["forecast_backfill"] = """
SELECT sku_id, location_id, forecast_date, model_type, round_even(predicted, 4)::DOUBLE AS predicted_qty,
  round_even(actual, 4)::DOUBLE AS actual_qty_sold, round_even(mape, 4)::DOUBLE AS mape_error FROM evaluated_forecasts
"""
VIEWS["accuracy_report"] = f"""
SELECT {D} AS report_date, model_type, abc_class, round_even(avg(mape), 2)::DOUBLE AS avg_mape,
  round_even(avg(abs(actual - predicted)), 4)::DOUBLE AS avg_mae, round_even(avg(predicted - actual), 4)::DOUBLE AS bias,
  round_even(coalesce(count(*) FILTER (WHERE actual > 0 AND abs(actual - predicted) / actual <= 0.2)
    / nullif(count(*) FILTER (WHERE actual > 0), 0) * 100, 0), 2)::DOUBLE AS hit_rate_20pct,
  count(*) AS total_forecasts_evaluated, count(DISTINCT e.sku_id) AS sku_count
FROM evaluated_forecasts e JOIN sku_master m ON m.sku_id = e.sku_id GROUP BY ALL
"""
VIEWS["sku_accuracy"] = """
SELECT sku_id, round_even(avg(mape), 2)::DOUBLE AS accuracy_score, avg(mape) > 40 AS needs_review
FROM evaluated_forecasts GROUP BY 1
"""
VIEWS["weekly_error"] = f"""
SELECT abc_class, model_type, avg(abs(coalesce(q, 0) - predicted_qty) / greatest(coalesce(q, 0), 1)) * 100 AS mape,
  count(*) AS observations
FROM (SELECT *, max(run_date) OVER (PARTITION BY sku_id, location_id, model_type) AS newest FROM past_forecasts
  WHERE forecast_date BETWEEN {D} - 7 AND {D} - 1 AND run_date >= {D} - 40 AND model_type IN ('lightgbm', 'rolling_avg')) f
LEFT JOIN actual_sales a ON a.sku_id = f.sku_id AND a.location_id = f.location_id AND a.d = f.forecast_date
JOIN sku_master m ON m.sku_id = f.sku_id WHERE run_date = newest GROUP BY 1, 2
"""
VIEWS["daily_profile"] = f"""
SELECT sku_id, transaction_date AS day, sum(qty_sold)::DOUBLE AS daily_qty,
  round_even(coalesce(sum(unit_price), 0)::DOUBLE / count(*), 6)::DOUBLE AS avg_price, count(*) AS sales
FROM sales WHERE transaction_date BETWEEN {D} - 365 AND {D} GROUP BY 1, 2
"""
VIEWS["margin_drops"] = f"""
SELECT sku_id, location_id, n7 AS recent_sales, round_even(b, 4)::DOUBLE AS baseline_gp_pct,
  round_even(c, 4)::DOUBLE AS current_gp_pct, round_even(b - c, 4)::DOUBLE AS gp_drop,
  'gp_anomaly|' || sku_id || '|' || location_id AS alert_key
FROM (SELECT prod_line_pn AS sku_id, location_id, count(*) FILTER (WHERE tran_date >= {D} - 7) AS n7,
    sum(gross_profit)::DOUBLE / sum(sales)::DOUBLE AS b,
    (sum(gross_profit) FILTER (WHERE tran_date >= {D} - 7))::DOUBLE / (sum(sales) FILTER (WHERE tran_date >= {D} - 7))::DOUBLE AS c
  FROM sales_detail WHERE tran_date BETWEEN {D} - 90 AND {D} AND tran_code = 'SL' AND sales > 0 GROUP BY 1, 2)
WHERE n7 >= 1 AND b - c >= 0.15
"""
VIEWS["stale_models"] = """
SELECT s.sku_id, s.location_id, last_sale FROM (
  SELECT sku_id, location_id, max(transaction_date) AS last_sale FROM sales GROUP BY 1, 2) s
LEFT JOIN (SELECT sku_id, location_id, max(run_date) AS trained FROM past_forecasts WHERE model_type = 'prophet'
  GROUP BY 1, 2) t ON t.sku_id = s.sku_id AND t.location_id = s.location_id
WHERE trained IS NULL OR last_sale > trained
"""

_NULL = "CAST(NULL AS VARCHAR)"


def _alert(source: str, kind: str, severity: str, key: str, message: str, impact: str = "0", sku: str = _NULL,
           loc: str = _NULL, supplier: str = _NULL, customer: str = _NULL, at: str = D) -> str:
    return f"""SELECT {at} AS alert_date, '{kind}' AS alert_type, '{severity}' AS severity, {sku} AS sku_id, {loc} AS location_id,
  {supplier} AS supplier_id, {customer} AS customer_id, {message} AS message, '{kind}|' || {key} AS alert_key,
  round_even(coalesce({impact}, 0), 2)::DOUBLE AS financial_impact FROM {source}"""


VIEWS["alerts_critical_stockout"] = _alert(
    f"""inventory i LEFT JOIN sku_master m ON m.sku_id = i.sku_id LEFT JOIN (SELECT sku_id, location_id, qty_to_order
    FROM recommendations WHERE recommendation_date = {D}) r ON r.sku_id = i.sku_id AND r.location_id = i.location_id
    WHERE i.snapshot_date = {D} AND i.is_stockout""", "CRITICAL_STOCKOUT", "critical", "i.sku_id || '|' || i.location_id",
    "i.sku_id || ' is out of stock at ' || i.location_id", "coalesce(r.qty_to_order, 0) * coalesce(m.unit_cost, 0)::DOUBLE",
    sku="i.sku_id", loc="i.location_id")


def _low_supply(at: str) -> str:
    return _alert(
        f"""(SELECT r.*, m.unit_cost FROM recommendations r LEFT JOIN sku_master m ON m.sku_id = r.sku_id
        WHERE recommendation_date = {at} AND days_of_supply_remaining > 0 AND days_of_supply_remaining < 3)""",
        "LOW_SUPPLY", "critical", "sku_id || '|' || location_id",
        "sku_id || ' at ' || location_id || ' has ' || round_even(days_of_supply_remaining, 1)::DOUBLE || ' days of supply left'",
        "qty_to_order * coalesce(unit_cost, 0)::DOUBLE", sku="sku_id", loc="location_id", at=at)


VIEWS["alerts_low_supply"] = _low_supply(D)
VIEWS["alerts_freeze"] = _alert(
    f"""sku_master CROSS JOIN (SELECT count(*) AS n, min(temp_min_f) AS t FROM weather
    WHERE log_date BETWEEN {D} AND {D} + 7 AND temp_min_f < 20 HAVING count(*) > 0) w
    WHERE is_active AND lower(part_category) IN ('large', 'promo')""", "FREEZE_ALERT", "warning", "sku_id",
    "'Freeze ahead: ' || n || ' cold days, coldest ' || t || 'F; review ' || sku_id", sku="sku_id")
VIEWS["alerts_supplier_risk"] = _alert(
    """purchase_orders p JOIN supplier_scores s ON s.supplier_id = p.supplier_id AND s.risk_flag = 'red'
    LEFT JOIN sku_master m ON m.sku_id = p.sku_id WHERE p.status IN ('open', 'partial')""", "SUPPLIER_RISK", "warning",
    "p.supplier_id || '|' || p.sku_id || '|' || p.po_number",
    "'Open order ' || p.po_number || ' for ' || p.sku_id || ' is with red supplier ' || p.supplier_id",
    "p.qty_ordered * coalesce(m.unit_cost, 0)::DOUBLE", sku="p.sku_id", supplier="p.supplier_id")
VIEWS["alerts_dead_stock"] = _alert(
    """(SELECT sku_id, sum(total_inv_value) AS value, max(days_since_sale) AS idle FROM dead_stock
    WHERE NOT (sale_frequency > 6) GROUP BY 1 HAVING sum(total_inv_value) >= 500)""", "DEAD_STOCK", "info", "sku_id",
    "sku_id || ' is dead stock, ' || idle || ' days idle'", "value", sku="sku_id")
VIEWS["alerts_dead_stock_by_flag"] = _alert(
    f"sku_master WHERE is_dead_stock AND (last_sale_date IS NULL OR last_sale_date < {D} - 180)", "DEAD_STOCK", "info",
    "sku_id", "sku_id || ' is flagged dead stock'", sku="sku_id")
VIEWS["alerts_dead_stock_chained"] = """
SELECT *, TRUE AS scored FROM alerts_dead_stock UNION ALL SELECT *, FALSE AS scored FROM alerts_dead_stock_by_flag
"""
VIEWS["alerts_transfer_opportunity"] = _alert(
    f"""(SELECT count(*) AS n, count(DISTINCT sku_id) AS k, count(DISTINCT location_id) AS l, sum(qty_to_order)::BIGINT AS q
    FROM recommendations WHERE recommendation_date = {D} AND recommendation_type = 'transfer' AND NOT is_approved
    HAVING count(*) > 0)""", "TRANSFER_OPPORTUNITY", "info", "'SUMMARY'",
    "n || ' transfers of ' || k || ' SKUs to ' || l || ' locations, ' || q || ' units, await approval'")
VIEWS["alerts_accuracy_drop"] = _alert(
    "weekly_error WHERE mape > 25", "FORECAST_ACCURACY_DROP", "warning", "abc_class || '|' || model_type",
    "abc_class || '-class ' || model_type || ' weekly error is ' || round_even(mape, 0)::BIGINT || '% over ' || observations"
    " || ' forecasts'")
VIEWS["alerts_churn_risk"] = _alert(
    "churn_flags WHERE flag IN ('AT_RISK', 'CHURNED', 'LOST')", "CHURN_RISK", "warning", "customer_id || '|' || location_id",
    "'Customer ' || customer_id || ' at ' || location_id || ' is ' || flag || ', last purchase ' || last_purchase_date",
    "baseline_monthly_spend * 3", loc="location_id", customer="customer_id")
VIEWS["alerts_outside_gap"] = _alert(
    "outside_flags_low WHERE flag = 'HIGH' AND NOT in_reorder_queue", "OPSL_GAP", "info", "prod_line_pn || '|' || location_id",
    "prod_line_pn || ' at ' || location_id || ' was bought outside ' || opsl_count || ' times'", "estimated_margin_recovery",
    sku="prod_line_pn", loc="location_id")
VIEWS["alerts_today"] = "\nUNION ALL\n".join(f"SELECT * FROM {n}" for n in (
    "alerts_critical_stockout", "alerts_low_supply", "alerts_freeze", "alerts_supplier_risk", "alerts_dead_stock",
    "alerts_transfer_opportunity", "alerts_accuracy_drop", "alerts_churn_risk", "alerts_outside_gap"))
VIEWS["alert_list"] = """
SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END::INTEGER AS severity_rank FROM alerts_today
"""
VIEWS["low_supply_1"] = _low_supply(f"{D} - 2")
VIEWS["low_supply_2"] = _low_supply(f"{D} - 1")
VIEWS["low_supply_3"] = _low_supply(D)
# Each key has at most three runs: a run that follows the key's previous run extends the row, else a new row starts.
VIEWS["low_supply_runs"] = """
SELECT *, sum(CASE WHEN alert_date = prev + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY alert_key ORDER BY alert_date) AS island
FROM (SELECT *, lag(alert_date) OVER (PARTITION BY alert_key ORDER BY alert_date) AS prev FROM (
  SELECT * FROM low_supply_1 UNION ALL SELECT * FROM low_supply_2 UNION ALL SELECT * FROM low_supply_3))
"""
VIEWS["alert_lifecycle"] = f"""
SELECT max(alert_date) AS alert_date, arg_max(alert_type, alert_date) AS alert_type, arg_max(severity, alert_date) AS severity,
  arg_max(sku_id, alert_date) AS sku_id, arg_max(location_id, alert_date) AS location_id, {_NULL} AS supplier_id,
  {_NULL} AS customer_id, arg_max(message, alert_date) AS message, alert_key,
  arg_max(financial_impact, alert_date) AS financial_impact, min(alert_date) AS first_seen_date,
  count(*)::INTEGER AS days_active, max(alert_date) < {D} AS resolved,
  CASE WHEN max(alert_date) < {D} THEN max(alert_date) + 1 END AS resolved_date,
  bool_or(location_id = 'LOC-003' AND alert_date = {D} - 1) AS is_acknowledged,
  CASE WHEN bool_or(location_id = 'LOC-003' AND alert_date = {D} - 1) THEN 'buyer' END AS acknowledged_by,
  CASE WHEN bool_or(location_id = 'LOC-003' AND alert_date = {D} - 1) THEN {D} - 1 END AS acknowledged_at
FROM low_supply_runs GROUP BY alert_key, island
"""
VIEWS["streamed_alerts"] = "SELECT * FROM alert_lifecycle"
VIEWS["report_waiting_alerts"] = f"""
SELECT severity, count(*) AS alerts, round_even(sum(financial_impact), 2)::DOUBLE AS financial_impact FROM alert_lifecycle
WHERE alert_date = {D} AND NOT resolved AND NOT is_acknowledged GROUP BY 1
"""
