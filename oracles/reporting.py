"""SQL twins of the report queries."""

from oracles import VIEWS

D = "DATE '2001-08-01'"
_NAMED = "LEFT JOIN (SELECT location_id AS lid, location_name AS lname FROM locations) nm ON nm.lid = x.location_id"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"

VIEWS["report_alert_counts"] = """
SELECT severity, count(*) AS alerts, round_even(sum(financial_impact), 2)::DOUBLE AS financial_impact FROM alerts_today GROUP BY 1
"""
VIEWS["report_alert_items"] = f"""
SELECT x.*, coalesce(lname, location_id) AS location_display FROM (SELECT alert_type, severity, sku_id, location_id, alert_key,
  financial_impact, {_RANK}::INTEGER AS severity_rank FROM alerts_today) x {_NAMED}
"""
VIEWS["latest_recs"] = "SELECT * FROM recommendations WHERE recommendation_date = (SELECT max(recommendation_date) FROM recommendations)"
VIEWS["report_reorder_kpis"] = """
SELECT max(recommendation_date) AS recommendation_date, count(*) AS total_recommendations, count(*) FILTER (WHERE is_approved) AS approved,
  count(*) FILTER (WHERE NOT is_approved) AS pending, round_even(sum(qty_to_order), 1)::DOUBLE AS total_qty_recommended,
  count(*) FILTER (WHERE urgency = 'critical') AS critical_count, count(*) FILTER (WHERE urgency = 'warning') AS warning_count,
  count(*) FILTER (WHERE urgency = 'normal') AS normal_count, count(*) FILTER (WHERE recommendation_type = 'po') AS po_count,
  count(*) FILTER (WHERE recommendation_type = 'transfer') AS transfer_count FROM latest_recs
"""
VIEWS["report_top_suppliers"] = """
SELECT supplier_id, count(*) AS rows FROM latest_recs WHERE recommendation_type = 'po' AND supplier_id <> '' GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 5
"""
VIEWS["report_top_destinations"] = "SELECT location_id, count(*) AS rows FROM latest_recs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"
VIEWS["report_pending_recommendations"] = f"""
SELECT x.*, coalesce(lname, location_id) AS location_display FROM (
  SELECT sku_id, location_id, recommendation_type, urgency, qty_to_order, supplier_id, days_of_supply_remaining, transfer_from_location
  FROM latest_recs WHERE NOT is_approved ORDER BY CASE urgency WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END,
  qty_to_order DESC, sku_id, location_id LIMIT 20) x {_NAMED}
"""
VIEWS["report_dead_stock_top"] = """
SELECT sku_id, location_id, action, action_type, data_conflict, total_inv_value, qty_on_hand, days_since_sale, sale_frequency,
  abc_class, supplier_id FROM dead_stock WHERE classification = 'LIQUIDATE' ORDER BY total_inv_value DESC, sku_id, location_id LIMIT 10
"""
VIEWS["report_dead_stock_listed"] = """
SELECT CAST(row_number() OVER (ORDER BY total_inv_value DESC, sku_id, location_id) - 1 AS INTEGER) AS place, sku_id, location_id, action,
  CAST(total_inv_value AS DOUBLE) AS total_inv_value
FROM dead_stock WHERE classification = 'LIQUIDATE' QUALIFY place < 20
"""
VIEWS["report_action_breakdown"] = """
SELECT action, count(*) AS positions, round_even(sum(total_inv_value), 2)::DOUBLE AS value FROM dead_stock
WHERE classification = 'LIQUIDATE' GROUP BY 1
"""
VIEWS["report_supplier_health"] = """
SELECT risk_flag, count(*) AS suppliers, round_even(avg(composite_score), 2)::DOUBLE AS avg_score FROM supplier_scores GROUP BY 1
"""
VIEWS["report_red_suppliers"] = """
SELECT supplier_id, composite_score, fill_rate_pct, on_time_delivery_pct FROM supplier_scores WHERE risk_flag = 'red'
"""
VIEWS["report_inventory_health"] = f"""
SELECT x.*, coalesce(lname, location_id) AS location_display FROM (
  SELECT location_id, max(snapshot_date) AS snapshot_date, count(*) AS snapshots, count(*) FILTER (WHERE is_stockout) AS stockouts,
    count(*) FILTER (WHERE qty_on_hand < reorder_point) AS below_reorder, sum(qty_on_hand) AS on_hand, sum(qty_on_order) AS on_order,
    round_even(100.0 * count(*) FILTER (WHERE is_stockout) / count(*), 1)::DOUBLE AS stockout_pct
  FROM inventory WHERE snapshot_date = {D} GROUP BY 1) x {_NAMED}
"""
_TRANSFERS = """(SELECT * FROM recommendations WHERE recommendation_type = 'transfer' AND recommendation_date =
  (SELECT max(recommendation_date) FROM recommendations WHERE recommendation_type = 'transfer'))"""
VIEWS["report_transfer_routes"] = f"""
SELECT transfer_from_location AS from_location, location_id AS to_location, round_even(sum(qty_to_order), 1)::DOUBLE AS qty,
  count(*) AS transfer_count, count(*) FILTER (WHERE urgency = 'critical') AS critical_count FROM {_TRANSFERS} GROUP BY 1, 2
ORDER BY 3 DESC, 1, 2 LIMIT 8
"""
VIEWS["report_transfer_skus"] = f"""
SELECT sku_id, round_even(sum(qty_to_order), 1)::DOUBLE AS qty FROM {_TRANSFERS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5
"""
VIEWS["report_gross_profit_by_location"] = f"""
SELECT location_id, coalesce(sum(sales) FILTER (WHERE tran_date >= {D} - 90), 0)::DOUBLE AS sales_90d,
  coalesce(sum(gross_profit) FILTER (WHERE tran_date >= {D} - 90), 0)::DOUBLE AS gp_90d,
  coalesce(sum(sales) FILTER (WHERE tran_date BETWEEN {D} - 180 AND {D} - 91), 0)::DOUBLE AS prior_sales_90d
FROM sales_detail WHERE tran_date >= {D} - 180 GROUP BY 1
"""
VIEWS["report_location_performance"] = """
SELECT l.location_id, coalesce(l.location_name, l.location_id) AS location_name, coalesce(t.location_tier, 2)::INTEGER AS location_tier,
  coalesce(t.composite_tier_score, 0)::DOUBLE AS composite_tier_score, round_even(sales_90d, 2)::DOUBLE AS sales_90d,
  round_even(gp_90d, 2)::DOUBLE AS gp_90d, round_even(gp_90d / nullif(sales_90d, 0) * 100, 1)::DOUBLE AS gp_pct,
  round_even((sales_90d - prior_sales_90d) / nullif(prior_sales_90d, 0) * 100, 1)::DOUBLE AS sales_trend_pct,
  coalesce(c.n, 0) AS churn_count, coalesce(a.n, 0) AS a_class_count
FROM locations l LEFT JOIN location_tiers t ON t.location_id = l.location_id
LEFT JOIN report_gross_profit_by_location g ON g.location_id = l.location_id
LEFT JOIN (SELECT location_id, count(*) AS n FROM churn_flags WHERE flag IN ('CHURNED', 'DECLINING') GROUP BY 1) c
  ON c.location_id = l.location_id
LEFT JOIN (SELECT location_id, count(*) AS n FROM abc_by_location WHERE abc_class = 'A' GROUP BY 1) a ON a.location_id = l.location_id
WHERE l.is_active
"""
VIEWS["report_network_kpis"] = """
SELECT * FROM (SELECT count(*) AS total_skus, count(*) FILTER (WHERE abc_class = 'A') AS class_a,
  count(*) FILTER (WHERE abc_class = 'B') AS class_b, count(*) FILTER (WHERE abc_class = 'C') AS class_c FROM sku_master)
CROSS JOIN (SELECT count(*) AS anomaly_count FROM margin_drops)
CROSS JOIN (SELECT count(*) FILTER (WHERE is_active) AS location_count FROM locations)
CROSS JOIN (SELECT count(DISTINCT supplier_id) AS supplier_count FROM supplier_scores)
"""
VIEWS["report_top_skus"] = f"""
SELECT sku_id, round_even(gp, 2)::DOUBLE AS total_gp, round_even(s, 2)::DOUBLE AS total_sales,
  round_even(gp / nullif(s, 0) * 100, 1)::DOUBLE AS gp_pct, location_count
FROM (SELECT prod_line_pn AS sku_id, sum(gross_profit)::DOUBLE AS gp, sum(sales)::DOUBLE AS s, count(DISTINCT location_id) AS location_count
  FROM sales_detail WHERE tran_date >= {D} - 90 AND gross_profit > 0 GROUP BY 1 ORDER BY gp DESC, 1 LIMIT 10)
"""
VIEWS["report_anomaly_summary"] = """
SELECT 'gp_anomaly' AS alert_type, 'warning' AS severity, location_id, count(*) AS alerts FROM margin_drops GROUP BY 3
"""
VIEWS["report_supplier_detail"] = """
SELECT s.supplier_id, composite_score, risk_flag, fill_rate_pct, on_time_delivery_pct, avg_lead_time_days,
  round_even(r / nullif(o, 0) * 100, 1)::DOUBLE AS actual_fill_rate, round_even(ltv, 1)::DOUBLE AS avg_lead_time_variance,
  coalesce(open_n, 0) AS open_po_count, round_even(coalesce(open_v, 0), 2)::DOUBLE AS open_po_value, coalesce(got_n, 0) AS delivered_count
FROM supplier_scores s LEFT JOIN (
  SELECT supplier_id, count(*) FILTER (WHERE status IN ('open', 'partial')) AS open_n,
    (sum(CAST(qty_ordered AS DECIMAL(12,0)) * unit_cost) FILTER (WHERE status IN ('open', 'partial')))::DOUBLE AS open_v,
    count(*) FILTER (WHERE status IN ('received', 'partial')) AS got_n,
    coalesce(sum(qty_ordered) FILTER (WHERE status IN ('received', 'partial')), 0) AS o,
    coalesce(sum(qty_received) FILTER (WHERE status IN ('received', 'partial')), 0) AS r,
    avg(actual_delivery_date - expected_delivery_date) FILTER (WHERE status IN ('received', 'partial')) AS ltv
  FROM purchase_orders GROUP BY 1) p ON p.supplier_id = s.supplier_id
"""
VIEWS["report_open_orders"] = """
SELECT * FROM (SELECT supplier_id, po_number, line_number, sku_id, qty_ordered, status, expected_delivery_date, value,
    row_number() OVER (PARTITION BY supplier_id ORDER BY expected_delivery_date, po_number, line_number, sku_id, value)::INTEGER
      AS rank_in_group
  FROM (SELECT *, round_even(qty_ordered * unit_cost::DOUBLE, 2)::DOUBLE AS value FROM purchase_orders
    WHERE status IN ('open', 'partial')))
WHERE rank_in_group <= 6
"""
VIEWS["report_morning_brief"] = """
SELECT * FROM (SELECT count(*) FILTER (WHERE severity = 'critical') AS critical_alerts FROM alerts_today)
CROSS JOIN (SELECT count(*) FILTER (WHERE NOT is_approved AND urgency IN ('critical', 'warning')) AS urgent_reorders,
  count(*) FILTER (WHERE recommendation_type = 'transfer') AS transfer_ops FROM latest_recs)
"""
VIEWS["report_critical_actions"] = f"""
SELECT * FROM (
  SELECT * FROM (SELECT 'alert' AS kind, severity, alert_key, sku_id, location_id, supplier_id, financial_impact FROM alerts_today
    WHERE severity = 'critical' OR alert_type IN ('CHURN_RISK', 'OPSL_GAP')
    ORDER BY {_RANK}, financial_impact DESC, alert_key)
  UNION ALL
  SELECT * FROM (SELECT 'overdue_po', 'critical', 'overdue_po|' || po_number || '|' || line_number || '|' || sku_id, sku_id,
      CAST(NULL AS VARCHAR), supplier_id, round_even(qty_ordered * unit_cost::DOUBLE, 2)::DOUBLE AS v
    FROM purchase_orders WHERE status = 'open' AND expected_delivery_date < {D}
    ORDER BY expected_delivery_date, po_number, line_number, sku_id, v)
  UNION ALL
  SELECT 'red_supplier', 'warning', 'red_supplier|' || supplier_id, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), supplier_id, 0::DOUBLE
  FROM supplier_scores WHERE risk_flag = 'red' AND supplier_id IN (SELECT supplier_id FROM purchase_orders WHERE status = 'open'))
ORDER BY financial_impact DESC, {_RANK}, alert_key LIMIT 30
"""
VIEWS["report_freshness"] = "\nUNION ALL\n".join(
    f"SELECT '{stage}' AS stage, {col} AS last_run, count(*) AS row_count FROM {table} "
    f"WHERE {col} = (SELECT max({col}) FROM {table}) GROUP BY 2"
    for stage, table, col in (("extract", "sales", "transaction_date"), ("forecast", "forecasts", "forecast_date"),
                              ("reorder", "recommendations", "recommendation_date"), ("inventory", "inventory", "snapshot_date")))
VIEWS["report_stocking_gap_locations"] = f"""
SELECT x.*, coalesce(lname, location_id) AS location_display FROM (
  SELECT location_id, count(*) FILTER (WHERE gap_classification = 'CHRONIC') AS chronic_count, count(*) AS gap_count,
    round_even(coalesce(sum(annual_cost_savings) FILTER (WHERE gap_classification = 'CHRONIC'), 0), 2)::DOUBLE AS total_annual_savings
  FROM stocking_gaps_confirmed GROUP BY 1) x {_NAMED}
"""
VIEWS["report_stocking_gap_rows"] = """
SELECT * FROM (SELECT sku_id, location_id, transfer_from_location, transfer_frequency, gap_score, gap_classification,
    annual_cost_savings, double_confirmed, confidence, row_number() OVER (PARTITION BY location_id ORDER BY double_confirmed DESC,
      CASE gap_classification WHEN 'CHRONIC' THEN 0 WHEN 'RECURRING' THEN 1 ELSE 2 END, coalesce(annual_cost_savings, 0) DESC,
      transfer_frequency DESC, sku_id)::INTEGER AS rank_in_group
  FROM stocking_gaps_confirmed) WHERE rank_in_group <= 20
"""
VIEWS["report_understocking_locations"] = f"""
SELECT x.*, coalesce(lname, location_id) AS location_display FROM (
  SELECT location_id, count(*) AS sku_count, round_even(sum(inventory_value_at_risk), 2)::DOUBLE AS total_value_at_risk,
    count(*) FILTER (WHERE double_confirmed) AS double_confirmed_count, count(*) FILTER (WHERE network_flag) AS network_count
  FROM chronic_understocking GROUP BY 1) x {_NAMED}
"""
VIEWS["report_churn_summary"] = """
SELECT count(*) FILTER (WHERE flag = 'AT_RISK') AS at_risk, count(*) FILTER (WHERE flag = 'CHURNED') AS churned,
  count(*) FILTER (WHERE flag = 'LOST') AS lost, count(*) FILTER (WHERE flag = 'DECLINING') AS declining,
  count(*) FILTER (WHERE flag = 'STABLE') AS stable, count(*) AS total,
  round_even(coalesce(sum(baseline_monthly_spend) FILTER (WHERE flag <> 'STABLE'), 0) * 12, 0)::DOUBLE AS annual_revenue_at_risk
FROM churn_flags
"""
VIEWS["report_churn_tiers"] = """
SELECT risk_tier, count(*) AS customers, round_even(avg(churn_score), 2)::DOUBLE AS avg_score,
  round_even(sum(revenue_90d), 2)::DOUBLE AS revenue_90d FROM churn_scores GROUP BY 1
"""
VIEWS["report_outside_purchases"] = """
SELECT flag, count(*) AS pairs, round_even(sum(estimated_margin_recovery), 2)::DOUBLE AS total_recovery,
  count(*) FILTER (WHERE NOT in_reorder_queue) AS not_queued FROM outside_purchase_flags GROUP BY 1
"""
VIEWS["weather_rows"] = """
SELECT log_date, is_forecast, temp_min_f, temp_max_f, precipitation_in, snowfall_in, consecutive_freeze_days, freeze_thaw_cycle
FROM weather_streaks
"""
VIEWS["report_weather_outlook"] = f"""
SELECT log_date, temp_min_f, temp_max_f, precipitation_in, snowfall_in, consecutive_freeze_days, freeze_thaw_cycle,
  coalesce(log_date > {D} AND temp_min_f < 32, FALSE) AS freeze_warning FROM weather_rows WHERE log_date BETWEEN {D} AND {D} + 7
"""
VIEWS["report_weekly_accuracy"] = """
SELECT abc_class, model_type, round_even(mape, 4)::DOUBLE AS mape, observations FROM weekly_error
"""
VIEWS["report_top_rules"] = "SELECT * FROM basket_rules ORDER BY lift DESC, antecedent_sku, consequent_sku LIMIT 15"
VIEWS["report_run_metrics"] = f"""
SELECT * FROM (SELECT count(*) AS alerts_total, count(*) FILTER (WHERE severity = 'critical') AS alerts_critical,
  count(*) FILTER (WHERE severity = 'warning') AS alerts_warning, count(*) FILTER (WHERE severity = 'info') AS alerts_info FROM alerts_today)
CROSS JOIN (SELECT count(*) AS reorders FROM recommendations WHERE recommendation_date = {D})
CROSS JOIN (SELECT count(*) AS forecasts FROM forecasts WHERE run_date = {D})
CROSS JOIN (SELECT count(*) AS scored_pairs FROM demand_quality)
"""
