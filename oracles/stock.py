"""SQL twins of the stock, stocking-gap and outside-purchase queries."""

from oracles import VIEWS

D = "DATE '2001-08-01'"

VIEWS["outside_purchase_summary"] = f"""
SELECT prod_line_pn, location_id, count(*) AS opsl_count, sum(sales)::DOUBLE AS total_opsl_sales,
  sum(gross_profit)::DOUBLE AS total_opsl_gp, max(tran_date) AS last_opsl_date
FROM sales_detail WHERE tran_date >= {D} - 90 AND stock_flag = 'N' AND tran_code = 'SL' GROUP BY 1, 2
"""
VIEWS["margin_baselines"] = f"""
SELECT location_id, sum(gross_profit)::DOUBLE / nullif(sum(sales)::DOUBLE, 0) AS avg_gp_pct FROM sales_detail
WHERE tran_date >= {D} - 90 AND tran_code IN ('SL', 'SL-I') AND sales > 0 GROUP BY 1
"""


def _flags(high: int, medium: int) -> str:
    return f"""
SELECT prod_line_pn, location_id, opsl_count, round_even(total_opsl_sales, 4)::DOUBLE AS total_opsl_sales,
  round_even(total_opsl_gp, 4)::DOUBLE AS total_opsl_gp, gp AS avg_gp_pct, base AS baseline_gp_pct,
  round_even(greatest(0, base - gp) * total_opsl_sales, 4)::DOUBLE AS estimated_margin_recovery,
  CASE WHEN opsl_count >= {high} THEN 'HIGH' WHEN opsl_count >= {medium} THEN 'MEDIUM' ELSE 'LOW' END AS flag,
  last_opsl_date, queued AS in_reorder_queue
FROM (SELECT o.*, coalesce(round_even(b.avg_gp_pct, 4), 0.35)::DOUBLE AS base,
    CASE WHEN total_opsl_sales > 0 THEN round_even(total_opsl_gp / total_opsl_sales, 4) ELSE 0 END::DOUBLE AS gp,
    (o.prod_line_pn, o.location_id) IN (SELECT (sku_id, location_id) FROM recommendations
      WHERE recommendation_date = (SELECT max(recommendation_date) FROM recommendations)) AS queued
  FROM outside_purchase_summary o LEFT JOIN margin_baselines b ON b.location_id = o.location_id)
"""


VIEWS["outside_purchase_flags"] = _flags(5, 2)
VIEWS["outside_flags_low"] = _flags(2, 1)
VIEWS["outside_purchase_orders"] = f"""
SELECT prod_line_pn AS sku_id, location_id, {D} AS recommendation_date, opsl_count * 2::DOUBLE AS qty_to_order,
  'po' AS recommendation_type, 'warning' AS urgency, 'OPSL' AS source
FROM outside_flags_low WHERE flag = 'HIGH' AND NOT in_reorder_queue
"""

VIEWS["transfer_days"] = f"""
SELECT sku_id, location_id, recommendation_date AS d, sum(qty_to_order) AS q, count(*) AS n FROM recommendations
WHERE recommendation_type = 'transfer' AND recommendation_date >= {D} - 90 GROUP BY 1, 2, 3
"""
VIEWS["stocking_gaps"] = f"""
SELECT sku_id, location_id, {D} AS analysis_date, transfer_from_location, freq AS transfer_frequency,
  streak AS transfer_streak, round_even(avg_qty, 4)::DOUBLE AS avg_qty_recommended,
  round_even(avg_qty * coalesce(cost, 0) * freq, 2)::DOUBLE AS total_transfer_value,
  round_even(CASE WHEN chronic THEN least(0.70::DOUBLE + 0.30::DOUBLE * greatest(least(freq / 10, 1), least(streak / 5, 1)), 1)
    WHEN freq >= 5 THEN least(0.40::DOUBLE + 0.30::DOUBLE * (freq - 5) / 5, 0.699) ELSE freq / 5 * 0.40::DOUBLE END, 4)
    ::DOUBLE AS gap_score,
  CASE WHEN chronic THEN 'CHRONIC' WHEN freq >= 5 THEN 'RECURRING' ELSE 'OCCASIONAL' END AS gap_classification,
  CASE WHEN chronic THEN round_even(avg_qty * 1.5::DOUBLE * 1.2::DOUBLE, 2) END::DOUBLE AS suggested_stock_increase,
  reorder_point AS current_reorder_point,
  CASE WHEN chronic THEN round_even(freq / 90 * 365 * avg_qty * 2.5::DOUBLE, 2) END::DOUBLE AS annual_cost_savings,
  CASE WHEN p30 = 0 THEN CASE WHEN l30 > 0 THEN 'INCREASING' ELSE 'STABLE' END WHEN l30 / p30 >= 1.2 THEN 'INCREASING'
    WHEN l30 / p30 <= 0.8 THEN 'DECREASING' ELSE 'STABLE' END AS trend_direction
FROM (SELECT g.*, s.streak, f.transfer_from_location, m.unit_cost::DOUBLE AS cost, i.reorder_point,
    (freq >= 10 OR streak >= 5) AS chronic
  FROM (SELECT sku_id, location_id, count(*) AS freq, sum(q) / sum(n) AS avg_qty, count(*) FILTER (WHERE d >= {D} - 30) AS l30,
      count(*) FILTER (WHERE d BETWEEN {D} - 60 AND {D} - 31) AS p30 FROM transfer_days GROUP BY 1, 2) g
  JOIN (SELECT sku_id, location_id, max(len) AS streak FROM (
      SELECT sku_id, location_id, count(*) AS len FROM (
        SELECT *, d - CAST(row_number() OVER (PARTITION BY sku_id, location_id ORDER BY d) AS INTEGER) AS island
        FROM transfer_days) GROUP BY sku_id, location_id, island) GROUP BY 1, 2) s
    ON s.sku_id = g.sku_id AND s.location_id = g.location_id
  LEFT JOIN (SELECT sku_id, location_id, transfer_from_location FROM (
      SELECT sku_id, location_id, transfer_from_location, row_number() OVER (PARTITION BY sku_id, location_id
        ORDER BY count(*) DESC, transfer_from_location) AS r
      FROM recommendations WHERE recommendation_type = 'transfer' AND recommendation_date >= {D} - 90
      GROUP BY 1, 2, 3) WHERE r = 1) f ON f.sku_id = g.sku_id AND f.location_id = g.location_id
  LEFT JOIN sku_master m ON m.sku_id = g.sku_id
  LEFT JOIN inventory i ON i.sku_id = g.sku_id AND i.location_id = g.location_id AND i.snapshot_date = {D})
"""
VIEWS["stocking_gaps_confirmed"] = """
SELECT g.* EXCLUDE (annual_cost_savings), hot AS double_confirmed, CASE WHEN hot THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
  CASE WHEN gap_classification = 'CHRONIC' THEN CASE WHEN actual IS NOT NULL THEN 'OPSL_ACTUAL' ELSE 'TRANSFER_ESTIMATE' END END
    AS savings_source,
  CASE WHEN gap_classification = 'CHRONIC' THEN coalesce(actual, annual_cost_savings) END AS annual_cost_savings
FROM (SELECT g.*, (g.sku_id, g.location_id) IN (SELECT (prod_line_pn, location_id) FROM outside_purchase_flags
      WHERE flag IN ('HIGH', 'MEDIUM')) AS hot, a.actual
  FROM stocking_gaps g LEFT JOIN (
    SELECT o.prod_line_pn, o.location_id, round_even((coalesce(avg_gp_pct, 0.35) * total_opsl_sales - total_opsl_gp) * 4, 2)::DOUBLE
      AS actual
    FROM outside_purchase_summary o LEFT JOIN margin_baselines b ON b.location_id = o.location_id
    WHERE total_opsl_sales > 0 AND coalesce(avg_gp_pct, 0.35) * total_opsl_sales - total_opsl_gp > 0) a
  ON a.prod_line_pn = g.sku_id AND a.location_id = g.location_id) g
"""
VIEWS["stocking_gaps_confirmed"] = VIEWS["stocking_gaps_confirmed"].replace(
    "g.* EXCLUDE (annual_cost_savings)", "g.* EXCLUDE (annual_cost_savings, hot, actual)")

VIEWS["profit_per_unit"] = f"""
SELECT prod_line_pn AS sku_id, CASE WHEN sum(qty_ship) > 0 THEN sum(gross_profit)::DOUBLE / sum(qty_ship) ELSE 0 END::DOUBLE
  AS gp_per_unit
FROM sales_detail WHERE tran_date >= {D} - 90 AND tran_code IN ('SL', 'SL-I') GROUP BY 1
"""
VIEWS["understocked_rows"] = f"""
SELECT x.sku_id, x.location_id, coalesce(m.description, '') AS sku_description, days_observed, days_below_reorder,
  round_even(pct, 4)::DOUBLE AS stockout_days_pct, round_even(daily, 4)::DOUBLE AS avg_daily_demand,
  current_min AS current_min_qty, round_even(daily * 21, 2)::DOUBLE AS suggested_min_qty,
  round_even(daily * 21 - current_min, 2)::DOUBLE AS min_qty_gap, round_even(unit, 2)::DOUBLE AS unit_cost,
  round_even(daily * unit * 21, 2)::DOUBLE AS inventory_value_at_risk, coalesce(transfers, 0) AS transfer_recommended_count,
  round_even(pct * daily * unit, 4)::DOUBLE AS priority_score,
  round_even(pct * coalesce(gp_per_unit, 0) * daily, 2)::DOUBLE AS financial_severity,
  round_even(coalesce(gp_per_unit, 0), 4)::DOUBLE AS avg_gp_pct,
  (x.sku_id, x.location_id) IN (SELECT (prod_line_pn, location_id) FROM outside_purchase_flags
    WHERE flag IN ('HIGH', 'MEDIUM')) AS double_confirmed
FROM (SELECT x.*, m.description, m.avg_weekly_units / 7 AS daily, coalesce(x.cost, m.unit_cost, 0)::DOUBLE AS unit
  FROM (SELECT sku_id, location_id, count(*) AS days_observed, count(*) FILTER (WHERE qty_on_hand < reorder_point)
      AS days_below_reorder, arg_max(reorder_point, snapshot_date) AS current_min,
      count(*) FILTER (WHERE qty_on_hand < reorder_point) / count(*) AS pct,
      arg_max(unit_cost, snapshot_date) FILTER (WHERE unit_cost IS NOT NULL) AS cost
    FROM inventory WHERE snapshot_date >= {D} - 90 AND reorder_point > 0 GROUP BY 1, 2) x
  JOIN sku_master m ON m.sku_id = x.sku_id) x
JOIN sku_master m ON m.sku_id = x.sku_id
LEFT JOIN profit_per_unit p ON p.sku_id = x.sku_id
LEFT JOIN (SELECT sku_id, location_id, count(*) AS transfers FROM recommendations
  WHERE recommendation_type = 'transfer' AND recommendation_date >= {D} - 30 GROUP BY 1, 2) t
  ON t.sku_id = x.sku_id AND t.location_id = x.location_id
WHERE pct >= 0.3 AND daily > 0 AND unit > 0
"""
VIEWS["chronic_understocking"] = """
SELECT *, sku_id IN (SELECT sku_id FROM understocked_rows WHERE stockout_days_pct > 0.5 GROUP BY 1 HAVING count(*) >= 5)
  AS network_flag FROM understocked_rows
"""
VIEWS["understocking_report"] = """
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY location_id
  ORDER BY double_confirmed DESC, financial_severity DESC, sku_id) AS r FROM chronic_understocking) WHERE r <= 20
"""
VIEWS["network_orders"] = f"""
SELECT sku_id, 'LOC-025' AS location_id, {D} AS recommendation_date,
  round_even(greatest(sum(CAST(min_qty_gap AS DECIMAL(18,2)))::DOUBLE * 1.5::DOUBLE, 1), 2)::DOUBLE AS qty_to_order,
  'po' AS recommendation_type, 'critical' AS urgency, 'NETWORK_UNDERSTOCK' AS source,
  'Network understocking trigger: ' || string_agg(location_id || ' (' ||
    CAST(round_even(stockout_days_pct * 100, 0) AS INTEGER) || '%)', ', ' ORDER BY stockout_days_pct DESC, location_id) AS notes
FROM chronic_understocking WHERE network_flag AND stockout_days_pct > 0.5 GROUP BY 1
"""
VIEWS["transfer_intelligence"] = """
SELECT * FROM (SELECT x.sku_id, location_id, coalesce(nullif(sku_description, ''), m.description, '') AS sku_description, tier,
    CASE tier WHEN 1 THEN 'CONFIRMED_GAP' WHEN 2 THEN 'TRANSFER_PATTERN_ONLY' ELSE 'UNDERSTOCKED_ONLY' END AS tier_label,
    transfer_frequency, transfer_streak, gap_score, gap_classification, avg_qty_recommended,
    annual_cost_savings AS annual_transfer_savings, stockout_days_pct, days_below_reorder, days_observed,
    round_even(daily, 4)::DOUBLE AS avg_daily_demand,
    coalesce(inventory_value_at_risk, CASE WHEN cost <> 0 THEN round_even(daily * cost * 21, 2) END)::DOUBLE
      AS inventory_value_at_risk,
    coalesce(current_min_qty, current_reorder_point) AS current_min_qty,
    round_even(CASE WHEN tier <> 2 THEN suggested_min_qty ELSE current_reorder_point + suggested_stock_increase END, 2)::DOUBLE
      AS suggested_min_qty,
    round_even(CASE WHEN tier <> 2 THEN coalesce(min_qty_gap, 0) WHEN current_reorder_point IS NOT NULL
      THEN coalesce(suggested_stock_increase, 0) ELSE 0 END, 2)::DOUBLE AS min_qty_gap,
    round_even(cost, 2)::DOUBLE AS unit_cost,
    round_even(CASE tier WHEN 1 THEN inventory_value_at_risk * (1 + gap_score)
      WHEN 2 THEN coalesce(annual_cost_savings, gap_score * total_transfer_value) ELSE priority_score END, 4)::DOUBLE
      AS priority_score
  FROM (SELECT x.*, m.description AS md, coalesce(x.unit_cost, m.unit_cost::DOUBLE) AS cost,
      coalesce(avg_daily_demand, CASE WHEN m.avg_weekly_units > 0 THEN m.avg_weekly_units / 7 END) AS daily
    FROM (SELECT coalesce(g.sku_id, u.sku_id) AS sku_id, coalesce(g.location_id, u.location_id) AS location_id,
        CASE WHEN g.sku_id IS NOT NULL AND u.sku_id IS NOT NULL THEN 1 WHEN g.sku_id IS NOT NULL THEN 2 ELSE 3 END::INTEGER AS tier,
        g.* EXCLUDE (sku_id, location_id), u.* EXCLUDE (sku_id, location_id, double_confirmed)
      FROM (SELECT * FROM stocking_gaps_confirmed WHERE gap_classification IN ('CHRONIC', 'RECURRING')) g
      FULL JOIN chronic_understocking u ON u.sku_id = g.sku_id AND u.location_id = g.location_id) x
    LEFT JOIN sku_master m ON m.sku_id = x.sku_id) x LEFT JOIN sku_master m ON m.sku_id = x.sku_id)
"""
VIEWS["resolved_unit_costs"] = f"""
SELECT k.sku_id, coalesce(s.c, m.unit_cost::DOUBLE, p.c)::DOUBLE AS unit_cost
FROM (SELECT sku_id FROM sku_master UNION SELECT sku_id FROM inventory UNION SELECT sku_id FROM purchase_orders
  WHERE status = 'received') k
LEFT JOIN (SELECT sku_id, max(unit_cost)::DOUBLE AS c FROM inventory WHERE snapshot_date = {D} GROUP BY 1) s ON s.sku_id = k.sku_id
LEFT JOIN sku_master m ON m.sku_id = k.sku_id
LEFT JOIN (SELECT sku_id, unit_cost::DOUBLE AS c FROM (SELECT *, row_number() OVER (PARTITION BY sku_id
    ORDER BY actual_delivery_date DESC, po_number DESC, line_number DESC, unit_cost DESC) AS r FROM purchase_orders
    WHERE status = 'received') WHERE r = 1) p ON p.sku_id = k.sku_id
"""
VIEWS["dead_stock_inputs"] = f"""
SELECT i.sku_id, i.location_id, i.qty_on_hand, coalesce(c.unit_cost, 10)::DOUBLE AS unit_cost, coalesce(s.freq, 0) AS freq,
  coalesce({D} - coalesce(s.last_sale, m.last_sale_date), 365)::INTEGER AS days, coalesce(m.abc_class, 'C') AS abc,
  coalesce(m.avg_weekly_units, 0) AS weekly, v.supplier_id, t.loc, d.prod_line_pn IS NOT NULL AS conflict
FROM inventory i LEFT JOIN sku_master m ON m.sku_id = i.sku_id LEFT JOIN resolved_unit_costs c ON c.sku_id = i.sku_id
LEFT JOIN (SELECT sku_id, location_id, max(transaction_date) AS last_sale, count(DISTINCT transaction_date) AS freq FROM sales
  WHERE transaction_date >= {D} - 365 AND NOT is_warranty GROUP BY 1, 2) s
  ON s.sku_id = i.sku_id AND s.location_id = i.location_id
LEFT JOIN (SELECT sku_id, supplier_id FROM (SELECT *, row_number() OVER (PARTITION BY sku_id
    ORDER BY actual_delivery_date DESC, po_number DESC, line_number DESC, supplier_id DESC) AS r
    FROM purchase_orders WHERE status = 'received') WHERE r = 1) v ON v.sku_id = i.sku_id
LEFT JOIN (SELECT sku_id, arg_min(location_id, p || location_id) AS loc FROM (
    SELECT sku_id, location_id, '0' AS p FROM recommendations WHERE recommendation_date = {D} AND qty_to_order > 0
    UNION ALL SELECT sku_id, location_id, '1' AS p FROM chronic_understocking) GROUP BY 1) t ON t.sku_id = i.sku_id
LEFT JOIN (SELECT DISTINCT prod_line_pn FROM sales_detail WHERE tran_date >= {D} - 365) d ON d.prod_line_pn = i.sku_id
WHERE i.snapshot_date = {D} AND i.qty_on_hand > 0
"""
VIEWS["dead_stock"] = """
SELECT sku_id, location_id, cls AS classification,
  CASE WHEN cls = 'MARKDOWN' THEN 'Markdown — price reduction' WHEN cls <> 'LIQUIDATE' THEN '' WHEN value < 25 THEN 'Write off'
    WHEN supplier_id IS NOT NULL THEN 'Return to vendor'
    WHEN weekly >= 1 OR abc IN ('A', 'B') THEN 'Markdown — price reduction' ELSE 'Liquidate / delist' END AS action,
  round_even(value * (days / 365) / (freq + 1), 4)::DOUBLE AS dead_stock_score,
  round_even(CASE WHEN cls = 'HEALTHY' THEN 0 ELSE urgency END, 4)::DOUBLE AS urgency_score,
  round_even(value, 4)::DOUBLE AS total_inv_value, qty_on_hand, unit_cost, days AS days_since_sale, freq AS sale_frequency,
  abc AS abc_class, supplier_id,
  CASE WHEN cls IN ('LIQUIDATE', 'MARKDOWN') AND loc IS NOT NULL THEN 'TRANSFER' ELSE cls END AS action_type,
  loc AS transfer_candidate_location, conflict AS data_conflict
FROM (SELECT *, CASE WHEN freq >= 12 OR days < 60 THEN 'HEALTHY' WHEN urgency >= 2 THEN 'LIQUIDATE'
    WHEN urgency >= 1 THEN 'MARKDOWN' ELSE 'MONITOR' END AS cls
  FROM (SELECT *, qty_on_hand * unit_cost AS value, days / 365 * log10(qty_on_hand * unit_cost + 1) AS urgency
    FROM dead_stock_inputs))
"""
VIEWS["dead_stock_flags"] = """
SELECT sku_id, bool_or(classification = 'LIQUIDATE') AS is_dead_stock FROM dead_stock
WHERE classification IN ('LIQUIDATE', 'HEALTHY') GROUP BY 1
"""
VIEWS["dead_stock_summary"] = """
SELECT count(*) AS total_positions_scored, count(*) FILTER (WHERE classification = 'LIQUIDATE') AS liquidate_count,
  count(*) FILTER (WHERE classification = 'MARKDOWN') AS markdown_count,
  count(*) FILTER (WHERE classification = 'MONITOR') AS monitor_count,
  count(*) FILTER (WHERE classification = 'HEALTHY') AS healthy_count,
  round_even(coalesce(sum(total_inv_value) FILTER (WHERE sell), 0), 2)::DOUBLE AS capital_at_risk,
  round_even(coalesce(sum(total_inv_value) FILTER (WHERE sell AND NOT data_conflict), 0), 2)::DOUBLE AS clean_capital_at_risk,
  round_even(coalesce(sum(total_inv_value) FILTER (WHERE classification = 'LIQUIDATE'), 0), 2)::DOUBLE AS liquidate_value,
  round_even(coalesce(sum(total_inv_value) FILTER (WHERE classification = 'MARKDOWN'), 0), 2)::DOUBLE AS markdown_value,
  count(*) FILTER (WHERE sell AND action_type = 'TRANSFER') AS transfer_count,
  count(*) FILTER (WHERE sell AND data_conflict) AS data_conflict_count,
  count(*) FILTER (WHERE sell AND NOT data_conflict AND total_inv_value >= 500) AS alert_eligible_count
FROM (SELECT *, classification IN ('LIQUIDATE', 'MARKDOWN') AS sell FROM dead_stock)
"""
