"""SQL twins of the reorder and basket queries."""

from oracles import VIEWS

D = "DATE '2001-08-01'"

VIEWS["active_skus"] = f"""
SELECT * FROM sku_master WHERE is_active AND NOT (is_dead_stock AND (last_sale_date IS NULL OR last_sale_date < {D} - 180))
"""
VIEWS["latest_stock"] = f"""
SELECT sku_id, location_id, qty_on_hand, qty_on_order, reorder_point AS buyer_min FROM inventory WHERE snapshot_date = {D}
"""
VIEWS["at_risk_skus"] = """
SELECT DISTINCT i.sku_id FROM latest_stock i JOIN active_skus m ON m.sku_id = i.sku_id
WHERE qty_on_hand <= 0 OR qty_on_hand + qty_on_order <= 0 OR (avg_weekly_units > 0 AND qty_on_hand / (avg_weekly_units / 7) <
  greatest(60, 2 * (greatest(7, (SELECT max(avg_lead_time_days) FROM supplier_scores)) + 7)))
"""
VIEWS["forecast_means"] = f"""
SELECT sku_id, location_id, model_type, q / 30 AS avg_daily FROM (
  SELECT sku_id, location_id, model_type, run_date, sum(predicted_qty) AS q, max(run_date) OVER (
    PARTITION BY sku_id, location_id, model_type) AS newest
  FROM forecasts WHERE forecast_date BETWEEN {D} AND {D} + 29 GROUP BY 1, 2, 3, 4) WHERE run_date = newest
"""
# One row per usable (pair, model, source) option with its place in the order of preference.
VIEWS["forecast_options"] = """
SELECT p.sku_id, p.location_id, p.abc_class, o.pref, o.avg_daily * o.scale AS avg_daily, o.model_used
FROM (SELECT i.sku_id, i.location_id, m.abc_class FROM latest_stock i JOIN active_skus m ON m.sku_id = i.sku_id) p
JOIN (
  SELECT i.sku_id, i.location_id, f.model_type AS model, f.model_type AS model_used, 0 AS net, f.avg_daily, 1.0::DOUBLE AS scale,
    CASE WHEN m.abc_class = 'A' THEN CASE f.model_type WHEN 'prophet' THEN 0 WHEN 'lightgbm' THEN 2 ELSE 4 END
      WHEN m.abc_class = 'C' THEN CASE f.model_type WHEN 'rolling_avg' THEN 0 WHEN 'lightgbm' THEN 2 END
      ELSE CASE f.model_type WHEN 'lightgbm' THEN 0 WHEN 'rolling_avg' THEN 2 END END AS pref
  FROM latest_stock i JOIN active_skus m ON m.sku_id = i.sku_id
  JOIN forecast_means f ON f.sku_id = i.sku_id AND f.location_id = i.location_id
  UNION ALL
  SELECT i.sku_id, i.location_id, f.model_type, CASE f.model_type WHEN 'rolling_avg' THEN 'rolling_avg_network'
      ELSE f.model_type END, 1, f.avg_daily,
    CASE WHEN f.model_type <> 'rolling_avg' THEN 1.0 WHEN s.share IS NOT NULL THEN s.share
      WHEN i.sku_id IN (SELECT sku_id FROM location_shares) THEN NULL ELSE 1 / 23.0::DOUBLE END::DOUBLE,
    1 + CASE WHEN m.abc_class = 'A' THEN CASE f.model_type WHEN 'prophet' THEN 0 WHEN 'lightgbm' THEN 2 ELSE 4 END
      WHEN m.abc_class = 'C' THEN CASE f.model_type WHEN 'rolling_avg' THEN 0 WHEN 'lightgbm' THEN 2 END
      ELSE CASE f.model_type WHEN 'lightgbm' THEN 0 WHEN 'rolling_avg' THEN 2 END END
  FROM latest_stock i JOIN active_skus m ON m.sku_id = i.sku_id
  JOIN forecast_means f ON f.sku_id = i.sku_id AND f.location_id = 'ALL'
  LEFT JOIN location_shares s ON s.sku_id = i.sku_id AND s.location_id = i.location_id) o
  ON o.sku_id = p.sku_id AND o.location_id = p.location_id
WHERE o.pref IS NOT NULL AND o.scale > 0
"""
VIEWS["selected_forecasts"] = """
SELECT sku_id, location_id, abc_class, avg_daily, model_used FROM (
  SELECT *, row_number() OVER (PARTITION BY sku_id, location_id ORDER BY pref) AS r FROM forecast_options) WHERE r = 1
"""
VIEWS["stock_positions"] = f"""
SELECT *, greatest(0, target - qty_on_hand - qty_on_order)::DOUBLE AS shortfall FROM (
  SELECT *, avg_daily * threshold * CASE xyz_class WHEN 'X' THEN 1.0 WHEN 'Y' THEN 1.3 WHEN 'Z' THEN 1.8 ELSE 1.2 END::DOUBLE
    AS target
  FROM (SELECT i.sku_id, i.location_id, i.qty_on_hand, i.qty_on_order, i.buyer_min, m.abc_class, m.xyz_class, v.supplier_id,
      s.risk_flag, coalesce(nullif(s.avg_lead_time_days, 0), 7)::DOUBLE AS lead_days, f.avg_daily, f.model_used,
      coalesce(nullif(s.avg_lead_time_days, 0), 7)::DOUBLE + 7 AS threshold,
      CASE WHEN f.avg_daily > 0 THEN i.qty_on_hand / f.avg_daily END::DOUBLE AS days_of_supply
    FROM latest_stock i JOIN active_skus m ON m.sku_id = i.sku_id
    JOIN selected_forecasts f ON f.sku_id = i.sku_id AND f.location_id = i.location_id
    JOIN (SELECT m.sku_id, coalesce(nullif(m.primary_supplier_id, ''), b.supplier_id) AS supplier_id FROM active_skus m
      LEFT JOIN (SELECT sku_id, supplier_id FROM (SELECT *, row_number() OVER (PARTITION BY sku_id
          ORDER BY po_date DESC, supplier_id DESC) AS r FROM purchase_orders WHERE po_date >= {D} - 180
          AND status IN ('open', 'received', 'partial')) WHERE r = 1) b ON b.sku_id = m.sku_id) v ON v.sku_id = i.sku_id
    LEFT JOIN supplier_scores s ON s.supplier_id = v.supplier_id
    WHERE i.sku_id IN (SELECT sku_id FROM at_risk_skus)))
"""
VIEWS["chronic_gap_pairs"] = "SELECT sku_id, location_id FROM stocking_gaps WHERE gap_classification = 'CHRONIC'"
VIEWS["reorder_recommendations"] = f"""
SELECT n.sku_id, n.location_id, {D} AS recommendation_date,
  greatest(1, CAST(round_even(shortfall * CASE WHEN (n.sku_id, n.location_id) IN (SELECT (sku_id, location_id)
    FROM chronic_gap_pairs) THEN 1.5 ELSE 1 END::DOUBLE, 0) AS BIGINT))::BIGINT AS qty_to_order,
  CASE WHEN src IS NULL THEN supplier_id END AS supplier_id, CASE WHEN src IS NULL THEN 'po' ELSE 'transfer' END
    AS recommendation_type, src AS transfer_from_location,
  round_even(days_of_supply, 2)::DOUBLE AS days_of_supply_remaining,
  CASE WHEN days_of_supply < 3 THEN 'critical' WHEN days_of_supply < 7 THEN 'warning' ELSE 'normal' END AS urgency,
  model_used AS forecast_model_used, CASE WHEN src IS NULL THEN risk_flag END AS supplier_risk_flag
FROM stock_positions n LEFT JOIN (
  SELECT sku_id, location_id, src FROM (SELECT a.sku_id, a.location_id, b.location_id AS src, row_number() OVER (
      PARTITION BY a.sku_id, a.location_id ORDER BY CASE WHEN b.avg_daily > 0 THEN (b.qty_on_hand - a.shortfall) / b.avg_daily
        ELSE 'infinity'::DOUBLE END DESC, b.location_id) AS r
    FROM stock_positions a JOIN stock_positions b ON a.sku_id = b.sku_id AND a.location_id <> b.location_id
    WHERE CASE WHEN b.avg_daily > 0 THEN greatest(0, b.qty_on_hand - b.avg_daily * (b.lead_days + 14))
      ELSE b.qty_on_hand * 0.5 END >= a.shortfall AND a.shortfall >= 0.01) WHERE r = 1) t
  ON t.sku_id = n.sku_id AND t.location_id = n.location_id
WHERE days_of_supply < threshold AND shortfall >= 0.01
"""
VIEWS["basket_items"] = f"""
SELECT DISTINCT transaction_date, location_id, invoice_number, sku_id FROM (
  SELECT *, count(DISTINCT sku_id) OVER (PARTITION BY transaction_date, location_id, invoice_number) AS n FROM sales
  WHERE transaction_date BETWEEN {D} - 2500 AND {D} AND invoice_number IS NOT NULL) WHERE n > 1
"""
VIEWS["basket_rules"] = f"""
SELECT antecedent_sku, consequent_sku, round_even(s, 6)::DOUBLE AS support, round_even(c, 4)::DOUBLE AS confidence,
  round_even(l, 4)::DOUBLE AS lift, {D} AS rule_date, total AS transaction_count
FROM (SELECT p.a AS antecedent_sku, p.b AS consequent_sku, p.n / total AS s, p.n / x.n AS c, p.n / x.n / (y.n / total) AS l, total
  FROM (SELECT a.sku_id AS a, b.sku_id AS b, count(*) AS n FROM basket_items a JOIN basket_items b
      ON a.transaction_date = b.transaction_date AND a.location_id = b.location_id AND a.invoice_number = b.invoice_number
      AND a.sku_id <> b.sku_id GROUP BY 1, 2) p
  JOIN (SELECT sku_id, count(*) AS n FROM basket_items GROUP BY 1) x ON x.sku_id = p.a
  JOIN (SELECT sku_id, count(*) AS n FROM basket_items GROUP BY 1) y ON y.sku_id = p.b
  CROSS JOIN (SELECT count(DISTINCT (transaction_date, location_id, invoice_number)) AS total FROM basket_items) t)
WHERE s >= 0.00001 AND c >= 0.004 AND l >= 1.0
"""
VIEWS["basket_triggered"] = f"""
SELECT sku_id, location_id, {D} AS recommendation_date, greatest(1, CAST(round_even(shortfall, 0) AS BIGINT))::BIGINT AS qty_to_order,
  supplier_id, 'basket_triggered' AS recommendation_type, CAST(NULL AS VARCHAR) AS transfer_from_location,
  round_even(days_of_supply, 2)::DOUBLE AS days_of_supply_remaining,
  CASE WHEN days_of_supply < 3 THEN 'critical' WHEN days_of_supply < 7 THEN 'warning' ELSE 'normal' END AS urgency,
  model_used AS forecast_model_used, risk_flag AS supplier_risk_flag
FROM stock_positions
WHERE days_of_supply < 60 AND shortfall >= 0.01
  AND (sku_id, location_id) NOT IN (SELECT (sku_id, location_id) FROM reorder_recommendations)
  AND sku_id IN (SELECT consequent_sku FROM basket_rules WHERE confidence >= 0.004
    AND antecedent_sku IN (SELECT sku_id FROM reorder_recommendations))
"""
VIEWS["threshold_gaps"] = """
SELECT *, (target - buyer_min) / greatest(buyer_min, 1) AS gap FROM stock_positions
WHERE days_of_supply < threshold AND buyer_min IS NOT NULL AND (buyer_min > 1 OR target > 1)
  AND abs((target - buyer_min) / greatest(buyer_min, 1)) > 0.5
"""
VIEWS["threshold_mismatches"] = """
SELECT 'reorder_recommendations' AS source_table, sku_id || '|' || location_id || '|2001-08-01' AS source_id,
  'reorder_threshold_mismatch' AS issue_type, 'computed level and buyer minimum disagree' AS issue_detail,
  'reorder_point' AS field_name, CAST(buyer_min AS VARCHAR) AS field_value,
  CASE WHEN abs(gap) > 1 THEN 'error' ELSE 'warning' END AS severity
FROM threshold_gaps
"""
VIEWS["threshold_bias"] = """
SELECT CASE WHEN gap > 0 THEN 'high' ELSE 'low' END AS direction, count(*) AS positions,
  round_even(avg(abs(gap)) * 100, 4)::DOUBLE AS avg_gap_pct FROM threshold_gaps GROUP BY 1
"""
