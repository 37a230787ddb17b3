"""SQL twins of the source, merge, export and incremental queries."""

from oracles import VIEWS

D = "DATE '2001-08-01'"

VIEWS["cube_base"] = """
SELECT *, CASE WHEN o_custkey % 53 = 0 THEN 'HUB' ELSE location_id END AS loc,
  CASE WHEN l_orderkey % 59 = 0 THEN NULL ELSE l_quantity END AS q,
  CASE WHEN l_orderkey % 37 = 1 THEN NULL ELSE CAST((cents // qty_int) || 'E-2' AS DOUBLE) END AS price,
  CAST(cents || 'E-2' AS DOUBLE) AS rev,
  CASE WHEN l_orderkey % 13 = 0 THEN 'T0' || (o_custkey % 9 + 1) || '0' || ((o_custkey + 4) % 9 + 1)
    WHEN l_orderkey % 43 = 2 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS inv,
  CASE WHEN o_custkey % 47 = 3 OR (o_custkey + l_linenumber) % 11 = 0 THEN NULL ELSE 'C' || o_custkey END AS cust,
  CASE WHEN o_custkey % 31 <> 0 AND (o_custkey + l_linenumber) % 7 <> 0 THEN 'T' || (o_custkey % 5) END AS ctype,
  CASE WHEN l_linenumber % 4 <> 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'Hold' ELSE 'Active' END END AS cstatus,
  CASE WHEN (l_partkey + l_linenumber) % 6 <> 0 THEN 'S' || ((o_custkey + l_linenumber) % 23) END AS cman,
  CASE WHEN l_orderkey % 29 <> 4 THEN CAST((cents // 4 - l_linenumber * 100) || 'E-2' AS DOUBLE) END AS gp,
  CASE WHEN l_linenumber % 3 = 0 THEN qty_int // 2 END::DOUBLE AS back,
  CASE WHEN l_suppkey % 8 <> 1 THEN 'K' || (l_suppkey % 40) END AS man,
  CASE WHEN l_returnflag = 'R' THEN 'SL-I' WHEN l_returnflag = 'N' AND l_linenumber = 2 THEN 'CR' ELSE 'SL' END AS code,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, cents) AS ord
FROM order_lines WHERE l_orderkey % 101 <> 7
"""
VIEWS["cube_sales"] = """
SELECT 'AC-' || o_date || '-' || sku_id || '-' || loc || coalesce('-INV' || inv, '') AS transaction_id, sku_id, loc AS location_id,
  o_date AS transaction_date, q AS qty_sold, price AS unit_price, rev AS total_revenue, l_orderkey % 4 IN (0, 1) AS is_warranty,
  l_linenumber % 3 = 0 AS is_backorder, l_returnflag = 'R' AS is_core_return, disc >= 0.09 AS is_price_override,
  inv AS invoice_number, cust AS customer_id, ctype AS customer_type, cstatus AS customer_status, cman AS customer_salesman
FROM cube_base
"""
VIEWS["cube_sales_ordered"] = VIEWS["cube_sales"].replace("cust AS customer_id", "cust AS customer_id, ord")
VIEWS["merged_sales"] = """
SELECT transaction_id, any_value(sku_id) AS sku_id, any_value(location_id) AS location_id,
  any_value(transaction_date) AS transaction_date, any_value(invoice_number) AS invoice_number,
  sum(coalesce(qty_sold, 0)) AS qty_sold, round(sum(coalesce(total_revenue, 0)), 4) AS total_revenue,
  arg_max(unit_price, ord) AS unit_price, bool_or(is_warranty) AS is_warranty, bool_or(is_backorder) AS is_backorder,
  bool_or(is_core_return) AS is_core_return, bool_or(is_price_override) AS is_price_override,
  arg_min(customer_id, ord) AS customer_id, arg_min(customer_type, ord) AS customer_type,
  arg_min(customer_status, ord) AS customer_status, arg_min(customer_salesman, ord) AS customer_salesman, count(*) AS lines,
  ((count(DISTINCT customer_id) > 1)::INTEGER + (count(DISTINCT customer_type) > 1)::INTEGER
    + (count(DISTINCT customer_status) > 1)::INTEGER + (count(DISTINCT customer_salesman) > 1)::INTEGER)::INTEGER AS conflicts
FROM cube_sales_ordered GROUP BY 1
"""
VIEWS["cube_detail"] = """
SELECT 'SDT-' || substr(sha1(o_date || '|' || loc || '|' || code || '|C' || o_custkey || '-|' || sku_id), 1, 20) AS transaction_id,
  o_date AS tran_date, loc AS location_id, code AS tran_code, 'C' || o_custkey || '-' AS ship_to, sku_id AS prod_line_pn,
  CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'Y' END AS stock_flag, q AS qty_ship, rev AS sales,
  gp AS gross_profit, back AS backorder_qty, man AS salesman_id
FROM (SELECT *, row_number() OVER (PARTITION BY o_date, loc, code, o_custkey, sku_id ORDER BY ord) AS r FROM cube_base
  WHERE code IN ('SL', 'SL-I')) WHERE r = 1
"""
VIEWS["landed_margins"] = f"""
SELECT location_id, round_even(sum(CAST(coalesce(gross_profit, 0) AS DECIMAL(18,2)))::DOUBLE / sum(CAST(sales AS DECIMAL(18,2)))::DOUBLE, 6)::DOUBLE
  AS avg_gp_pct FROM cube_detail WHERE tran_date >= {D} - 365 AND sales > 0 GROUP BY 1
"""
VIEWS["intercompany_transfers"] = """
SELECT o_date AS transfer_date, sku_id, loc AS from_location_id,
  CASE WHEN o_custkey % 6 = 0 THEN loc ELSE 'LOC-00' || ((o_custkey + l_partkey) % 9 + 1) END AS to_location_id, code AS tran_code,
  sum(q) AS qty_transferred, round_even(sum(CAST(rev AS DECIMAL(14,2)))::DOUBLE, 2)::DOUBLE AS transfer_value
FROM cube_base WHERE code = 'SL-I' AND q IS NOT NULL GROUP BY 1, 2, 3, 4, 5
"""
VIEWS["invoice_routes"] = """
SELECT 'LOC-00' || (o_custkey % 9 + 1) AS from_location_id, 'LOC-00' || ((o_custkey + 4) % 9 + 1) AS to_location_id,
  count(*) AS lines, coalesce(sum(CASE WHEN l_orderkey % 59 <> 0 THEN l_quantity END), 0) AS qty
FROM order_lines WHERE l_orderkey % 13 = 0 GROUP BY 1, 2
"""
VIEWS["snapshot_costs"] = f"""
SELECT 'P' || s AS sku_id, 'LOC-00' || l AS location_id, {D} AS snapshot_date, on_hand AS qty_on_hand,
  CASE WHEN l % 2 = 0 THEN s % 9 ELSE 0 END::DOUBLE AS qty_on_order,
  round_even(CASE WHEN own > 0 THEN own WHEN listed > 0 THEN listed WHEN ext <> 0 AND on_hand > 0 THEN round_even(ext / on_hand, 4)
    ELSE own END, 4)::DOUBLE AS unit_cost,
  CASE WHEN (s + l) % 7 <> 2 THEN s % 6 END::DOUBLE AS reorder_point, CASE WHEN (s + l) % 9 <> 4 THEN s % 6 + l END::DOUBLE AS reorder_qty
FROM (SELECT s, l, CASE WHEN (s + l) % 8 = 0 THEN 0 ELSE (s * 7 + l) % 12 END::DOUBLE AS on_hand,
    CASE (s + l) % 3 WHEN 0 THEN s % 50 + 1.25 WHEN 1 THEN 0 END::DOUBLE AS own,
    CASE WHEN (s + l) % 4 = 0 THEN s % 30 + 0.5 END::DOUBLE AS listed,
    CASE WHEN (s + l) % 5 < 3 THEN (s * 3) % 90 + 0.75 END::DOUBLE AS ext
  FROM sku_locations WHERE s % 41 <> 5)
"""
VIEWS["enriched_products"] = """
SELECT * FROM (
  SELECT 'P' || (p_partkey // 4) AS sku_id,
    arg_max('V' || p_size, p_partkey) FILTER (WHERE p_size <> 3 AND p_size % 4 <> 0) AS primary_supplier_id,
    arg_max(p_type, p_partkey) FILTER (WHERE p_size > 5 AND p_size % 3 <> 0) AS product_line,
    arg_max(d, p_partkey) FILTER (WHERE d IS NOT NULL) AS description,
    arg_max('EACH', p_partkey) FILTER (WHERE p_size % 6 <> 0) AS unit_of_measure
  FROM (SELECT *, CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 THEN upper(p_name) WHEN p_size % 2 <> 0 THEN p_name END AS d FROM part)
  GROUP BY 1)
WHERE coalesce(primary_supplier_id, product_line, description, unit_of_measure) IS NOT NULL
"""
VIEWS["pricing_tiers"] = f"""
SELECT 'P' || p_partkey AS sku_id, ['1','2','3','4','5','6','7','8','9','10','A','B','C','S','ST'][i + 1] AS price_tier,
  CAST((cents + i * 25) || 'E-2' AS DOUBLE) AS price_value, CASE WHEN (p_partkey + i) % 4 <> 0 THEN 30.5 + i END::DOUBLE AS gp_margin_pct,
  CAST((cents * 6 // 10) || 'E-2' AS DOUBLE) AS unit_cost, {D} AS snapshot_date
FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, unnest(range(0, 15)) AS i FROM part)
WHERE (p_partkey + i) % 6 <> 0 AND (p_partkey + i) % 7 <> 0
"""
VIEWS["merged_customers"] = """
SELECT 'C' || o_custkey AS customer_id, arg_max('S' || (o_orderkey % 23), o_orderkey) FILTER (WHERE o_orderkey % 3 <> 0) AS salesman_id,
  arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 4 <> 0) AS customer_type,
  arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderkey % 5 <> 0) AS customer_status
FROM orders WHERE o_custkey % 71 <> 0 GROUP BY 1
"""
VIEWS["parsed_weather"] = """
SELECT log_date, temp_max_f, temp_min_f, precipitation_in, round_even(snowfall_in * 2.54::DOUBLE * 0.393701::DOUBLE, 4)::DOUBLE
  AS snowfall_in, is_forecast FROM weather
"""
VIEWS["weather_faults"] = """
SELECT w.*, CASE WHEN place % 5 = 0 THEN 'unreadable' WHEN place % 13 = 1 THEN 'missing array' WHEN place % 7 = 3 THEN 'unequal arrays'
  WHEN place % 11 = 2 THEN 'unreadable day' END AS reason
FROM (SELECT *, year(log_date) * 12 + month(log_date) AS place FROM parsed_weather) w
"""
VIEWS["landed_weather"] = """
SELECT log_date, temp_max_f, temp_min_f, precipitation_in, snowfall_in, is_forecast FROM weather_faults WHERE reason IS NULL
"""
VIEWS["quarantined_weather"] = """
SELECT reason, count(*) AS documents, count(*) AS with_file, count(*) AS with_text
FROM (SELECT DISTINCT reason, place, is_forecast FROM weather_faults WHERE reason IS NOT NULL) GROUP BY 1
"""
VIEWS["loaded_snapshots"] = """
SELECT sku_id, location_id, CASE WHEN n % 3 = 0 OR n % 23 <> 5 THEN snapshot_date END AS snapshot_date,
  CASE WHEN n % 17 <> 2 THEN qty_on_hand END AS qty_on_hand, qty_on_order, reorder_point,
  CASE WHEN n % 17 <> 2 THEN qty_on_hand <= 0 END AS is_stockout
FROM (SELECT *, CAST(substr(sku_id, 2) AS BIGINT) + day(snapshot_date) AS n FROM inventory)
"""
VIEWS["late_events"] = """
SELECT e.event_id % 3 AS part, event_type, count(*) AS events,
  coalesce(sum(CASE WHEN ts < r.reached - INTERVAL 30 DAY THEN 1 ELSE 0 END), 0)::BIGINT AS late
FROM events e LEFT JOIN (SELECT p, (SELECT max(ts) FROM events WHERE event_id % 3 < p) AS reached FROM (VALUES (0), (1), (2)) t(p)) r
  ON r.p = e.event_id % 3 GROUP BY ALL
"""
VIEWS["observed_weather"] = "SELECT log_date, is_forecast, temp_min_f, temp_max_f, precipitation_in, snowfall_in FROM weather"
VIEWS["unregistered_skus"] = """
SELECT DISTINCT sku_id, TRUE AS is_active FROM sales WHERE sku_id NOT IN (SELECT sku_id FROM sku_master WHERE is_active)
"""
VIEWS["recs_today"] = f"SELECT * FROM recommendations WHERE recommendation_date = {D}"
VIEWS["recs_yesterday"] = f"SELECT * FROM recommendations WHERE recommendation_date = {D} - 1"
VIEWS["upserted_recommendations"] = """
SELECT * FROM recs_today UNION ALL SELECT * FROM recs_yesterday
WHERE (sku_id, location_id) NOT IN (SELECT (sku_id, location_id) FROM recs_today)
"""
VIEWS["inserted_recommendations"] = """
SELECT * FROM recs_yesterday UNION ALL SELECT * FROM recs_today
WHERE (sku_id, location_id) NOT IN (SELECT (sku_id, location_id) FROM recs_yesterday)
"""
VIEWS["updated_master"] = """
SELECT m.sku_id, coalesce(s.last_sale_date, m.last_sale_date) AS last_sale_date,
  coalesce(s.avg_weekly_units, m.avg_weekly_units) AS avg_weekly_units, m.abc_class
FROM sku_master m LEFT JOIN sku_metrics s ON s.sku_id = m.sku_id
"""
VIEWS["retained_forecasts"] = f"SELECT * FROM forecasts WHERE NOT (model_type = 'prophet' AND run_date < {D} - 7)"
VIEWS["latest_snapshots"] = f"SELECT * EXCLUDE (is_stockout) REPLACE (unit_cost AS unit_cost) FROM inventory WHERE snapshot_date = {D}"
_NAMED = "LEFT JOIN (SELECT location_id AS lid, location_name AS lname FROM locations) nm ON nm.lid = x.location_id"


def _text(*cols: str) -> str:
    return ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in cols)


VIEWS["export_dead_stock"] = f"""
SELECT {_text('sku_id', 'location_id', 'classification', 'action', 'days_since_sale', 'sale_frequency', 'abc_class', 'supplier_id')},
  coalesce(lname, location_id) AS location_name FROM dead_stock x {_NAMED} WHERE classification IN ('LIQUIDATE', 'MARKDOWN')
"""
VIEWS["export_reorder"] = f"""
SELECT {_text('recommendation_date', 'urgency', 'recommendation_type', 'sku_id', 'location_id', 'transfer_from_location', 'qty_to_order', 'supplier_id')},
  coalesce(lname, location_id) AS location_name FROM recs_today x {_NAMED} WHERE NOT is_approved
"""
VIEWS["export_transfers"] = f"""
SELECT {_text('recommendation_date', 'sku_id', 'transfer_from_location', 'location_id', 'qty_to_order', 'urgency')}
FROM recommendations WHERE recommendation_type = 'transfer' AND recommendation_date =
  (SELECT max(recommendation_date) FROM recommendations WHERE recommendation_type = 'transfer')
"""
VIEWS["export_understocking"] = f"""
SELECT {_text('location_id', 'sku_id', 'sku_description', 'days_observed', 'days_below_reorder', 'network_flag', 'double_confirmed')}
FROM chronic_understocking
"""
VIEWS["export_stocking_gaps"] = f"""
SELECT {_text('location_id', 'sku_id', 'transfer_from_location', 'transfer_frequency', 'transfer_streak', 'gap_classification', 'trend_direction', 'confidence')}
FROM stocking_gaps_confirmed
"""
VIEWS["guarded_cells"] = """
SELECT CAST(p_partkey AS VARCHAR) AS part, CASE p_size % 8 WHEN 0 THEN '''=' WHEN 1 THEN '''+' WHEN 2 THEN '''-' WHEN 3 THEN '''@'
  WHEN 4 THEN '''' || chr(9) WHEN 5 THEN '''' || chr(13) WHEN 6 THEN '' ELSE 'x' END || p_name AS cell FROM part
"""
VIEWS["streamed_orders"] = """
SELECT 'LOC-00' || (o_custkey % 9 + 1) AS location_id, CAST(o_orderdate AS DATE) AS order_date, count(*) AS orders,
  sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders GROUP BY 1, 2
"""
VIEWS["unique_events"] = "SELECT event_type, count(DISTINCT event_id) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1"
VIEWS["rows_to_load"] = f"""
SELECT tran_date, count(*) AS rows FROM sales_detail
WHERE tran_date >= (SELECT max(transaction_date) FROM sales WHERE transaction_date <= {D} - 60) - 30 GROUP BY 1
"""
VIEWS["daily_load"] = f"SELECT transaction_id, tran_date, prod_line_pn, qty_ship FROM sales_detail WHERE tran_date = {D}"
VIEWS["extended_streaks"] = f"SELECT * FROM weather_rows WHERE log_date >= {D} - 40"

VIEWS["reloaded_orders"] = """
WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, date_trunc('month', o_orderdate)::DATE AS month FROM orders)
SELECT CASE WHEN o_orderkey % 5 = 0 THEN (month + INTERVAL 3 MONTH)::DATE ELSE month END AS month,
       CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 2 END::BIGINT AS seq, count(*)::BIGINT AS orders,
       sum(CASE WHEN o_orderkey % 5 = 0 THEN cents + 1 ELSE cents END)::BIGINT AS cents
FROM o GROUP BY 1, 2
"""
