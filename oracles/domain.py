"""SQL twins of the domain views."""

from oracles import VIEWS

VIEWS["order_lines"] = """
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_returnflag, l.l_linestatus,
  o.o_custkey, CAST(o.o_orderdate AS DATE) AS o_date,
  'P' || (l.l_partkey // 20) AS sku_id, 'LOC-00' || (o.o_custkey % 9 + 1) AS location_id,
  CAST(l.l_extendedprice AS DECIMAL(12,2)) AS ext, CAST(l.l_discount AS DECIMAL(4,2)) AS disc,
  CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents, CAST(l.l_quantity AS BIGINT) AS qty_int
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

VIEWS["sales"] = """
SELECT 'AC-' || CAST(o_date AS VARCHAR) || '-' || sku_id || '-' || location_id || '-INV' || l_orderkey AS transaction_id,
  sku_id, location_id, o_date AS transaction_date,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -l_quantity ELSE l_quantity END AS qty_sold,
  CASE WHEN l_orderkey % 37 = 1 THEN NULL
    ELSE CAST((cents * 100 // qty_int) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(12,4)) END AS unit_price,
  CAST(ext * (1 - disc) AS DECIMAL(14,4)) AS total_revenue,
  (l_orderkey + l_linenumber) % 11 = 0 AS is_stockout,
  CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 AND l_partkey % 3 <> 0 THEN l_quantity * 0.5::DOUBLE END
    AS lost_sales_imputation,
  (l_orderkey * 7 + l_linenumber) % 97 = 0 AS is_anomaly,
  (l_partkey + l_orderkey) % 53 = 0 AS is_residual_demand,
  l_orderkey % 41 = 5 AS is_warranty,
  l_returnflag = 'R' AND l_linenumber = 1 AS is_core_return,
  l_linestatus = 'O' AND l_orderkey % 29 = 3 AS is_backorder,
  CASE WHEN l_orderkey % 43 = 2 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS invoice_number,
  CASE WHEN o_custkey % 47 = 3 THEN NULL ELSE 'C' || o_custkey END AS customer_id,
  CASE WHEN o_custkey % 4 = 0 THEN 'COMMERCIAL' ELSE 'RETAIL' END AS customer_type,
  CASE WHEN o_custkey % 17 = 0 THEN 'INACTIVE' WHEN o_custkey % 19 = 0 THEN 'closed'
    WHEN o_custkey % 5 = 0 THEN NULL ELSE 'ACTIVE' END AS customer_status,
  'S' || ((o_custkey + l_linenumber) % 5) AS salesman_id, l_linenumber
FROM order_lines
"""

VIEWS["sales_detail"] = """
SELECT transaction_id, tran_date, location_id, tran_code, ship_to, prod_line_pn, qty_ship, sales,
  CAST(sales - ext * cost_share * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,4)) AS gross_profit,
  stock_flag, salesman_id
FROM (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS transaction_id, o_date AS tran_date, location_id,
    CASE WHEN l_returnflag = 'R' THEN 'SL-I' ELSE 'SL' END AS tran_code,
    CASE WHEN o_custkey % 3 = 0 THEN 'C' || o_custkey || '-'
      WHEN o_custkey % 3 = 1 THEN 'C' || o_custkey || '-JOB' || (o_custkey % 7) ELSE 'C' || o_custkey END AS ship_to,
    sku_id AS prod_line_pn, l_quantity AS qty_ship, ext, CAST(ext * (1 - disc) AS DECIMAL(14,4)) AS sales,
    CAST(50 + 2 * (l_partkey % 10) + CASE WHEN o_date >= DATE '2001-08-01' - 7 AND l_partkey % 3 = 0 THEN 25 ELSE 0 END
      AS DECIMAL(4,0)) AS cost_share,
    CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'Y' END AS stock_flag,
    'S' || ((o_custkey + l_linenumber) % 5) AS salesman_id
  FROM order_lines)
"""

VIEWS["purchase_orders"] = """
SELECT l_orderkey AS po_number, l_linenumber AS line_number, sku_id, 'V' || l_suppkey AS supplier_id, location_id,
  o_date AS po_date, o_date + 14 AS expected_delivery_date,
  CASE WHEN status IN ('received', 'partial') THEN
    o_date + CAST(7 + l_orderkey % 15 + CASE WHEN l_suppkey % 7 = 0 THEN 20 ELSE 0 END AS INTEGER) END
    AS actual_delivery_date,
  l_quantity AS qty_ordered,
  CASE WHEN status IN ('open', 'cancelled') THEN 0::DOUBLE WHEN status = 'partial' THEN l_quantity / 2
    WHEN l_partkey % 11 = 0 THEN l_quantity * 1.25::DOUBLE
    WHEN (l_partkey + l_suppkey) % 5 <> 0 THEN l_quantity ELSE l_quantity / 2 END AS qty_received,
  CAST((cents * 65 // qty_int) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(12,4)) AS unit_cost, status
FROM (SELECT *, CASE (l_orderkey + l_linenumber) % 10 WHEN 0 THEN 'open' WHEN 1 THEN 'cancelled'
    WHEN 2 THEN 'partial' ELSE 'received' END AS status FROM order_lines)
"""

VIEWS["sku_keys"] = "SELECT DISTINCT p_partkey // 20 AS s FROM part"
VIEWS["sku_locations"] = "SELECT s, unnest(range(1, 10)) AS l FROM sku_keys"

VIEWS["sku_master"] = """
SELECT 'P' || s AS sku_id,
  CASE WHEN s % 17 = 3 THEN 'DELIVERY' WHEN s % 23 = 5 THEN 'GASKETS' WHEN s % 29 = 7 THEN NULL ELSE p_name END
    AS description,
  brand, part_category, split_part(p_name, ' ', 2) AS sub_category,
  CASE s % 10 WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'B' WHEN 4 THEN 'B' ELSE 'C' END AS abc_class,
  CASE s % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' WHEN 2 THEN 'Z' END AS xyz_class,
  s % 20 <> 7 AS is_active, s % 9 = 0 AS is_dead_stock,
  CASE WHEN s % 31 <> 0 THEN DATE '2001-08-01' - CAST(s * 13 % 400 AS INTEGER) END AS last_sale_date,
  CAST(s * 3 % 25 AS DOUBLE) + 0.5::DOUBLE * (s % 2) AS avg_weekly_units,
  CASE WHEN s % 3 <> 0 THEN 'V' || (s % 100) END AS primary_supplier_id,
  CASE WHEN s % 5 <> 0 THEN CAST(CAST(round(retail * 100) AS BIGINT) * 60 * CAST(0.0001 AS DECIMAL(5,4))
    AS DECIMAL(12,4)) END AS unit_cost
FROM (SELECT p_partkey // 20 AS s, arg_min(p_name, p_partkey) AS p_name, arg_min(p_brand, p_partkey) AS brand,
    arg_min(p_type, p_partkey) AS part_category, min(p_retailprice) AS retail
  FROM part GROUP BY 1)
"""

VIEWS["locations"] = """
SELECT 'LOC-00' || l AS location_id, CASE WHEN l <> 6 THEN 'Store ' || l END AS location_name,
  CASE WHEN l <= 3 THEN 1 WHEN l <= 6 THEN 2 WHEN l <= 8 THEN 3 END AS location_tier, l <> 8 AS is_active
FROM (SELECT DISTINCT c_custkey % 9 + 1 AS l FROM customer)
"""

VIEWS["inventory"] = """
SELECT *, qty_on_hand <= 0 AS is_stockout FROM (
  SELECT 'P' || s AS sku_id, 'LOC-00' || l AS location_id, DATE '2001-08-01' - CAST(d AS INTEGER) AS snapshot_date,
    CAST((s * 7 + l * 13 + d * 5) % 40 - 2 AS DOUBLE) AS qty_on_hand,
    CASE WHEN (s + l + d) % 6 = 0 THEN 10::DOUBLE ELSE 0::DOUBLE END AS qty_on_order,
    CASE WHEN (s + l) % 19 <> 0 THEN CAST((s * 3 + l) % 30 + 1 AS DOUBLE) END AS reorder_point,
    CASE WHEN s % 7 <> 0 THEN CAST((s % 50 + 1) * 1.25::DOUBLE AS DECIMAL(12,4)) END AS unit_cost
  FROM (SELECT s, l, unnest(range(0, 90)) AS d FROM sku_locations))
"""

VIEWS["recommendations"] = """
SELECT 'P' || s AS sku_id, 'LOC-00' || l AS location_id, DATE '2001-08-01' - CAST(d AS INTEGER) AS recommendation_date,
  CAST((s + l + d) % 7 + 1 AS DOUBLE) AS qty_to_order,
  CASE WHEN (s + d) % 4 <> 0 AND src <> l THEN 'transfer' ELSE 'po' END AS recommendation_type,
  CASE WHEN (s + d) % 4 <> 0 AND src <> l THEN 'LOC-00' || src END AS transfer_from_location,
  CASE WHEN (s + d) % 4 = 0 OR src = l THEN 'V' || (s % 100) END AS supplier_id,
  ((s * 5 + l * 3 + d) % 90) / 4.0::DOUBLE AS days_of_supply_remaining,
  CASE WHEN ((s * 5 + l * 3 + d) % 90) < 12 THEN 'critical' WHEN ((s * 5 + l * 3 + d) % 90) < 28 THEN 'warning'
    ELSE 'normal' END AS urgency,
  (s + l + d) % 5 = 0 AS is_approved
FROM (SELECT *, (s + l) % 9 + 1 AS src FROM (SELECT s, l, unnest(range(0, 90)) AS d FROM sku_locations))
WHERE (s + l) % 10 > 2 AND ((s * l + d) % (3 + (s + l) % 40) = 0 OR ((s + l) % 13 = 0 AND d BETWEEN 20 AND 26))
"""

VIEWS["forecasts"] = """
SELECT 'P' || s AS sku_id, CASE WHEN l = 0 THEN 'ALL' ELSE 'LOC-00' || l END AS location_id,
  DATE '2001-08-01' + CAST(k AS INTEGER) AS forecast_date, model_type,
  DATE '2001-08-01' - CAST(age * 7 + s % 3 AS INTEGER) AS run_date,
  ((s * (l + 2) + k * 3 + age) % 9) / 4.0::DOUBLE * CASE WHEN l = 0 AND model_type = 'rolling_avg' THEN 9 ELSE 1 END
    AS predicted_qty
FROM (SELECT *, unnest(range(0, 30)) AS k FROM (SELECT *, unnest([0, 1]) AS age FROM (
  SELECT * FROM (SELECT s, l, unnest(['prophet', 'lightgbm', 'rolling_avg']) AS model_type FROM sku_locations)
  WHERE (model_type = 'prophet' AND (s + l) % 7 = 0) OR (model_type = 'lightgbm' AND (s + l) % 4 = 0)
    OR (model_type = 'rolling_avg' AND (s + l) % 3 = 0)
  UNION ALL
  SELECT * FROM (SELECT s, 0 AS l, unnest(['lightgbm', 'rolling_avg']) AS model_type FROM sku_keys)
  WHERE (model_type = 'lightgbm' AND s % 6 = 1) OR (model_type = 'rolling_avg' AND s % 2 = 0))))
WHERE (s + k) % 10 <> 9
"""

VIEWS["location_shares"] = """
SELECT 'P' || s AS sku_id, 'LOC-00' || l AS location_id, ((s + l) % 9 + 1) / 45.0::DOUBLE AS share,
  DATE '2001-08-01' - 1 AS run_date
FROM sku_locations WHERE s % 11 <> 0 AND NOT (s % 5 = 0 AND l = 9)
"""

VIEWS["weather"] = """
SELECT log_date, is_forecast, CASE WHEN doy % 29 <> 0 THEN CAST(doy * 37 % 80 - 10 AS DOUBLE) END AS temp_min_f,
  CAST(doy * 37 % 80 + 5 AS DOUBLE) AS temp_max_f, (doy * 13 % 50) / 100.0::DOUBLE AS precipitation_in,
  CASE WHEN doy * 37 % 80 < 42 THEN (doy % 7) / 10.0::DOUBLE ELSE 0::DOUBLE END AS snowfall_in
FROM (SELECT *, dayofyear(log_date) AS doy FROM (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS log_date, FALSE AS is_forecast FROM orders
  UNION ALL
  SELECT CAST(max(o_orderdate) AS DATE) + CAST(unnest(range(1, 8)) AS INTEGER) AS log_date, TRUE AS is_forecast
  FROM orders))
"""
