"""SQL twins of the classification queries."""

from oracles import VIEWS

D = "DATE '2001-08-01'"

VIEWS["abc_revenue"] = f"""
SELECT coalesce(m.sku_id, r.sku_id) AS sku_id, coalesce(r.revenue, 0.0)::DOUBLE AS revenue,
  CASE WHEN i < a THEN 'A' WHEN i < greatest(a + 1, round_even(n * 0.5::DOUBLE, 0)) THEN 'B' ELSE 'C' END AS abc_class
FROM sku_master m FULL JOIN (
  SELECT *, row_number() OVER (ORDER BY revenue DESC, sku_id) - 1 AS i, count(*) OVER () AS n,
    greatest(1, round_even(count(*) OVER () * 0.2::DOUBLE, 0)) AS a
  FROM (SELECT sku_id, sum(total_revenue)::DOUBLE AS revenue FROM sales
    WHERE transaction_date BETWEEN {D} - 90 AND {D} GROUP BY 1)) r ON m.sku_id = r.sku_id
"""

VIEWS["xyz_class"] = f"""
SELECT sku_id, x AS xyz_class, abc_class || x AS abc_xyz_class, round_even(cv, 4)::DOUBLE AS cv_score FROM (
  SELECT *, CASE WHEN coalesce(active, 0) < 4 THEN NULL WHEN cv IS NULL THEN 'Z' WHEN cv < 0.5 THEN 'X'
    WHEN cv < 1.0 THEN 'Y' ELSE 'Z' END AS x
  FROM (SELECT m.sku_id, m.abc_class, active,
      CASE WHEN active >= 4 AND s <> 0 THEN sqrt(greatest(0, ss / 13 - (s / 13) * (s / 13))) / (s / 13) END AS cv
    FROM sku_master m LEFT JOIN (
      SELECT sku_id, count(*) FILTER (WHERE q > 0) AS active, coalesce(sum(q) FILTER (WHERE listed), 0) AS s,
        coalesce(sum(q * q) FILTER (WHERE listed), 0) AS ss
      FROM (SELECT sku_id, sum(qty_sold) AS q, date_trunc('week', transaction_date) IN (
          SELECT date_trunc('week', {D} - 90 + CAST(7 * unnest(range(0, 13)) AS INTEGER))) AS listed
        FROM sales WHERE transaction_date BETWEEN {D} - 90 AND {D}
        GROUP BY sku_id, date_trunc('week', transaction_date))
      GROUP BY 1) w ON m.sku_id = w.sku_id))
"""

VIEWS["supplier_scores"] = f"""
SELECT supplier_id, {D} AS score_date, round_even(fill, 4)::DOUBLE AS fill_rate_pct,
  round_even(lead, 2)::DOUBLE AS avg_lead_time_days, round_even(var, 2)::DOUBLE AS lead_time_variance_avg,
  round_even(ontime, 4)::DOUBLE AS on_time_delivery_pct, round_even(score, 2)::DOUBLE AS composite_score,
  CASE WHEN score > 80 THEN 'green' WHEN score >= 60 THEN 'amber' ELSE 'red' END AS risk_flag
FROM (SELECT *, fill * 100 * 0.40::DOUBLE + coalesce(ontime * 100, 50.0)::DOUBLE * 0.40::DOUBLE
    + greatest(0::DOUBLE, 100 - coalesce(var, 0)::DOUBLE * 10) * 0.20::DOUBLE AS score
  FROM (SELECT supplier_id,
      coalesce(avg(least(qty_received / qty_ordered, 1)) FILTER (WHERE status IN ('received', 'partial') AND qty_ordered > 0), 0)
        ::DOUBLE AS fill,
      avg(actual_delivery_date - po_date) AS lead, avg(abs(actual_delivery_date - expected_delivery_date)) AS var,
      avg(CASE WHEN actual_delivery_date <= expected_delivery_date THEN 1 WHEN actual_delivery_date IS NOT NULL THEN 0 END)
        AS ontime
    FROM purchase_orders WHERE po_date >= {D} - 90 GROUP BY 1))
"""

VIEWS["weather_sensitivity"] = f"""
SELECT m.sku_id, round_even(r, 4)::DOUBLE AS weather_sensitivity_score
FROM sku_master m JOIN (
  SELECT part_category, corr(t, q) AS r FROM (
    SELECT part_category, transaction_date, sum(qty_sold) AS q FROM sales JOIN sku_master USING (sku_id)
    WHERE transaction_date BETWEEN {D} - 730 AND {D} GROUP BY 1, 2) d
  JOIN (SELECT log_date, temp_min_f AS t FROM weather WHERE NOT is_forecast AND temp_min_f IS NOT NULL) w
    ON w.log_date = d.transaction_date
  GROUP BY 1 HAVING count(*) >= 5) c USING (part_category)
WHERE r IS NOT NULL
"""

VIEWS["sku_metrics"] = f"""
SELECT sku_id, max(transaction_date) AS last_sale_date,
  round_even(sum(qty_sold) / (365 / 7.0::DOUBLE), 2)::DOUBLE AS avg_weekly_units
FROM sales WHERE transaction_date BETWEEN {D} - 365 AND {D} GROUP BY 1
"""
VIEWS["sku_metrics_resumed"] = """
SELECT * FROM sku_metrics WHERE sku_id NOT IN (SELECT sku_id FROM sku_master WHERE last_sale_date IS NOT NULL)
"""

VIEWS["location_tiers"] = f"""
SELECT location_id, CASE WHEN i < ceil(n / 3.0) THEN 1 WHEN i < ceil(n / 3.0) + floor(n / 3.0) THEN 2 ELSE 3 END
    AS location_tier,
  round_even(f, 4)::DOUBLE AS fill_rate_score, round_even(v, 4)::DOUBLE AS revenue_score,
  round_even(b, 4)::DOUBLE AS sku_breadth_score, round_even(1 - r, 4)::DOUBLE AS return_rate_score,
  round_even(score, 4)::DOUBLE AS composite_tier_score
FROM (SELECT *, row_number() OVER (ORDER BY score DESC, location_id) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT *, 0.40::DOUBLE * f + 0.30::DOUBLE * v + 0.20::DOUBLE * b + 0.10::DOUBLE * (1 - r) AS score
    FROM (SELECT location_id,
        CASE WHEN fhi = flo THEN 0.5 ELSE (fill - flo) / (fhi - flo) END AS f,
        CASE WHEN vhi = vlo THEN 0.5 ELSE (volume - vlo) / (vhi - vlo) END AS v,
        CASE WHEN bhi = blo THEN 0.5 ELSE (breadth - blo) / (bhi - blo) END AS b,
        CASE WHEN rhi = rlo THEN 0.5 ELSE (returns - rlo) / (rhi - rlo) END AS r
      FROM (SELECT *, min(fill) OVER () AS flo, max(fill) OVER () AS fhi, min(volume) OVER () AS vlo,
          max(volume) OVER () AS vhi, min(breadth) OVER () AS blo, max(breadth) OVER () AS bhi,
          min(returns) OVER () AS rlo, max(returns) OVER () AS rhi
        FROM (SELECT s.location_id, volume, breadth, returns, coalesce(fill, 0.5)::DOUBLE AS fill
          FROM (SELECT location_id, sum(greatest(qty_sold, 0)) AS volume, count(DISTINCT sku_id)::DOUBLE AS breadth,
              count(*) FILTER (WHERE qty_sold < 0) / count(*)::DOUBLE AS returns
            FROM sales WHERE transaction_date BETWEEN {D} - 180 AND {D} GROUP BY 1) s
          LEFT JOIN (SELECT location_id, avg(least(qty_received / qty_ordered, 1)) AS fill FROM purchase_orders
            WHERE qty_ordered > 0 GROUP BY 1) p ON p.location_id = s.location_id)))))
"""

VIEWS["residual_demand"] = f"""
SELECT s.transaction_id, s.sku_id, s.location_id, s.transaction_date, s.qty_sold, round_even(b.baseline, 4)::DOUBLE AS baseline
FROM sales s
JOIN (SELECT sku_id, snapshot_date FROM inventory WHERE is_stockout AND snapshot_date >= {D} - 180
  GROUP BY 1, 2 HAVING count(DISTINCT location_id) >= 2) h ON h.sku_id = s.sku_id AND h.snapshot_date = s.transaction_date
JOIN (SELECT sku_id, location_id, avg(qty_sold) AS baseline FROM sales
  WHERE transaction_date >= {D} - 90 AND qty_sold > 0 GROUP BY 1, 2) b
  ON b.sku_id = s.sku_id AND b.location_id = s.location_id
WHERE s.qty_sold > 0 AND s.qty_sold >= 2 * b.baseline AND NOT EXISTS (
  SELECT 1 FROM inventory i WHERE i.is_stockout AND i.sku_id = s.sku_id AND i.location_id = s.location_id
    AND i.snapshot_date = s.transaction_date)
"""

VIEWS["demand_quality"] = f"""
SELECT sku_id, location_id, round_even(1 - count(*) FILTER (WHERE is_residual_demand) / count(*)::DOUBLE, 3)::DOUBLE
    AS demand_quality_score,
  count(*) FILTER (WHERE NOT is_residual_demand) AS organic_sale_count,
  count(*) FILTER (WHERE is_residual_demand) AS residual_sale_count, count(*) AS total_sale_count
FROM sales WHERE transaction_date BETWEEN {D} - 730 AND {D} GROUP BY 1, 2
"""

VIEWS["recent_gross_profit"] = f"""
SELECT prod_line_pn AS sku_id, location_id, sum(gross_profit::DOUBLE * w) AS gp_weighted,
  sum(gross_profit)::DOUBLE AS gp_12m, sum(sales)::DOUBLE AS sales_12m, sum(qty_ship * w) AS qty_weighted
FROM (SELECT *, pow(0.9::DOUBLE, least(greatest(datediff('month', tran_date, {D}), 0), 11)) AS w FROM sales_detail
  WHERE tran_date BETWEEN {D} - 372 AND {D} AND tran_code IN ('SL', 'SL-I'))
GROUP BY 1, 2
"""


def _by_profit(metric: str) -> str:
    return f"""
SELECT sku_id, CASE WHEN i < a THEN 'A' WHEN i < a + b THEN 'B' ELSE 'C' END AS abc_class, old_class,
  round_even(gp, 4)::DOUBLE AS gp_12m
FROM (SELECT *, row_number() OVER (ORDER BY round(metric, 6) DESC, sku_id) - 1 AS i,
    greatest(1, round_even(count(*) OVER () * 0.1::DOUBLE, 0)) AS a,
    greatest(1, round_even(count(*) OVER () * 0.2::DOUBLE, 0)) AS b
  FROM (SELECT m.sku_id, m.abc_class AS old_class, coalesce({metric}, 0) AS metric, coalesce(gp, 0) AS gp
    FROM sku_master m LEFT JOIN (SELECT sku_id, sum(gp_weighted) AS gpw, sum(qty_weighted) AS qw, sum(gp_12m) AS gp
      FROM recent_gross_profit GROUP BY 1) p ON p.sku_id = m.sku_id))
"""


VIEWS["abc_gross_profit"] = _by_profit("gpw")
VIEWS["abc_weighted_volume"] = _by_profit("qw")
VIEWS["abc_by_location"] = """
SELECT r.sku_id, location_id, CASE WHEN i < a THEN 'A' WHEN i < a + b THEN 'B' ELSE 'C' END AS abc_class, m.xyz_class,
  round_even(gp_12m, 4)::DOUBLE AS gp_12m, round_even(sales_12m, 4)::DOUBLE AS sales_12m
FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY round(gp_weighted, 6) DESC, sku_id) - 1 AS i,
    greatest(1, round_even(count(*) OVER (PARTITION BY location_id) * 0.1::DOUBLE, 0)) AS a,
    greatest(1, round_even(count(*) OVER (PARTITION BY location_id) * 0.2::DOUBLE, 0)) AS b
  FROM recent_gross_profit) r LEFT JOIN sku_master m ON m.sku_id = r.sku_id
"""
VIEWS["abc_class_changes"] = "SELECT old_class, abc_class, count(*) AS skus FROM abc_gross_profit GROUP BY ALL"
VIEWS["generated_columns"] = """
SELECT po_number, line_number, sku_id, qty_ordered, CAST(actual_delivery_date - expected_delivery_date AS INTEGER)
  AS lead_time_variance, least(qty_received / qty_ordered, 1)::DOUBLE AS fill_rate_pct
FROM purchase_orders
"""
VIEWS["dead_tail_skus"] = f"""
SELECT sku_id, last_sale_date FROM sku_master
WHERE is_active AND NOT (is_dead_stock AND (last_sale_date IS NULL OR last_sale_date < {D} - 180))
"""
