"""SQL twins of the demand and forecast queries."""

from oracles import VIEWS

D = "DATE '2001-08-01'"

VIEWS["training_demand"] = """
SELECT *, CASE WHEN is_stockout THEN coalesce(lost_sales_imputation, 0) ELSE coalesce(qty_sold, 0) END AS d
FROM sales WHERE NOT is_anomaly AND NOT is_residual_demand AND NOT is_warranty
"""


def _daily(days: int) -> str:
    return f"""
SELECT sku_id, location_id, transaction_date AS day, sum(d) AS demand,
  sum(CASE WHEN d > 0 THEN d ELSE 0 END)::DOUBLE AS positive, max(CASE WHEN d > 0 THEN 1 ELSE 0 END)::INTEGER AS sold
FROM training_demand WHERE transaction_date BETWEEN {D} - {days} AND {D} GROUP BY 1, 2, 3
"""


VIEWS["daily_demand"] = _daily(730)
VIEWS["demand_91"] = _daily(91)

VIEWS["lost_sales_imputation"] = """
SELECT s.transaction_id, s.sku_id, s.location_id, s.transaction_date, coalesce(round_even(p.v, 2), 0)::DOUBLE AS lost_sales_imputation
FROM sales s LEFT JOIN (
  SELECT a.sku_id, a.location_id, a.transaction_date, sum(b.q) / sum(b.n)::DOUBLE AS v
  FROM (SELECT DISTINCT sku_id, location_id, transaction_date FROM sales WHERE is_stockout) a
  JOIN (SELECT sku_id, location_id, transaction_date, sum(qty_sold) AS q, count(*) AS n FROM sales WHERE NOT is_stockout
    GROUP BY 1, 2, 3) b
    ON a.sku_id = b.sku_id AND a.location_id <> b.location_id
    AND abs(a.transaction_date - b.transaction_date) <= 30
  GROUP BY 1, 2, 3) p
  ON p.sku_id = s.sku_id AND p.location_id = s.location_id AND p.transaction_date = s.transaction_date
WHERE s.is_stockout
"""

VIEWS["rolling_forecast_pairs"] = f"""
SELECT sku_id, location_id, {D} + CAST(unnest(range(0, 30)) AS INTEGER) AS forecast_date, 'rolling_avg' AS model_type,
  round_even(blend, 4)::DOUBLE AS predicted_qty, round_even(greatest(0, m - sd), 4)::DOUBLE AS lower_bound,
  round_even(m + sd, 4)::DOUBLE AS upper_bound, 0.6827::DOUBLE AS confidence_pct, {D} AS run_date
FROM (SELECT p.*, CASE WHEN coalesce(l.location_tier, 2) = 3 AND coalesce(q.demand_quality_score, 1) < 0.5
    THEN 0.40::DOUBLE * coalesce(r.regional, m) + 0.60::DOUBLE * m ELSE m END AS blend
  FROM (SELECT sku_id, location_id, s / 91 AS m, sqrt(greatest(ss / 91 - (s / 91) * (s / 91), 0)) AS sd, n
    FROM (SELECT sku_id, location_id, coalesce(sum(demand) FILTER (WHERE day < {D}), 0) AS s,
        coalesce(sum(demand * demand) FILTER (WHERE day < {D}), 0) AS ss,
        count(*) FILTER (WHERE day < {D} AND sold = 1) AS n
      FROM demand_91 GROUP BY 1, 2)) p
  LEFT JOIN locations l ON l.location_id = p.location_id
  LEFT JOIN demand_quality q ON q.sku_id = p.sku_id AND q.location_id = p.location_id
  LEFT JOIN (SELECT sku_id, avg(sm / 91) AS regional FROM (
      SELECT sku_id, location_id, coalesce(sum(demand) FILTER (WHERE day < {D}), 0) AS sm FROM demand_91 GROUP BY 1, 2) x
    JOIN (SELECT location_id AS l2, location_tier FROM locations) t ON t.l2 = x.location_id
    WHERE coalesce(location_tier, 2) <= 2 GROUP BY 1) r ON r.sku_id = p.sku_id
  WHERE n >= 2)
"""

VIEWS["rolling_forecast_network"] = f"""
SELECT sku_id, 'ALL' AS location_id, {D} + CAST(unnest(range(0, 30)) AS INTEGER) AS forecast_date,
  'rolling_avg' AS model_type, round_even(m, 4)::DOUBLE AS predicted_qty,
  round_even(greatest(0, m - sd), 4)::DOUBLE AS lower_bound, round_even(m + sd, 4)::DOUBLE AS upper_bound,
  0.6827::DOUBLE AS confidence_pct, {D} AS run_date
FROM (SELECT sku_id, s / 91 AS m, sqrt(greatest(ss / 91 - (s / 91) * (s / 91), 0)) AS sd
  FROM (SELECT sku_id, sum(demand) AS s, sum(demand * demand) AS ss, count(*) FILTER (WHERE sold = 1) AS n
    FROM (SELECT sku_id, day, sum(demand) AS demand, max(sold) AS sold FROM demand_91 WHERE day < {D} GROUP BY 1, 2)
    GROUP BY 1) WHERE n >= 3)
"""

VIEWS["demand_shares"] = f"""
SELECT sku_id, location_id, round_even(q / sum(q) OVER (PARTITION BY sku_id), 6)::DOUBLE AS share, {D} AS run_date
FROM (SELECT sku_id, location_id, sum(positive) AS q FROM demand_91 WHERE day < {D} GROUP BY 1, 2 HAVING sum(positive) > 0)
WHERE sku_id IN (SELECT sku_id FROM demand_91 WHERE day < {D} AND sold = 1 GROUP BY 1 HAVING count(DISTINCT day) >= 3)
"""

_FRESH = f"SELECT sku_id FROM forecasts WHERE model_type = 'prophet' AND run_date >= {D} - 7"
VIEWS["rolling_targets"] = f"""
SELECT sku_id FROM sku_master WHERE abc_class = 'C' OR (abc_class = 'A' AND sku_id NOT IN ({_FRESH}))
"""
VIEWS["rolling_targets_covered"] = f"SELECT sku_id FROM sku_master WHERE abc_class = 'A' AND sku_id IN ({_FRESH})"


def _seasonal(value: str) -> str:
    return f"""
SELECT m.sku_id, round_even({value}, 4)::DOUBLE AS rank_value FROM sku_master m LEFT JOIN (
  SELECT prod_line_pn, sum(gross_profit)::DOUBLE AS gp FROM sales_detail
  WHERE tran_date >= {D} - 90 AND tran_code IN ('SL', 'SL-I') GROUP BY 1 HAVING sum(gross_profit) > 0) g
  ON g.prod_line_pn = m.sku_id
WHERE m.abc_class = 'A'
"""


VIEWS["seasonal_targets"] = _seasonal("coalesce(g.gp, 0)")
VIEWS["seasonal_targets_by_volume"] = _seasonal(
    "CASE WHEN coalesce(m.unit_cost, 0) > 0 THEN m.avg_weekly_units * m.unit_cost::DOUBLE ELSE m.avg_weekly_units END")

VIEWS["flat_forecast"] = f"""
SELECT sku_id, location_id, {D} + CAST(unnest(range(0, 30)) AS INTEGER) AS forecast_date, 'prophet' AS model_type,
  round_even(m, 4)::DOUBLE AS predicted_qty, round_even(m * (1 - 0.3::DOUBLE), 4)::DOUBLE AS lower_bound,
  round_even(m * (1 + 0.3::DOUBLE), 4)::DOUBLE AS upper_bound, 0.95::DOUBLE AS confidence_pct, {D} AS run_date
FROM (SELECT sku_id, location_id, greatest(0, coalesce(avg(demand) FILTER (WHERE day >= {D} - 28), avg(demand))) AS m
  FROM daily_demand WHERE day < {D} GROUP BY 1, 2)
"""

VIEWS["weather_streaks"] = """
SELECT * EXCLUDE (cold, island), coalesce(temp_min_f < 32 AND temp_max_f >= 32, FALSE) AS freeze_thaw_cycle,
  sum(cold) OVER (PARTITION BY island ORDER BY log_date)::INTEGER AS consecutive_freeze_days
FROM (SELECT *, sum(1 - cold) OVER (ORDER BY log_date) AS island
  FROM (SELECT *, CASE WHEN coalesce(temp_min_f < 32, FALSE) THEN 1 ELSE 0 END AS cold FROM weather))
"""
VIEWS["feature_skus"] = "SELECT sku_id FROM sku_master WHERE abc_class = 'B'"
VIEWS["feature_demand"] = f"""
SELECT sku_id, location_id, transaction_date AS day, sum(d) AS demand FROM training_demand
WHERE transaction_date BETWEEN {D} - 365 AND {D} - 1 AND sku_id IN (SELECT sku_id FROM feature_skus) GROUP BY 1, 2, 3
"""
VIEWS["feature_calendar"] = f"""
SELECT p.sku_id, p.location_id, CAST(p.dt AS DATE) AS day, last_day,
  CASE WHEN p.dt < {D} THEN coalesce(f.demand, 0) ELSE recent END AS v
FROM (SELECT e.sku_id, e.location_id, last_day, sum(CASE WHEN day > last_day - 28 THEN demand ELSE 0 END)
      / least(28, max(last_day - first_day) + 1)::DOUBLE AS recent,
    unnest(generate_series(min(day), {D} + 29, INTERVAL 1 DAY)) AS dt
  FROM feature_demand d JOIN (SELECT sku_id, location_id, min(day) AS first_day, max(day) AS last_day FROM feature_demand
    GROUP BY 1, 2) e ON e.sku_id = d.sku_id AND e.location_id = d.location_id GROUP BY 1, 2, 3) p
LEFT JOIN feature_demand f ON f.sku_id = p.sku_id AND f.location_id = p.location_id AND f.day = p.dt
"""
VIEWS["feature_weather"] = f"""
SELECT log_date, coalesce(temp_min_f, 32) AS t, freeze_thaw_cycle::INTEGER::DOUBLE AS ft, coalesce(snowfall_in, 0) AS sn,
  consecutive_freeze_days::DOUBLE AS cf FROM weather_streaks WHERE log_date >= {D} - 365
"""
VIEWS["forecast_features"] = f"""
SELECT c.sku_id, c.location_id, c.day, CASE WHEN c.day <= last_day THEN v END AS target,
  (isodow(c.day) - 1)::DOUBLE AS day_of_week, weekofyear(c.day)::DOUBLE AS week_of_year, month(c.day)::DOUBLE AS month,
  round(lag_7, 6) AS lag_7, round(lag_14, 6) AS lag_14, round(lag_28, 6) AS lag_28,
  round(m7, 6) AS rolling_mean_7, round(m28, 6) AS rolling_mean_28,
  round(coalesce(w.t, k.t), 6) AS temp_min_f, round(coalesce(w.ft, k.ft), 6) AS freeze_thaw_cycle,
  round(coalesce(w.sn, k.sn), 6) AS snowfall_in, round(coalesce(w.cf, k.cf), 6) AS consecutive_freeze_days, coalesce(q.demand_quality_score, 1)::DOUBLE AS demand_quality_score,
  CASE m.xyz_class WHEN 'X' THEN 0 WHEN 'Z' THEN 2 ELSE 1 END::DOUBLE AS xyz_code
FROM (SELECT *, coalesce(lag(v, 7) OVER w, 0) AS lag_7, coalesce(lag(v, 14) OVER w, 0) AS lag_14,
    coalesce(lag(v, 28) OVER w, 0) AS lag_28,
    coalesce(sum(v) OVER (PARTITION BY sku_id, location_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) / 7 AS m7,
    coalesce(sum(v) OVER (PARTITION BY sku_id, location_id ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 0) / 28 AS m28
  FROM feature_calendar WINDOW w AS (PARTITION BY sku_id, location_id ORDER BY day)) c
LEFT JOIN feature_weather w ON w.log_date = c.day
CROSS JOIN (SELECT avg(t) AS t, avg(ft) AS ft, avg(sn) AS sn, avg(cf) AS cf FROM feature_weather WHERE log_date <= {D}) k
LEFT JOIN demand_quality q ON q.sku_id = c.sku_id AND q.location_id = c.location_id
LEFT JOIN sku_master m ON m.sku_id = c.sku_id
"""
