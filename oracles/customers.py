"""SQL twins of the customer queries."""

from oracles import VIEWS

D = "DATE '2001-08-01'"

VIEWS["churn_scores"] = f"""
SELECT customer_id, {D} AS run_date, customer_type, customer_status, order_count_90d, order_count_30d, order_count_prior_60d,
  round_even(r30 + rp, 2)::DOUBLE AS revenue_90d, round_even(r30, 2)::DOUBLE AS revenue_30d,
  round_even(rp, 2)::DOUBLE AS revenue_prior_60d, days AS days_since_last_order, round_even(rec, 2)::DOUBLE AS recency_score,
  round_even(fr, 2)::DOUBLE AS frequency_score, round_even(mon, 2)::DOUBLE AS monetary_score,
  round_even(score, 2)::DOUBLE AS churn_score,
  CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier, score >= 70 AS at_risk_flag
FROM (SELECT *, 0.40::DOUBLE * rec + 0.30::DOUBLE * fr + 0.30::DOUBLE * mon AS score
  FROM (SELECT *, least(100, 100 * days / 50.0::DOUBLE) AS rec,
      CASE WHEN order_count_prior_60d = 0 THEN 50
        ELSE least(100, 100 * greatest(0, 1 - order_count_30d / (order_count_prior_60d / (245 / 120.0::DOUBLE)))) END::DOUBLE AS fr,
      CASE WHEN rp <= 0 THEN 50 ELSE least(100, 100 * greatest(0, 1 - r30 / (rp / (245 / 120.0::DOUBLE)))) END::DOUBLE AS mon
    FROM (SELECT customer_id, min(customer_type) AS customer_type, min(customer_status) AS customer_status,
        count(DISTINCT k) AS order_count_90d, count(DISTINCT k) FILTER (WHERE transaction_date >= {D} - 120) AS order_count_30d,
        count(DISTINCT k) FILTER (WHERE transaction_date < {D} - 120) AS order_count_prior_60d,
        coalesce(sum(total_revenue) FILTER (WHERE transaction_date >= {D} - 120), 0)::DOUBLE AS r30,
        coalesce(sum(total_revenue) FILTER (WHERE transaction_date < {D} - 120), 0)::DOUBLE AS rp,
        CAST({D} - max(transaction_date) AS INTEGER) AS days, max(transaction_date) - min(transaction_date) AS span
      FROM (SELECT *, coalesce(invoice_number, transaction_id) AS k FROM sales
        WHERE NOT is_anomaly AND NOT is_residual_demand AND NOT is_warranty AND NOT is_core_return AND customer_id IS NOT NULL
          AND coalesce(upper(customer_status), '') NOT IN ('INACTIVE', 'CLOSED', 'DELETED')
          AND transaction_date BETWEEN {D} - 365 AND {D})
      GROUP BY 1) WHERE order_count_90d >= 3 AND span >= 30))
"""
VIEWS["churn_buckets"] = f"""
SELECT customer_id, location_id, bool_or(job) AS is_commercial,
  coalesce(sum(sales) FILTER (WHERE tran_date BETWEEN {D} - 730 AND {D} - 190), 0)::DOUBLE AS baseline_sales,
  count(*) FILTER (WHERE tran_date BETWEEN {D} - 730 AND {D} - 190) AS baseline_tx,
  count(DISTINCT date_trunc('month', tran_date)) FILTER (WHERE tran_date BETWEEN {D} - 730 AND {D} - 190) AS baseline_months,
  coalesce(sum(sales) FILTER (WHERE tran_date >= {D} - 90), 0)::DOUBLE AS comparison_sales, max(tran_date) AS last_purchase_date
FROM (SELECT *, trim(split_part(ship_to, '-', 1)) AS customer_id, trim(split_part(ship_to, '-', 2)) <> '' AS job
  FROM sales_detail WHERE tran_date >= {D} - 730) WHERE customer_id <> '' GROUP BY 1, 2
"""
VIEWS["modal_salesman"] = f"""
SELECT customer_id, location_id, salesman_id FROM (SELECT customer_id, location_id, salesman_id, row_number() OVER (
    PARTITION BY customer_id, location_id ORDER BY count(*) DESC, salesman_id) AS r
  FROM sales WHERE transaction_date >= {D} - 90 AND customer_id IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1
"""
VIEWS["churn_flags"] = f"""
SELECT x.customer_id, x.location_id, is_commercial, s.salesman_id, round_even(monthly, 4)::DOUBLE AS baseline_monthly_spend,
  round_even(comparison_sales, 4)::DOUBLE AS last_90_days_spend,
  CASE WHEN comparison_sales = 0 THEN -100 ELSE round_even(pct, 2) END::DOUBLE AS pct_change,
  CASE WHEN comparison_sales = 0 THEN seg WHEN pct <= -30 THEN 'DECLINING' ELSE 'STABLE' END AS flag,
  CASE WHEN comparison_sales = 0 THEN seg END AS risk_segment, days AS days_since_last_purchase, last_purchase_date
FROM (SELECT *, (comparison_sales - monthly * 3) / (monthly * 3) * 100 AS pct,
    CASE WHEN days > 365 THEN 'LOST' WHEN days > 180 THEN 'CHURNED' ELSE 'AT_RISK' END AS seg
  FROM (SELECT *, baseline_sales / 18 AS monthly, CAST({D} - last_purchase_date AS INTEGER) AS days FROM churn_buckets)
  WHERE baseline_tx >= 3 AND monthly >= 333 AND baseline_months >= 3) x
LEFT JOIN modal_salesman s ON s.customer_id = x.customer_id AND s.location_id = x.location_id
"""
