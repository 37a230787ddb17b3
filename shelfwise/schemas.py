"""Stored tables: schema, key, generated columns and value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "sku_master": """sku_id string, description string, brand string, part_category string, sub_category string,
        unit_of_measure string, abc_class string, xyz_class string, abc_xyz_class string, cv_score decimal(8,4),
        is_active boolean, is_dead_stock boolean, weather_sensitivity_score decimal(6,4), last_sale_date date,
        avg_weekly_units decimal(12,4), primary_supplier_id string, unit_cost decimal(12,4), gp_12m decimal(14,4),
        accuracy_score decimal(8,2)""",
    "sales_transactions": """transaction_id string, sku_id string, location_id string, transaction_date date,
        qty_sold decimal(12,4), unit_price decimal(12,4), total_revenue decimal(14,4), is_stockout boolean,
        lost_sales_imputation decimal(12,4), is_anomaly boolean, is_residual_demand boolean, is_backorder boolean,
        is_core_return boolean, is_warranty boolean, is_price_override boolean, invoice_number string,
        customer_id string, customer_type string, customer_status string, customer_salesman string""",
    "sales_detail_transactions": """transaction_id string, tran_date date, location_id string, tran_code string,
        ship_to string, prod_line_pn string, qty_ship decimal(12,4), sales decimal(14,4), gross_profit decimal(14,4),
        backorder_qty decimal(12,4), stock_flag string, salesman_id string""",
    "inventory_snapshots": """sku_id string, location_id string, snapshot_date date, qty_on_hand decimal(12,4),
        qty_on_order decimal(12,4), is_stockout boolean, reorder_point decimal(12,4), reorder_qty decimal(12,4),
        unit_cost decimal(12,4)""",
    "purchase_orders": """po_number string, line_number int, sku_id string, supplier_id string, location_id string,
        po_date date, expected_delivery_date date, actual_delivery_date date, qty_ordered decimal(12,4),
        qty_received decimal(12,4), unit_cost decimal(12,4), status string, lead_time_variance int,
        fill_rate_pct decimal(6,4)""",
    "weather_log": """log_date date, temp_max_f decimal(6,2), temp_min_f decimal(6,2), precipitation_in decimal(8,4),
        snowfall_in decimal(8,4), consecutive_freeze_days int, freeze_thaw_cycle boolean, is_forecast boolean""",
    "forecast_results": """sku_id string, location_id string, forecast_date date, model_type string,
        predicted_qty decimal(12,4), lower_bound decimal(12,4), upper_bound decimal(12,4), confidence_pct decimal(6,4),
        actual_qty_sold decimal(12,4), mape_error decimal(10,4), run_date date""",
    "location_transfers": """transfer_date date, sku_id string, from_location_id string, to_location_id string,
        tran_code string, qty_transferred decimal(12,4), transfer_value decimal(14,2)""",
    "customer_master": "customer_id string, salesman_id string, customer_type string, customer_status string",
}

KEYS: dict[str, list[str]] = {
    "sku_master": ["sku_id"], "sales_transactions": ["transaction_id"], "sales_detail_transactions": ["transaction_id"],
    "inventory_snapshots": ["sku_id", "location_id", "snapshot_date"], "purchase_orders": ["po_number", "line_number"],
    "weather_log": ["log_date"], "customer_master": ["customer_id"],
    "forecast_results": ["sku_id", "location_id", "forecast_date", "model_type", "run_date"],
    "location_transfers": ["transfer_date", "sku_id", "from_location_id", "to_location_id", "tran_code"],
}

# Columns computed from others; never read from a source.
GENERATED: dict[str, tuple[str, ...]] = {
    "inventory_snapshots": ("is_stockout",), "purchase_orders": ("lead_time_variance", "fill_rate_pct"),
}

# Source column per stored column in the CSV exports (fixed values).
COLUMN_MAPS: dict[str, dict[str, str]] = {
    "sku_master": {"sku_id": "PartNumber", "description": "Description", "brand": "Brand", "part_category": "Category",
                   "sub_category": "SubCategory", "unit_of_measure": "UnitOfMeasure"},
    "sales_transactions": {"transaction_id": "TransactionID", "sku_id": "PartNumber", "location_id": "StoreID",
                           "transaction_date": "SaleDate", "qty_sold": "QtySold", "unit_price": "UnitPrice",
                           "total_revenue": "TotalRevenue", "is_stockout": "IsStockout",
                           "lost_sales_imputation": "LostSalesEstimate"},
    "inventory_snapshots": {"sku_id": "PartNumber", "location_id": "StoreID", "snapshot_date": "SnapshotDate",
                            "qty_on_hand": "QtyOnHand", "qty_on_order": "QtyOnOrder", "reorder_point": "ReorderPoint",
                            "reorder_qty": "ReorderQty"},
    "purchase_orders": {"po_number": "PONumber", "line_number": "LineNumber", "sku_id": "PartNumber",
                        "supplier_id": "SupplierID", "location_id": "StoreID", "po_date": "PODate",
                        "expected_delivery_date": "ExpectedDelivery", "actual_delivery_date": "ActualDelivery",
                        "qty_ordered": "QtyOrdered", "qty_received": "QtyReceived", "unit_cost": "UnitCost",
                        "status": "Status"},
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def rules(table: str) -> dict[str, Column]:
    """CHECK constraints of a stored table."""
    c = F.col
    known = {
        "purchase_orders": {"status": c("status").isin("open", "received", "partial", "cancelled"),
                            "qty_received": c("qty_received") >= 0},
        "data_quality_issues": {"severity": c("severity").isin("warning", "error")},
        "alerts": {"severity": c("severity").isin("critical", "warning", "info")},
        "sku_location_share": {"share": c("share").between(0, 1)},
        "customer_churn_scores": {"risk_tier": c("risk_tier").isin("HIGH", "MEDIUM", "LOW"),
                                  "churn_score": c("churn_score").between(0, 100),
                                  "recency_score": c("recency_score").between(0, 100)},
        "customer_churn_flags": {"flag": c("flag").isin("AT_RISK", "CHURNED", "LOST", "DECLINING", "STABLE")},
        "reorder_recommendations": {"recommendation_type": c("recommendation_type").isin("po", "transfer", "basket_triggered"),
                                    "urgency": c("urgency").isin("critical", "warning", "normal")},
        "supplier_scores": {"risk_flag": c("risk_flag").isin("green", "amber", "red")},
    }
    return known.get(table, {})


def with_generated(df: DataFrame, table: str) -> DataFrame:
    from shelfwise.operators.classify import fill_rate
    if table == "inventory_snapshots":
        return df.withColumn("is_stockout", F.col("qty_on_hand") <= 0)
    if table == "purchase_orders":
        return df.withColumns({
            "lead_time_variance": F.datediff("actual_delivery_date", "expected_delivery_date"),
            "fill_rate_pct": fill_rate(F.col("qty_received"), F.col("qty_ordered"))})
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Stored columns in order, cast to their types; columns the frame lacks become null."""
    fields = schema(table).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in fields])
