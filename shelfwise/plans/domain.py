"""Domain tables as views over the TPC-H-style driver tables.

Every table is derived from the whole of its source with integer arithmetic, so it grows with the
source and two engines agree on each value. Twenty consecutive parts form one SKU; a customer
belongs to one of nine locations. Where a view keeps only some of its grid (forecasts, shares,
recommendations), the gaps are the shape of the data: not every pair has a forecast or is ordered
every day. No query reads less than its whole view.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from shelfwise.operators.common import day, spread
from shelfwise.plans.catalog import AS_OF, frame

_SNAPSHOT_DAYS = 90


def _e(sql: str):
    return F.expr(sql)


@frame
def order_lines(c):
    """lineitem with its order: the parent of sales, detail and purchase rows."""
    li = c.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                  "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    o = c.raw("orders").select("o_orderkey", "o_custkey", _e("cast(o_orderdate as date) as o_date"))
    return (li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey")
            .withColumn("sku_id", _e("concat('P', l_partkey div 20)"))
            .withColumn("location_id", _e("concat('LOC-00', o_custkey % 9 + 1)"))
            .withColumn("ext", F.col("l_extendedprice").cast(DecimalType(12, 2)))
            .withColumn("disc", F.col("l_discount").cast(DecimalType(4, 2)))
            .withColumn("cents", _e("cast(round(l_extendedprice * 100) as bigint)"))
            .withColumn("qty_int", F.col("l_quantity").cast("long")))


@frame
def sales(c):
    return c["order_lines"].select(
        _e("concat('AC-', cast(o_date as string), '-', sku_id, '-', location_id, '-INV', l_orderkey)"
           " as transaction_id"),
        "sku_id", "location_id", F.col("o_date").alias("transaction_date"),
        _e("case when l_returnflag = 'R' and l_linenumber = 1 then -l_quantity else l_quantity end"
           " as qty_sold"),
        _e("case when l_orderkey % 37 = 1 then null"
           " else cast((cents * 100 div qty_int) * cast(0.0001 as decimal(5,4)) as decimal(12,4)) end"
           " as unit_price"),
        _e("cast(ext * (1 - disc) as decimal(14,4)) as total_revenue"),
        _e("(l_orderkey + l_linenumber) % 11 = 0 as is_stockout"),
        _e("case when (l_orderkey + l_linenumber) % 11 = 0 and l_partkey % 3 <> 0"
           " then l_quantity * 0.5D end as lost_sales_imputation"),
        _e("(l_orderkey * 7 + l_linenumber) % 97 = 0 as is_anomaly"),
        _e("(l_partkey + l_orderkey) % 53 = 0 as is_residual_demand"),
        _e("l_orderkey % 41 = 5 as is_warranty"),
        _e("l_returnflag = 'R' and l_linenumber = 1 as is_core_return"),
        _e("l_linestatus = 'O' and l_orderkey % 29 = 3 as is_backorder"),
        _e("case when l_orderkey % 43 = 2 then null else cast(l_orderkey as string) end as invoice_number"),
        _e("case when o_custkey % 47 = 3 then null else concat('C', o_custkey) end as customer_id"),
        _e("case when o_custkey % 4 = 0 then 'COMMERCIAL' else 'RETAIL' end as customer_type"),
        _e("case when o_custkey % 17 = 0 then 'INACTIVE' when o_custkey % 19 = 0 then 'closed'"
           " when o_custkey % 5 = 0 then null else 'ACTIVE' end as customer_status"),
        _e("concat('S', (o_custkey + l_linenumber) % 5) as salesman_id"),
        "l_linenumber")


@frame
def sales_detail(c):
    return (c["order_lines"]
            .withColumn("sales", _e("cast(ext * (1 - disc) as decimal(14,4))"))
            .withColumn("cost_share", _e("cast(50 + 2 * (l_partkey % 10)"
                                         " + case when o_date >= date_sub(date'2001-08-01', 7) and l_partkey % 3 = 0"
                                         " then 25 else 0 end as decimal(4,0))"))
            .select(
                _e("concat(l_orderkey, '-', l_linenumber, '-', l_partkey) as transaction_id"),
                F.col("o_date").alias("tran_date"), "location_id",
                _e("case when l_returnflag = 'R' then 'SL-I' else 'SL' end as tran_code"),
                _e("case when o_custkey % 3 = 0 then concat('C', o_custkey, '-')"
                   " when o_custkey % 3 = 1 then concat('C', o_custkey, '-JOB', o_custkey % 7)"
                   " else concat('C', o_custkey) end as ship_to"),
                F.col("sku_id").alias("prod_line_pn"),
                F.col("l_quantity").alias("qty_ship"), "sales",
                _e("cast(sales - ext * cost_share * cast(0.01 as decimal(3,2)) as decimal(14,4)) as gross_profit"),
                _e("case when l_linestatus = 'O' then 'N' else 'Y' end as stock_flag"),
                _e("concat('S', (o_custkey + l_linenumber) % 5) as salesman_id")))


@frame
def purchase_orders(c):
    return (c["order_lines"]
            .withColumn("status", _e("case (l_orderkey + l_linenumber) % 10 when 0 then 'open'"
                                     " when 1 then 'cancelled' when 2 then 'partial' else 'received' end"))
            .select(
                F.col("l_orderkey").alias("po_number"), F.col("l_linenumber").alias("line_number"), "sku_id",
                _e("concat('V', l_suppkey) as supplier_id"), "location_id", F.col("o_date").alias("po_date"),
                _e("date_add(o_date, 14) as expected_delivery_date"),
                _e("case when status in ('received', 'partial') then date_add(o_date, cast(7 + l_orderkey % 15"
                   " + case when l_suppkey % 7 = 0 then 20 else 0 end as int)) end as actual_delivery_date"),
                F.col("l_quantity").alias("qty_ordered"),
                _e("case when status in ('open', 'cancelled') then 0D when status = 'partial' then l_quantity / 2"
                   " when l_partkey % 11 = 0 then l_quantity * 1.25D"
                   " when (l_partkey + l_suppkey) % 5 <> 0 then l_quantity else l_quantity / 2 end as qty_received"),
                _e("cast((cents * 65 div qty_int) * cast(0.0001 as decimal(5,4)) as decimal(12,4)) as unit_cost"),
                "status"))


@frame
def sku_keys(c):
    # A SKU is a few bytes here and up to 810 rows in the grids below: adaptive execution would merge all into one
    # task. Spread before they are distinct: the planner drops a repartition by the keys of an aggregate below it.
    return spread(c.raw("part").select(_e("p_partkey div 20 as s")), ["s"]).distinct()


@frame
def sku_locations(c):
    """Every (sku, location) pair as integers."""
    return c["sku_keys"].select("s", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("l"))


@frame
def sku_master(c):
    part = c.raw("part")
    return (part.groupBy(_e("p_partkey div 20 as s"))
            .agg(F.min_by("p_name", "p_partkey").alias("p_name"), F.min_by("p_brand", "p_partkey").alias("brand"),
                 F.min_by("p_type", "p_partkey").alias("part_category"), F.min("p_retailprice").alias("retail"))
            .select(
                _e("concat('P', s) as sku_id"),
                _e("case when s % 17 = 3 then 'DELIVERY' when s % 23 = 5 then 'GASKETS'"
                   " when s % 29 = 7 then null else p_name end as description"),
                "brand", "part_category", _e("split(p_name, ' ')[1] as sub_category"),
                _e("case s % 10 when 0 then 'A' when 1 then 'A' when 2 then 'B' when 3 then 'B' when 4 then 'B'"
                   " else 'C' end as abc_class"),
                _e("case s % 4 when 0 then 'X' when 1 then 'Y' when 2 then 'Z' end as xyz_class"),
                _e("s % 20 <> 7 as is_active"), _e("s % 9 = 0 as is_dead_stock"),
                _e("case when s % 31 <> 0 then date_sub(date'2001-08-01', cast(s * 13 % 400 as int)) end"
                   " as last_sale_date"),
                _e("cast(s * 3 % 25 as double) + 0.5D * (s % 2) as avg_weekly_units"),
                _e("case when s % 3 <> 0 then concat('V', s % 100) end as primary_supplier_id"),
                _e("case when s % 5 <> 0 then cast(cast(round(retail * 100) as bigint) * 60"
                   " * cast(0.0001 as decimal(5,4)) as decimal(12,4)) end as unit_cost")))


@frame
def locations(c):
    return (c.raw("customer").groupBy(_e("c_custkey % 9 + 1 as l")).agg(F.count(F.lit(1)).alias("n"))
            .select(_e("concat('LOC-00', l) as location_id"),
                    _e("case when l <> 6 then concat('Store ', l) end as location_name"),
                    _e("case when l <= 3 then 1 when l <= 6 then 2 when l <= 8 then 3 end as location_tier"),
                    _e("l <> 8 as is_active")))


@frame
def inventory(c):
    """90 daily snapshots of every (sku, location)."""
    grid = c["sku_locations"].select("s", "l", F.explode(F.sequence(F.lit(0), F.lit(_SNAPSHOT_DAYS - 1))).alias("d"))
    return grid.select(
        _e("concat('P', s) as sku_id"), _e("concat('LOC-00', l) as location_id"),
        _e("date_sub(date'2001-08-01', d) as snapshot_date"),
        _e("cast((s * 7 + l * 13 + d * 5) % 40 - 2 as double) as qty_on_hand"),
        _e("case when (s + l + d) % 6 = 0 then 10D else 0D end as qty_on_order"),
        _e("case when (s + l) % 19 <> 0 then cast((s * 3 + l) % 30 + 1 as double) end as reorder_point"),
        _e("case when s % 7 <> 0 then cast((s % 50 + 1) * 1.25D as decimal(12,4)) end as unit_cost")
    ).withColumn("is_stockout", F.col("qty_on_hand") <= 0)


@frame
def recommendations(c):
    """90 days of recommendation history (transfers and purchase orders)."""
    grid = c["sku_locations"].select("s", "l", F.explode(F.sequence(F.lit(0), F.lit(_SNAPSHOT_DAYS - 1))).alias("d"))
    return (grid.withColumn("src", _e("(s + l) % 9 + 1"))
            .filter("(s + l) % 10 > 2 and ((s * l + d) % (3 + (s + l) % 40) = 0"
                    " or ((s + l) % 13 = 0 and d between 20 and 26))")
            .select(
                _e("concat('P', s) as sku_id"), _e("concat('LOC-00', l) as location_id"),
                _e("date_sub(date'2001-08-01', d) as recommendation_date"),
                _e("cast((s + l + d) % 7 + 1 as double) as qty_to_order"),
                _e("case when (s + d) % 4 <> 0 and src <> l then 'transfer' else 'po' end as recommendation_type"),
                _e("case when (s + d) % 4 <> 0 and src <> l then concat('LOC-00', src) end"
                   " as transfer_from_location"),
                _e("case when (s + d) % 4 = 0 or src = l then concat('V', s % 100) end as supplier_id"),
                _e("((s * 5 + l * 3 + d) % 90) / 4.0D as days_of_supply_remaining"),
                _e("case when ((s * 5 + l * 3 + d) % 90) < 12 then 'critical'"
                   " when ((s * 5 + l * 3 + d) % 90) < 28 then 'warning' else 'normal' end as urgency"),
                _e("(s + l + d) % 5 = 0 as is_approved")))


@frame
def forecasts(c):
    """Stored forecast rows of three models, two runs, per location and network-wide ('ALL')."""
    k = F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k")
    pairs = c["sku_locations"].select("s", "l", F.explode(F.array(*[F.lit(m) for m in (
        "prophet", "lightgbm", "rolling_avg")])).alias("model_type"))
    local = pairs.filter("(model_type = 'prophet' and (s + l) % 7 = 0) or (model_type = 'lightgbm' and (s + l) % 4 = 0)"
                         " or (model_type = 'rolling_avg' and (s + l) % 3 = 0)")
    network = (c["sku_keys"].select("s", F.lit(0).alias("l"), F.explode(F.array(
        F.lit("lightgbm"), F.lit("rolling_avg"))).alias("model_type"))
        .filter("(model_type = 'lightgbm' and s % 6 = 1) or (model_type = 'rolling_avg' and s % 2 = 0)"))
    runs = local.unionByName(network).select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("age"))
    return (runs.select("*", k)
            .filter("(s + k) % 10 <> 9")
            .select(
                _e("concat('P', s) as sku_id"),
                _e("case when l = 0 then 'ALL' else concat('LOC-00', l) end as location_id"),
                _e("date_add(date'2001-08-01', k) as forecast_date"), "model_type",
                _e("date_sub(date'2001-08-01', cast(age * 7 + s % 3 as int)) as run_date"),
                _e("((s * (l + 2) + k * 3 + age) % 9) / 4.0D"
                   " * case when l = 0 and model_type = 'rolling_avg' then 9 else 1 end as predicted_qty")))


@frame
def location_shares(c):
    """Stored demand shares; some SKUs have none, some miss one location."""
    return (c["sku_locations"].filter("s % 11 <> 0 and not (s % 5 = 0 and l = 9)")
            .select(_e("concat('P', s) as sku_id"), _e("concat('LOC-00', l) as location_id"),
                    _e("((s + l) % 9 + 1) / 45.0D as share"), day(AS_OF, -1).alias("run_date")))


@frame
def weather(c):
    """One row per order date, plus a seven-day forecast after the newest."""
    days = c.raw("orders").select(_e("cast(o_orderdate as date) as log_date")).distinct()
    ahead = (days.agg(F.max("log_date").alias("top"))
             .select(F.explode(F.sequence(F.date_add("top", 1), F.date_add("top", 7))).alias("log_date"),
                     F.lit(True).alias("is_forecast")))
    both = days.withColumn("is_forecast", F.lit(False)).unionByName(ahead)
    return (both.withColumn("doy", F.dayofyear("log_date"))
            .select("log_date", "is_forecast",
                    _e("case when doy % 29 <> 0 then cast(doy * 37 % 80 - 10 as double) end as temp_min_f"),
                    _e("cast(doy * 37 % 80 + 5 as double) as temp_max_f"),
                    _e("(doy * 13 % 50) / 100.0D as precipitation_in"),
                    _e("case when doy * 37 % 80 < 42 then (doy % 7) / 10.0D else 0D end as snowfall_in")))
