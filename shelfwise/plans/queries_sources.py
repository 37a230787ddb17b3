"""Registered queries: parsing and merging of landed rows, merges, exports and incremental loads.

The raw text rows are rendered from the driver tables, defects included, and parsed back."""

from __future__ import annotations

from datetime import timedelta
from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.operators import purchasing
from shelfwise.operators.common import latest_row
from shelfwise.plans import reports
from shelfwise.plans.catalog import AS_OF, frame, query
from shelfwise.session import settle, shared_folder
from shelfwise.sources import readers, sinks, versions
from shelfwise.streaming import incremental


@frame
def cube_rows(c):
    """Order lines as a cube would export them: everything text, some of it broken. Written once,
    as landed files would be, so that the rendering is no part of the parsing."""
    e = F.expr
    return settle(c["order_lines"].select(
        e("case when l_orderkey % 101 = 7 then 'n/a' when l_orderkey % 5 = 0 then cast(o_date as string)"
          " when l_orderkey % 7 = 0 then date_format(o_date, 'M/d/yyyy') else date_format(o_date, 'MM/dd/yyyy') end as sale_date"),
        e("case when o_custkey % 53 = 0 then 'HUB' else concat(o_custkey % 9 + 1, ' -CO - STORE') end as location"),
        e("concat(' ', sku_id) as part"),
        e("case when l_orderkey % 59 = 0 then 'none' else concat(qty_int, '0E-1 ') end as qty"),
        e("case when l_orderkey % 37 = 1 then '' else concat(cents div qty_int, 'E-2') end as price"),
        e("concat(cents, 'E-2') as revenue"),
        e("case l_orderkey % 4 when 0 then 'Y' when 1 then ' y' when 2 then 'N' end as warranty"),
        e("case l_linenumber % 3 when 0 then 'Y' when 1 then '-' end as backorder"),
        e("case when l_returnflag = 'R' then 'Y' else 'N' end as core_return"),
        e("case when l_discount >= 0.09D then 'Y' else '' end as price_override"),
        e("case when l_orderkey % 13 = 0 then concat('T0', o_custkey % 9 + 1, '0', (o_custkey + 4) % 9 + 1)"
          " when l_orderkey % 43 = 2 then '' else cast(l_orderkey as string) end as invoice"),
        e("case when o_custkey % 47 = 3 then '---' when (o_custkey + l_linenumber) % 11 = 0 then null"
          " else concat('C', o_custkey) end as customer"),
        e("case when o_custkey % 31 = 0 then '~' when (o_custkey + l_linenumber) % 7 = 0 then '' else concat('T', o_custkey % 5, ' ') end as customer_type"),
        e("case when l_linenumber % 4 = 0 then ' ' when o_custkey % 3 = 0 then 'Hold' else ' Active' end as customer_status"),
        e("case when (l_partkey + l_linenumber) % 6 = 0 then 'UNKNOWN' else concat('S', (o_custkey + l_linenumber) % 23) end as customer_salesman"),
        e("case when l_orderkey % 29 = 4 then '-' else concat(cents div 4 - l_linenumber * 100, 'E-2') end as gross_profit"),
        e("case when l_linenumber % 3 = 0 then cast(qty_int div 2 as string) end as backorder_qty"),
        e("case when l_suppkey % 8 = 1 then ' ' else concat('K', l_suppkey % 40, ' ') end as counterman"),
        e("case when l_returnflag = 'R' then 'SL-I - SALE-INTERCO' when l_returnflag = 'N' and l_linenumber = 2 then 'CR - CREDIT'"
          " else 'SL - SALE' end as tran"),
        e("concat(' C', o_custkey, '-') as ship_to"), e("case when l_linestatus = 'O' then 'n' else 'Y ' end as stock_flag"),
        e("case when o_custkey % 6 = 0 then '' else concat((o_custkey + l_partkey) % 9 + 1, '-CO - X') end as ship_location"),
        # Load order is unique, so "first" and "last" mean the same to every engine.
        e("struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, cents) as load_order")))


@query
def cube_sales(c):
    return readers.cube_sales(c["cube_rows"]).drop("load_order")


@query
def merged_sales(c):
    return readers.merge_sales(readers.cube_sales(c["cube_rows"]))


@query
def cube_detail(c):
    return readers.cube_detail(c["cube_rows"])


@query
def landed_margins(c):
    """The profit baselines of the locations, straight from parsed detail rows."""
    detail = readers.cube_detail(c["cube_rows"])
    base = purchasing.margin_baselines(detail, AS_OF - timedelta(days=365))
    return base.select("location_id", F.bround("avg_gp_pct", 6).alias("avg_gp_pct"))


@query
def intercompany_transfers(c):
    return readers.intercompany_transfers(c["cube_rows"])


@query
def invoice_routes(c):
    return readers.invoice_routes(c["cube_rows"])


@query
def snapshot_costs(c):
    raw = c["sku_locations"].select(
        F.expr("case when s % 41 = 5 then ' ' else concat('P', s) end as part"), F.expr("concat('LOC-00', l) as location_id"),
        F.expr("case when (s + l) % 8 = 0 then '' else cast((s * 7 + l) % 12 as string) end as on_hand"),
        F.expr("case when l % 2 = 0 then concat(s % 9, 'E0') end as on_order"),
        F.expr("case when (s + l) % 3 = 0 then concat(s % 50 + 1, '.25') when (s + l) % 3 = 1 then '0' end as unit_cost_on_hand"),
        F.expr("case when (s + l) % 4 = 0 then concat(s % 30, '.5') end as catalog_cost"),
        F.expr("case when (s + l) % 5 < 3 then concat((s * 3) % 90, '.75') end as ext_cost"),
        F.expr("case when (s + l) % 7 = 2 then 'n/a' else concat(s % 6, 'E0') end as min_qty"),
        F.expr("case when (s + l) % 9 = 4 then '' else concat(' ', s % 6 + l) end as max_qty"))
    return readers.snapshot_costs(raw, AS_OF)


@query
def enriched_products(c):
    part = c.raw("part").withColumn("sku_id", F.expr("concat('P', p_partkey div 4, ' ')"))
    order = F.col("p_partkey").alias("load_order")
    vendors = part.select("sku_id", F.expr("case when p_size = 3 then null when p_size % 4 = 0 then '' else concat(' V', p_size) end as vendor"), order)
    lines = part.select("sku_id", F.expr("case when p_size <= 5 then null when p_size % 3 = 0 then ' ' else p_type end as product_line"), order)
    texts = part.select("sku_id", F.expr("case when p_size % 5 = 0 then '---' when p_size % 7 = 0 then null else upper(p_name) end as ext_desc"),
                        F.expr("case when p_size % 2 = 0 then '~' else p_name end as prod_desc"),
                        F.expr("case when p_size % 6 = 0 then 'UNKNOWN' else 'EACH' end as uom"), order)
    return readers.enrich_products(vendors, lines, texts)


@query
def pricing_tiers(c):
    cents = "cast(round(p_retailprice * 100) as bigint)"
    cols = [F.expr(f"case when (p_partkey + {i}) % 6 = 0 then '0' when (p_partkey + {i}) % 7 = 0 then '' "
                   f"else concat({cents} + {i} * 25, 'E-2') end as price_{t}") for i, t in enumerate(readers.PRICE_TIERS)]
    cols += [F.expr(f"case when (p_partkey + {i}) % 4 <> 0 then concat({30 + i}, '.5') end as gp_{t}")
             for i, t in enumerate(readers.PRICE_TIERS)]
    wide = c.raw("part").select(F.expr("concat('P', p_partkey) as sku_id"), F.expr(f"concat({cents} * 6 div 10, 'E-2') as cost"), *cols)
    return readers.pricing_tiers(wide, AS_OF)


@query
def merged_customers(c):
    o = c.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    values = F.explode(F.array(
        F.struct(F.lit("salesman_id").alias("attribute"), F.expr("case when o_orderkey % 3 = 0 then '~' else concat('S', o_orderkey % 23) end").alias("value")),
        F.struct(F.lit("customer_type").alias("attribute"), F.expr("case when o_orderkey % 4 = 0 then 'N/A' else o_orderpriority end").alias("value")),
        F.struct(F.lit("customer_status").alias("attribute"), F.expr("case when o_orderkey % 5 = 0 then ' ' else o_orderstatus end").alias("value"))))
    rows = o.select(F.expr("case when o_custkey % 71 = 0 then 'UNKNOWN' else concat(' C', o_custkey) end as customer_id"),
                    values.alias("v"), F.col("o_orderkey").alias("load_order")).select("customer_id", "v.attribute", "v.value", "load_order")
    return readers.merge_customers(rows)


@frame
def weather_documents(c):
    """The weather as one document of parallel arrays per month."""
    days = c["weather"].withColumn("r", F.struct(
        "log_date", F.col("temp_max_f"), F.col("temp_min_f"), "precipitation_in", (F.col("snowfall_in") * 2.54).alias("cm")))
    return (days.groupBy("is_forecast", F.trunc("log_date", "MM").alias("m")).agg(F.array_sort(F.collect_list("r")).alias("a"))
            .select("m", "is_forecast", F.expr("transform(a, x -> cast(x.log_date as string)) as time"),
                    F.expr("transform(a, x -> x.temp_max_f) as temp_max"), F.expr("transform(a, x -> x.temp_min_f) as temp_min"),
                    F.expr("transform(a, x -> x.precipitation_in) as precipitation"), F.expr("transform(a, x -> x.cm) as snowfall_cm")))


@query
def parsed_weather(c):
    """Daily arrays of one document per month, back to rows."""
    return readers.weather_rows(c["weather_documents"].drop("m"))


@frame
def landed_weather_documents(c):
    """The documents as JSON files, some of them cut off, short of a value, without an array or with a day that is none."""
    place = F.year("m") * 12 + F.month("m")
    docs = c["weather_documents"].withColumns({
        "precipitation": F.when(place % 7 != 3, F.col("precipitation")).when(F.size("precipitation") > 1, F.slice("precipitation", 1, F.size("precipitation") - 1))
        .otherwise(F.array().cast("array<double>")),
        "snowfall_cm": F.when(place % 13 != 1, F.col("snowfall_cm")),
        "time": F.when(place % 11 != 2, F.col("time")).otherwise(F.concat(F.array(F.lit("31.02.")), F.slice("time", 2, F.greatest(F.size("time") - 1, F.lit(0))))),
        "place": place})
    text = F.to_json(F.struct(F.struct(*readers.DAILY).alias("daily"), "is_forecast"))
    folder = f"{shared_folder(c.spark)}/weather-{uuid4().hex}"
    cut = F.when(F.col("place") % 5 == 0, F.expr("left(j, cast(length(j) / 2 as int))")).otherwise(F.col("j"))
    docs.withColumn("j", text).select(cut.alias("value")).write.text(folder)
    return readers.checked_weather(readers.landed_documents(c.spark, folder))


@query
def landed_weather(c):
    """Rows of the landed documents that can be used."""
    return readers.accepted_weather(c["landed_weather_documents"])


@query
def quarantined_weather(c):
    """The other documents: why each was set aside, and that its text is kept."""
    return (readers.quarantined(c["landed_weather_documents"])
            .groupBy("reason").agg(F.count(F.lit(1)).alias("documents"), F.count("file").alias("with_file"),
                                   F.sum(F.col("document").contains("time").cast("long")).alias("with_text")))


def snapshot_export(c) -> str:
    """Snapshots as the CSV export of another system: its column names, blanks around cells, cells that do not parse,
    lines of blanks, a column that nothing maps. Gives its folder."""
    e = F.expr
    folder = f"{shared_folder(c.spark)}/csv-{uuid4().hex}"
    n = "cast(substr(sku_id, 2) as bigint) + day(snapshot_date)"
    (c["inventory"].select(
        e("concat(' ', sku_id, ' ') as PartNumber"), e("location_id as StoreID"),
        e(f"case when ({n}) % 3 = 0 then date_format(snapshot_date, 'M/d/yyyy') when ({n}) % 23 = 5 then 'n/a'"
          " else cast(snapshot_date as string) end as SnapshotDate"),
        e(f"case when ({n}) % 17 = 2 then '-' else concat(' ', cast(qty_on_hand as bigint), '.0') end as QtyOnHand"),
        e("cast(cast(qty_on_order as bigint) as string) as QtyOnOrder"), e("cast(reorder_point as string) as ReorderPoint"),
        e("'x' as Comment"))
     .unionByName(c["inventory"].where("snapshot_date = date'2001-08-01'").select(*[F.lit(" ").alias(x) for x in (
         "PartNumber", "StoreID", "SnapshotDate", "QtyOnHand", "QtyOnOrder", "ReorderPoint", "Comment")]))
     .write.option("header", True).csv(f"{folder}/inventory_snapshots.csv"))
    return folder


@query
def loaded_snapshots(c):
    """The landed CSV as stored rows: mapped, typed, with the stockout flag computed afresh."""
    rows = readers.load(c.spark, snapshot_export(c), "inventory_snapshots")
    return rows.select("sku_id", "location_id", "snapshot_date", *[F.col(x).cast("double").alias(x) for x in (
        "qty_on_hand", "qty_on_order", "reorder_point")], "is_stockout")


@query
def observed_weather(c):
    """Every order day once more as a forecast: the observation wins."""
    seen = c["weather"]
    again = seen.filter("not is_forecast").withColumns({"is_forecast": F.lit(True), "temp_max_f": F.lit(-99.0)})
    return readers.prefer_observed(seen.unionByName(again))


@query
def unregistered_skus(c):
    return readers.unregistered_skus(c["sales"], c["sku_master"].filter("is_active"))


@query
def upserted_recommendations(c):
    """Yesterday's queue with today's rows of the same pair replacing it."""
    keys = ["sku_id", "location_id"]
    day_rows = lambda d: c["recommendations"].filter(F.col("recommendation_date") == F.lit(AS_OF - timedelta(days=d)))
    return sinks.upsert(day_rows(1), day_rows(0), keys)


@query
def inserted_recommendations(c):
    keys = ["sku_id", "location_id"]
    day_rows = lambda d: c["recommendations"].filter(F.col("recommendation_date") == F.lit(AS_OF - timedelta(days=d)))
    return sinks.insert_absent(day_rows(1), day_rows(0), keys)


@query
def updated_master(c):
    """Last sale and weekly units refreshed in the master; unsold SKUs keep theirs."""
    master = c["sku_master"].select("sku_id", "last_sale_date", "avg_weekly_units", "abc_class")
    return sinks.update_columns(master, c["sku_metrics"], ["sku_id"], ["last_sale_date", "avg_weekly_units"])


@query
def retained_forecasts(c):
    expired = (F.col("model_type") == "prophet") & (F.col("run_date") < F.lit(AS_OF - timedelta(days=7)))
    return sinks.retain(c["forecasts"], expired)


@query
def latest_snapshots(c):
    return latest_row(c["inventory"].drop("is_stockout"), ["sku_id", "location_id"], ["snapshot_date"])


@query
def export_dead_stock(c):
    rows = reports.with_names(c["dead_stock"].filter("classification = 'LIQUIDATE' or classification = 'MARKDOWN'"), c["locations"], out="location_name")
    return sinks.export_rows(rows, ["sku_id", "location_id", "location_name", "classification", "action", "days_since_sale",
                                    "sale_frequency", "abc_class", "supplier_id"])


@query
def export_reorder(c):
    rows = reports.latest_recommendations(c["recommendations"]).filter("not is_approved")
    return sinks.export_rows(reports.with_names(rows, c["locations"], out="location_name"),
                             ["recommendation_date", "urgency", "recommendation_type", "sku_id", "location_id", "location_name",
                              "transfer_from_location", "qty_to_order", "supplier_id"])


@query
def export_transfers(c):
    return sinks.export_rows(reports.transfers_of_latest_run(c["recommendations"]),
                             ["recommendation_date", "sku_id", "transfer_from_location", "location_id", "qty_to_order", "urgency"])


@query
def export_understocking(c):
    return sinks.export_rows(c["chronic_understocking"], ["location_id", "sku_id", "sku_description", "days_observed", "days_below_reorder",
                                                         "network_flag", "double_confirmed"])


@query
def export_stocking_gaps(c):
    return sinks.export_rows(c["stocking_gaps_confirmed"], ["location_id", "sku_id", "transfer_from_location", "transfer_frequency",
                                                            "transfer_streak", "gap_classification", "trend_direction", "confidence"])


@query
def guarded_cells(c):
    """Text that starts like a formula, as a spreadsheet receives it."""
    lead = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "\t", "\r", "", "x")]), (F.col("p_size") % 8 + 1).cast("int"))
    rows = c.raw("part").select(F.col("p_partkey").cast("string").alias("part"), F.concat(lead, "p_name").alias("cell"))
    return sinks.export_rows(rows, ["part", "cell"])


STORED_ORDER = "o_orderkey bigint, location_id string, cents bigint, year date, order_date date, seq bigint"


@query
def streamed_orders(c):
    """Orders loaded by a file stream into a table by day, then loaded again: the second run finds
    nothing new and the table stays the same."""
    schema = StructType.fromDDL("o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz")
    base = f"{shared_folder(c.spark)}/orders-{uuid4().hex}"

    def shape(batch):
        return batch.select("o_orderkey", F.expr("concat('LOC-00', o_custkey % 9 + 1) as location_id"),
                            F.expr("cast(round(o_totalprice * 100) as bigint) as cents"), F.trunc(F.col("o_orderdate").cast("date"), "year").alias("year"),
                            F.col("o_orderdate").cast("date").alias("order_date"))

    for _ in range(2):
        versions.load_available(incremental.file_stream(c.spark, c.folder, schema, "orders.parquet"), f"{base}/table",
                                f"{base}/checkpoint", ["o_orderkey"], "year", "seq", lambda batch: shape(batch).withColumn("seq", F.lit(1).cast("long")))
    table = versions.read(c.spark, f"{base}/table", StructType.fromDDL(STORED_ORDER), "year")
    return table.groupBy("location_id", "order_date").agg(F.count(F.lit(1)).alias("orders"), F.sum("cents").alias("cents"))


@query
def reloaded_orders(c):
    """Orders stored by month, then corrected: every fifth is moved to another month with a new amount, and
    every seventh lands again late, in the state before the first load, and loses."""
    base = f"{shared_folder(c.spark)}/orders-{uuid4().hex}"
    seq = lambda df, n: df.withColumn("seq", F.lit(n).cast("long"))
    orders = (c.raw("orders").select("o_orderkey", F.expr("concat('LOC-00', o_custkey % 9 + 1) as location_id"),
                                     F.expr("cast(round(o_totalprice * 100) as bigint) as cents"), F.col("o_orderdate").cast("date").alias("order_date"))
              .withColumn("month", F.trunc("order_date", "month")))
    moved = orders.where("o_orderkey % 5 = 0").withColumns({"cents": F.col("cents") + 1, "month": F.add_months("month", 3)})
    late = orders.where("o_orderkey % 7 = 0").withColumns({"cents": F.lit(0).cast("long"), "month": F.add_months("month", -2)})
    for rows in (seq(orders, 2), seq(moved, 3), seq(late, 1)):
        versions.upsert(c.spark, rows, f"{base}/table", ["o_orderkey"], "month", "seq")
    table = versions.read(c.spark, f"{base}/table", seq(orders, 1).schema, "month")
    return table.groupBy("month", "seq").agg(F.count(F.lit(1)).alias("orders"), F.sum("cents").alias("cents"))


@query
def unique_events(c):
    """The events streamed with a bounded state of seen ids; counted per type."""
    schema = StructType.fromDDL("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    base = f"{shared_folder(c.spark)}/events-{uuid4().hex}"
    stream = incremental.file_stream(c.spark, c.folder, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    (incremental.unique_stream(stream, "event_id", "ts", "40 days").select("event_id", "event_type", "ts").writeStream
     .format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return (c.spark.read.parquet(f"{base}/table").groupBy("event_type")
            .agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids")))


@query
def late_events(c):
    """The events landed in three parts, each over the whole time: from the second on, what lies more than thirty days
    before the newest event seen is late. Counted per part and type; none is lost."""
    schema = StructType.fromDDL("event_id bigint, ts timestamp, event_type string, part bigint")
    base = f"{shared_folder(c.spark)}/late-{uuid4().hex}"
    events = c.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("event_id") % 3).alias("part"))
    for part in range(3):
        events.where(F.col("part") == part).write.mode("append").parquet(f"{base}/landed")
        incremental.load_with_late(incremental.file_stream(c.spark, f"{base}/landed", schema), base, f"{base}/checkpoint", "ts", timedelta(days=30))
    return (incremental.loaded_rows(c.spark, base).groupBy("part", "event_type")
            .agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("late").cast("long")).alias("late")))


@query
def rows_to_load(c):
    stored = c["sales"].filter(F.col("transaction_date") <= F.lit(AS_OF - timedelta(days=60)))
    new = incremental.rows_to_load(c["sales_detail"], stored, "tran_date", "transaction_date", AS_OF - timedelta(days=365))
    return new.groupBy("tran_date").agg(F.count(F.lit(1)).alias("rows"))


@query
def daily_load(c):
    return incremental.one_day(c["sales_detail"], "tran_date", AS_OF).select("transaction_id", "tran_date", "prod_line_pn", "qty_ship")


@query
def extended_streaks(c):
    """Streaks of the last days computed from the stored ones equal streaks over the whole history."""
    cut = F.lit(AS_OF - timedelta(days=40))
    stored = c["weather_streaks"].filter(F.col("log_date") < cut)
    return incremental.extend_streaks(stored, c["weather"].filter(F.col("log_date") >= cut))
