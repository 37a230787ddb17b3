"""Sources: landed files to typed domain rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType

from shelfwise import params, schemas
from shelfwise.functions import parsing as p
from shelfwise.operators.common import first_row, num

CUSTOMER_FIELDS = ("customer_id", "customer_type", "customer_status", "customer_salesman")
PRICE_TIERS = ("1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "A", "B", "C", "S", "ST")


def read_csv(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """All columns as trimmed text; an absent file gives an empty frame with the mapped columns."""
    path = f"{folder.rstrip('/')}/{dataset}.csv"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path):
        columns = schemas.COLUMN_MAPS.get(dataset, {}).values()
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) or "value string")
    df = spark.read.option("header", True).csv(path)
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns])


def read_source(spark: SparkSession, fmt: str, location: str, dataset: str, **options: str) -> DataFrame:
    """One entry for all sources: 'csv' folders, Spark file formats, or 'jdbc' (location is the URL)."""
    if fmt == "csv":
        return read_csv(spark, location, dataset)
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(url=location, dbtable=dataset, **options).load()
    return spark.read.format(fmt).options(**options).load(f"{location.rstrip('/')}/{dataset}")


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, column: str, parts: int, quote: str = '"', **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of a number, date or timestamp column, each by a connection of its
    own. The database gives the bounds; filters and column choices on the result are sent to it. Rows without a
    value are in the first range; a table without any value is one range. ``quote`` is the database's mark around names."""
    source = spark.read.format("jdbc").options(url=url, **options)
    named = f"{quote}{column}{quote}"
    ends = f"(select min({named}) as lo, max({named}) as hi from {table}) ends"
    (lo, hi), = source.option("dbtable", ends).load().collect()  # at most one row
    source = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if lo is not None and lo != hi:
        source = source.options(partitionColumn=column, lowerBound=str(lo), upperBound=str(hi), numPartitions=parts)
    return source.load()


def map_columns(df: DataFrame, dataset: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Source names to stored names; unmapped columns go, missing ones are left out."""
    mapping = mapping or schemas.COLUMN_MAPS[dataset]
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in mapping.items() if src in df.columns])


def typed(df: DataFrame, dataset: str) -> DataFrame:
    """Text to the stored types. Values that do not parse become null, rows of nulls only and
    generated columns go, and generated columns are computed afresh."""
    def cast(name, dtype):
        c = F.col(name)
        if isinstance(dtype, StringType):
            return F.nullif(F.trim(c), F.lit(""))
        if isinstance(dtype, BooleanType):
            return p.boolean(c)
        if isinstance(dtype, DateType):
            return p.iso_date(c)
        return p.number(c).try_cast(dtype) if isinstance(dtype, NumericType) else c

    skip = schemas.GENERATED.get(dataset, ())
    fields = [f for f in schemas.schema(dataset).fields if f.name in df.columns and f.name not in skip]
    out = df.select(*[cast(f.name, f.dataType).alias(f.name) for f in fields]).dropna("all")
    return schemas.with_generated(out, dataset)


def load(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    return typed(map_columns(read_csv(spark, folder, dataset), dataset), dataset)


def cube_sales(raw: DataFrame) -> DataFrame:
    """Cube rows (all text) to sales rows; rows without a readable date are left out."""
    x = raw.withColumn("d", p.iso_date(F.col("sale_date"))).filter("d is not null")
    loc, sku, inv = p.location_code(F.col("location")), F.trim("part"), F.trim("invoice")
    flags = {f"is_{k}": p.yes(F.col(k)) for k in ("warranty", "backorder", "core_return", "price_override")}
    return x.select(p.sale_id(F.col("d"), sku, loc, inv).alias("transaction_id"), sku.alias("sku_id"), loc.alias("location_id"),
                    F.col("d").alias("transaction_date"), p.number(F.col("qty")).alias("qty_sold"),
                    p.number(F.col("price")).alias("unit_price"), p.number(F.col("revenue")).alias("total_revenue"),
                    *[v.alias(k) for k, v in flags.items()], F.nullif(inv, F.lit("")).alias("invoice_number"),
                    p.meaningful(F.col("customer")).alias("customer_id"),
                    *[p.meaningful(F.col(c)).alias(c) for c in CUSTOMER_FIELDS[1:]], "load_order")


def merge_sales(rows: DataFrame) -> DataFrame:
    """One row per transaction id: sums, the last known price, any-true flags, and each customer field
    from the first row that knows it. ``conflicts`` counts the fields on which rows of the id disagree."""
    flags = [c for c in rows.columns if c.startswith("is_")]
    order = F.col("load_order")
    priced = F.when(F.col("unit_price").isNotNull(), F.struct(order, "unit_price"))
    fields = [c for c in CUSTOMER_FIELDS if c in rows.columns]
    disagree = sum((F.coalesce(F.min(c) != F.max(c), F.lit(False)).cast("int") for c in fields), F.lit(0))
    return (rows.groupBy("transaction_id")
            .agg(F.first("sku_id").alias("sku_id"), F.first("location_id").alias("location_id"),
                 F.first("transaction_date").alias("transaction_date"), F.first("invoice_number").alias("invoice_number"),
                 F.sum(num("qty_sold")).alias("qty_sold"), F.bround(F.sum(num("total_revenue")), 4).alias("total_revenue"),
                 F.max(priced).alias("p"), *[F.bool_or(f).alias(f) for f in flags], F.count(F.lit(1)).alias("lines"),
                 *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields], disagree.alias("conflicts"))
            .select("transaction_id", "sku_id", "location_id", "transaction_date", "invoice_number", "qty_sold",
                    "total_revenue", F.col("p.unit_price").alias("unit_price"), *flags,
                    *fields, "lines", "conflicts"))


def cube_detail(raw: DataFrame) -> DataFrame:
    """Detail rows of the sale codes with a date and a location; the first of equal ids is kept. Flags keep
    their whole text."""
    x = (raw.withColumn("code", p.tran_code(F.col("tran"))).filter(F.col("code").isin(*params.SALE_CODES))
         .withColumn("d", p.iso_date(F.col("sale_date"))).withColumn("loc", p.location_code(F.col("location")))
         .filter("d is not null and loc <> ''"))
    ship, part = F.trim("ship_to"), F.trim("part")
    rows = x.select(p.detail_id(F.col("d"), F.col("loc"), F.col("code"), ship, part).alias("transaction_id"),
                    F.col("d").alias("tran_date"), F.col("loc").alias("location_id"), F.col("code").alias("tran_code"),
                    F.nullif(ship, F.lit("")).alias("ship_to"), F.nullif(part, F.lit("")).alias("prod_line_pn"),
                    F.nullif(F.upper(F.trim("stock_flag")), F.lit("")).alias("stock_flag"),
                    F.bround(p.number(F.col("qty")), 4).alias("qty_ship"), F.bround(p.number(F.col("revenue")), 4).alias("sales"),
                    F.bround(p.number(F.col("gross_profit")), 4).alias("gross_profit"),
                    F.bround(p.number(F.col("backorder_qty")), 4).alias("backorder_qty"),
                    F.nullif(F.trim("counterman"), F.lit("")).alias("salesman_id"), "load_order")
    return first_row(rows, ["transaction_id"], ["load_order"]).drop("load_order")


def snapshot_costs(raw: DataFrame, as_of: date) -> DataFrame:
    """Inventory rows; cost on hand, then catalogue cost, then extended cost over quantity."""
    on_hand = F.coalesce(p.number(F.col("on_hand")), F.lit(0.0))
    own, listed, ext = (p.number(F.col(c)) for c in ("unit_cost_on_hand", "catalog_cost", "ext_cost"))
    cost = (F.when(own > 0, own).when(listed > 0, listed)
            .when((ext != 0) & (on_hand > 0), F.bround(ext / F.when(on_hand > 0, on_hand), 4)).otherwise(own))
    return raw.filter(F.trim("part") != "").select(
        F.trim("part").alias("sku_id"), "location_id", F.lit(as_of).alias("snapshot_date"), on_hand.alias("qty_on_hand"),
        F.coalesce(p.number(F.col("on_order")), F.lit(0.0)).alias("qty_on_order"), F.bround(cost, 4).alias("unit_cost"),
        p.number(F.col("min_qty")).alias("reorder_point"), p.number(F.col("max_qty")).alias("reorder_qty"))


def enrich_products(vendors: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Vendor, product line, description and unit merged by SKU. A rowset may repeat a SKU: the
    last row wins."""
    tokens = ("~", "---", "UNKNOWN")

    def last(df: DataFrame, cols: list[str]) -> DataFrame:
        return df.groupBy("sku_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("load_order"))).alias(c) for c in cols])

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("sku_id", F.trim("sku_id")).filter(F.col("sku_id") != "")

    v = last(keyed(vendors).withColumn("primary_supplier_id", F.nullif(F.trim("vendor"), F.lit(""))), ["primary_supplier_id"])
    line = last(keyed(lines).withColumn("product_line", F.nullif(F.trim("product_line"), F.lit(""))), ["product_line"])
    text = keyed(texts).filter(~F.col("sku_id").isin(*tokens)).withColumns({
        "description": F.coalesce(p.meaningful(F.col("ext_desc"), tokens), p.meaningful(F.col("prod_desc"), tokens)),
        "unit_of_measure": p.meaningful(F.col("uom"), tokens)})
    return (v.join(line, "sku_id", "full").join(last(text, ["description", "unit_of_measure"]), "sku_id", "full")
            .dropna("all", subset=["primary_supplier_id", "product_line", "description", "unit_of_measure"]))


def pricing_tiers(wide: DataFrame, as_of: date, tiers: tuple[str, ...] = PRICE_TIERS) -> DataFrame:
    """Price and margin columns of each tier as rows; tiers without a price are left out."""
    pairs = F.array(*[F.struct(F.lit(t).alias("price_tier"), p.number(F.col(f"price_{t}")).alias("v"),
                               p.number(F.col(f"gp_{t}")).alias("g")) for t in tiers])
    return (wide.filter(F.trim("sku_id") != "").select(F.trim("sku_id").alias("sku_id"), p.number(F.col("cost")).alias("c"),
                                                      F.explode(pairs).alias("t"))
            .filter("t.v is not null and t.v <> 0")
            .select("sku_id", "t.price_tier", F.bround("t.v", 4).alias("price_value"), F.bround("t.g", 4).alias("gp_margin_pct"),
                    F.bround("c", 4).alias("unit_cost"), F.lit(as_of).alias("snapshot_date")))


def merge_customers(attributes: DataFrame) -> DataFrame:
    """(customer, attribute, value) rows to one row per customer; the last meaningful value wins."""
    x = attributes.withColumn("customer_id", p.meaningful(F.col("customer_id"))).filter("customer_id is not null")
    value = p.meaningful(F.col("value"))

    def pick(name: str):
        return F.max_by(value, F.when((F.col("attribute") == name) & value.isNotNull(), F.col("load_order")))

    g = x.groupBy("customer_id").agg(*[pick(a).alias(a) for a in ("salesman_id", "customer_type", "customer_status")])
    return g.select("customer_id", "salesman_id", "customer_type",
                    "customer_status")


def intercompany_transfers(raw: DataFrame) -> DataFrame:
    """Rows whose code ends in '-I', summed by day, SKU, ends and code. A sum of nulls stays null."""
    code, qty = p.tran_code(F.col("tran")), p.number(F.col("qty"))
    sender = p.location_code(F.nullif(F.trim("location"), F.lit("")))
    receiver = F.coalesce(p.location_code(F.nullif(F.trim("ship_location"), F.lit(""))), sender)
    x = raw.filter(F.trim("part") != "").select(
        p.iso_date(F.col("sale_date")).alias("transfer_date"), F.trim("part").alias("sku_id"), sender.alias("from_location_id"),
        receiver.alias("to_location_id"), code.alias("tran_code"), qty.alias("q"), p.number(F.col("revenue")).alias("v"))
    kept = x.filter(F.col("tran_code").endswith("-I") & (F.col("q") != 0) & F.col("from_location_id").isNotNull()
                    & F.col("transfer_date").isNotNull())
    return (kept.groupBy("transfer_date", "sku_id", "from_location_id", "to_location_id", "tran_code")
            .agg(F.bround(F.sum("q"), 4).alias("qty_transferred"), F.bround(F.sum("v"), 2).alias("transfer_value")))


def invoice_routes(sales: DataFrame) -> DataFrame:
    """Transfers recognised by their invoice number, counted per route."""
    a, b = p.transfer_ends(F.col("invoice"))
    return (sales.select(a.alias("from_location_id"), b.alias("to_location_id"), p.number(F.col("qty")).alias("q"))
            .filter("from_location_id is not null").groupBy("from_location_id", "to_location_id")
            .agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("qty")))


DAILY = ("time", "temp_max", "temp_min", "precipitation", "snowfall_cm")
WEATHER_DOCUMENT = ("is_forecast boolean, daily struct<time: array<string>, temp_max: array<double>, temp_min: array<double>,"
                    " precipitation: array<double>, snowfall_cm: array<double>>")


def landed_documents(spark: SparkSession, folder: str, schema: str = WEATHER_DOCUMENT, whole_files: bool = False) -> DataFrame:
    """JSON documents, one a line or one a file, as columns of ``schema`` beside their ``_text``, their ``_file`` and,
    where the text is not such a document, ``_unreadable``. Blank lines are no documents."""
    lines = spark.read.text(folder, wholetext=whole_files).select("value", F.col("_metadata.file_path").alias("_file"))
    parsed = F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return (lines.where(F.trim("value") != "").select(F.col("value").alias("_text"), "_file", parsed.alias("d"))
            .select("d.*", "_text", "_file").withColumn("_unreadable", F.col("_broken").isNotNull()).drop("_broken"))


def checked_weather(documents: DataFrame) -> DataFrame:
    """``reason`` says why a landed weather document cannot be used; null where it can. A document is used whole or
    not at all, so a day is never made of values of different days."""
    sizes = [F.col(f"daily.{n}") for n in DAILY]
    unequal = F.lit(False)
    for a in sizes[1:]:
        unequal = unequal | ~F.size(a).eqNullSafe(F.size(sizes[0]))
    missing = F.lit(False)
    for a in sizes:
        missing = missing | a.isNull()
    bad_day = F.exists(sizes[0], lambda t: t.try_cast("date").isNull())
    return documents.withColumn("reason", F.when(F.col("_unreadable"), "unreadable").when(missing, "missing array")
                                .when(unequal, "unequal arrays").when(bad_day, "unreadable day"))


def accepted_weather(checked: DataFrame) -> DataFrame:
    return weather_rows(checked.where("reason is null").select("is_forecast", "daily.*"))


def quarantined(checked: DataFrame) -> DataFrame:
    """Refused documents with their reason, file and whole text, to be stored and landed again once mended."""
    return checked.where("reason is not null").select("reason", F.col("_file").alias("file"), F.col("_text").alias("document"))


def weather_rows(documents: DataFrame) -> DataFrame:
    """Documents of parallel daily arrays to one row per day. Arrays of unequal length fail the job:
    ``checked_weather`` sets such documents aside first."""
    names = DAILY
    same = F.lit(True)
    for n in names[1:]:
        same = same & (F.size(n) == F.size("time"))
    checked = documents.withColumn("time", F.when(same, F.col("time")).otherwise(F.raise_error(F.lit("arrays of unequal length"))))
    x = checked.select("is_forecast", F.explode(F.arrays_zip(*names)).alias("r"))
    return x.select(F.col("r.time").try_cast("date").alias("log_date"), p.measured(F.col("r.temp_max")).alias("temp_max_f"),
                    p.measured(F.col("r.temp_min")).alias("temp_min_f"), p.measured(F.col("r.precipitation")).alias("precipitation_in"),
                    p.measured(F.col("r.snowfall_cm") * params.CM_TO_INCH).alias("snowfall_in"), "is_forecast")


def prefer_observed(rows: DataFrame) -> DataFrame:
    """One row per day: an observation replaces a forecast."""
    return first_row(rows, ["log_date"], [F.col("is_forecast").cast("int")])


def unregistered_skus(facts: DataFrame, master: DataFrame) -> DataFrame:
    """Skeleton master rows for SKUs that only occur in facts."""
    return (facts.filter("sku_id <> ''").select("sku_id").distinct().join(master.select("sku_id"), "sku_id", "left_anti")
            .withColumn("is_active", F.lit(True)))
