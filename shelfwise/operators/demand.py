"""The demand frame: effective demand per (sku, location, day), shared by forecasts and imputation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.common import day, num


def training_sales(sales: DataFrame) -> DataFrame:
    """Sales fit to train on: no anomalies, no spill-over, no warranty rows."""
    flags = ("is_anomaly", "is_residual_demand", "is_warranty")
    keep = F.lit(True)
    for f in flags:
        keep = keep & ~F.coalesce(F.col(f), F.lit(False))
    return sales.filter(keep)


def effective_demand() -> Column:
    """Imputed quantity on a stockout row, sold quantity otherwise."""
    return F.when(F.coalesce("is_stockout", F.lit(False)), num("lost_sales_imputation")).otherwise(num("qty_sold"))


def daily_demand(sales: DataFrame, as_of: date, lookback: int) -> DataFrame:
    """Per (sku, location, day) in [as_of-lookback, as_of]: demand, positive demand, and whether any
    row was positive. At most one row per pair and day leaves the map side."""
    d = effective_demand()
    return (training_sales(sales).filter(F.col("transaction_date").between(day(as_of, -lookback), day(as_of)))
            .filter("sku_id <> '' and location_id <> ''")
            .groupBy("sku_id", "location_id", F.col("transaction_date").alias("day"))
            .agg(F.sum(d).alias("demand"), F.sum(F.when(d > 0, d).otherwise(0.0)).alias("positive"),
                 F.max((d > 0).cast("int")).alias("sold")))


def lost_sales_imputation(sales: DataFrame, window_days: int = 30, first: date | None = None, last: date | None = None,
                          tile_days: int = 128) -> DataFrame:
    """For each stockout sale, the mean quantity of in-stock sales of the SKU at other locations
    within ``window_days``. Instead of a band join: sums over a day range for the whole SKU, minus
    the same sums for the row's own location. Both windows run over pre-aggregated days in overlapping
    tiles of time (a tile's own days and ``window_days`` on both sides), so the history of one SKU is
    many tasks and a partition holds at most one row per day of a tile and location.

    ``first`` and ``last`` bound the stockout days wanted; only sales within reach of them are read."""
    epoch = F.lit(date(1970, 1, 1))
    in_stock = ~F.coalesce(F.col("is_stockout"), F.lit(False))
    rows = sales.filter("sku_id <> ''")
    for bound, reach in ((first, -window_days), (last, window_days)):
        if bound is not None:
            edge = day(bound, reach)
            rows = rows.filter(F.col("transaction_date") >= edge if reach < 0 else F.col("transaction_date") <= edge)
    rows = rows.withColumn("n_day", F.datediff("transaction_date", epoch))
    wanted = ~in_stock
    for bound, low in ((first, True), (last, False)):
        if bound is not None:
            wanted = wanted & (F.col("transaction_date") >= F.lit(bound) if low else F.col("transaction_date") <= F.lit(bound))
    # One row per (sku, location, day): in-stock sums, and whether a stockout sale needs a value.
    daily = (rows.groupBy("sku_id", F.coalesce("location_id", F.lit("")).alias("loc"), "n_day")
             .agg(F.sum(F.when(in_stock, num("qty_sold")).otherwise(0.0)).alias("q"),
                  F.sum(F.when(in_stock, 1).otherwise(0)).alias("n"),
                  F.max(wanted.cast("int")).alias("wanted")))
    tile = lambda n: F.floor(n / tile_days)
    n_day = F.col("n_day")
    # A day stands in its own tile and in those whose margin it lies in; one placement serves both windows.
    local = (daily.withColumn("tile", F.explode(F.sequence(tile(n_day - window_days), tile(n_day + window_days))))
             .withColumn("wanted", F.when(F.col("tile") == tile(n_day), F.col("wanted")).otherwise(0))
             .repartition("sku_id", "tile"))
    # Counting the locations keeps every column of ``local`` in use here too, so both branches are
    # the same plan up to the placement and it runs once.
    network = (local.groupBy("sku_id", "tile", "n_day")
               .agg(F.sum("q").alias("q"), F.sum("n").alias("n"), F.max("wanted").alias("wanted"), F.count("loc").alias("locs"))
               .filter("locs > 0"))

    def around(keys):
        return Window.partitionBy(*keys).orderBy("n_day").rangeBetween(-window_days, window_days)

    near_all = (network.select("sku_id", "tile", "n_day", "wanted", F.sum("q").over(around(["sku_id", "tile"])).alias("q_all"),
                               F.sum("n").over(around(["sku_id", "tile"])).alias("n_all")).filter("wanted = 1").drop("wanted"))
    near_own = (local.select("sku_id", "tile", "loc", "n_day", "wanted",
                             F.sum("q").over(around(["sku_id", "tile", "loc"])).alias("q_own"),
                             F.sum("n").over(around(["sku_id", "tile", "loc"])).alias("n_own")).filter("wanted = 1").drop("wanted"))
    peers = F.col("n_all") - F.col("n_own")
    value = (near_own.join(near_all, ["sku_id", "tile", "n_day"])
             .select("sku_id", "loc", "n_day",
                     F.when(peers > 0, F.bround((F.col("q_all") - F.col("q_own")) / F.when(peers > 0, peers), 2))
                     .otherwise(F.lit(0.0)).alias("lost_sales_imputation")))
    return (rows.filter(wanted).withColumn("loc", F.coalesce("location_id", F.lit("")))
            .drop("lost_sales_imputation").join(value, ["sku_id", "loc", "n_day"])
            .select("transaction_id", "sku_id", "location_id", "transaction_date", "lost_sales_imputation"))
