"""Co-purchase rules from invoices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.common import day
from shelfwise.session import settle


def baskets(sales: DataFrame, as_of: date, lookback: int = 90) -> DataFrame:
    """Distinct (basket, sku) of invoices with two SKUs or more, however long they are."""
    items = settle(sales.filter(F.col("transaction_date").between(day(as_of, -lookback), day(as_of)))
             .filter("sku_id <> '' and invoice_number <> ''")
             .select(F.struct("transaction_date", "location_id", "invoice_number").alias("basket"), "sku_id").distinct())
    fit = (items.groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
           .filter("n > 1").select("basket"))
    return items.join(fit, "basket", "left_semi")


def _pairs(items: DataFrame, block: int) -> DataFrame:
    """(a, b, together): how many baskets hold both SKUs, a before b.

    An invoice of n SKUs is cut into n / block parts by a hash of the SKU, and each two parts meet in a
    task of their own as plain rows, so no list is copied and an invoice has no longest size. A row is sent
    once for each part it meets; pairs are counted with map-side partial sums."""
    parts = items.groupBy("basket").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    dealt = items.join(parts, "basket").withColumn("own", F.pmod(F.xxhash64("sku_id"), "parts"))
    one = dealt.select("basket", F.col("sku_id").alias("one"), F.col("own").alias("p"), F.explode(F.sequence("own", F.col("parts") - 1)).alias("q"))
    two = dealt.select("basket", F.col("sku_id").alias("two"), F.col("own").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("p"))
    met = one.join(two, ["basket", "p", "q"]).where("p < q or one < two")
    return met.groupBy(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).agg(F.count(F.lit(1)).alias("together"))


def basket_rules(items: DataFrame, as_of: date, min_support: float = 0.001, min_confidence: float = 0.3,
                 min_lift: float = 1.5, block: int = 256) -> DataFrame:
    """Rules in both directions between two SKUs.

    A pair is frequent only if both SKUs are, so infrequent SKUs leave before pairs are formed."""
    one_row = items.select("basket").distinct().agg(F.count(F.lit(1)).alias("total"))
    support = items.groupBy("sku_id").agg(F.count(F.lit(1)).alias("n"))
    frequent = support.crossJoin(F.broadcast(one_row)).filter(F.col("n") / F.col("total") >= min_support)
    pairs = _pairs(items.join(frequent.select("sku_id"), "sku_id", "left_semi"), block)
    both = pairs.select("a", "b", "together").union(pairs.select("b", "a", "together"))
    x = (both.join(frequent.select(F.col("sku_id").alias("a"), F.col("n").alias("n_a"), "total"), "a")
         .join(frequent.select(F.col("sku_id").alias("b"), F.col("n").alias("n_b")), "b"))
    confidence = F.col("together") / F.col("n_a")
    lift = confidence / (F.col("n_b") / F.col("total"))
    return (x.withColumn("s", F.col("together") / F.col("total")).withColumn("c", confidence).withColumn("l", lift)
            .filter((F.col("s") >= min_support) & (F.col("c") >= min_confidence) & (F.col("l") >= min_lift))
            .select(F.col("a").alias("antecedent_sku"), F.col("b").alias("consequent_sku"),
                    F.bround("s", 6).alias("support"), F.bround("c", 4).alias("confidence"), F.bround("l", 4).alias("lift"),
                    day(as_of).alias("rule_date"), F.col("total").alias("transaction_count")))
