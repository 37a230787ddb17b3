"""Demand anomalies: unusual days per SKU and drops in gross margin."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.common import count_if, day, spread, total, total_if


def daily_profile(sales: DataFrame, as_of: date, lookback: int = 365) -> DataFrame:
    """Quantity, mean price and number of sales per (sku, day). A missing price counts as zero."""
    return (sales.filter(F.col("transaction_date").between(day(as_of, -lookback), day(as_of)))
            .filter("sku_id <> '' and transaction_id <> ''")
            .groupBy("sku_id", F.col("transaction_date").alias("day"))
            .agg(total("qty_sold").alias("daily_qty"), (total("unit_price") / F.count(F.lit(1))).alias("avg_price"),
                 F.count(F.lit(1)).alias("sales")))


def isolation_scores(x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Isolation-forest score of each row (higher is more unusual); each tree sees all rows, and all
    trees grow level by level."""
    rng = np.random.default_rng(seed)
    n, f = x.shape
    size = n
    picks = np.tile(np.arange(n), (trees, 1))
    node_s = np.zeros((trees, size), dtype=np.int64)
    node_x = np.zeros((trees, n), dtype=np.int64)
    depth = np.zeros((trees, n))
    live = np.ones((trees, n), dtype=bool)
    tree = np.arange(trees)[:, None]

    def expected(m):
        m = np.maximum(np.asarray(m, dtype=float), 1.0)
        big = 2.0 * (np.log(np.maximum(m - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (m - 1.0) / m
        return np.where(m > 2, big, np.where(m == 2, 1.0, 0.0))

    levels = int(np.ceil(np.log2(max(size, 2))))
    values = x[picks.ravel()]
    for level in range(levels + 1):
        width = 1 << level
        slot = (tree * width + node_s).ravel()
        # Bounds of the points in each node: group the points by node, reduce each run.
        order = np.argsort(slot, kind="stable")
        used, first, count = np.unique(slot[order], return_index=True, return_counts=True)
        lo = np.minimum.reduceat(values[order], first, axis=0)
        hi = np.maximum.reduceat(values[order], first, axis=0)
        spread = hi > lo
        leaf = np.ones(trees * width, dtype=bool)
        leaf[used] = (count <= 1) | ~spread.any(axis=1) | (level == levels)
        sizes = np.zeros(trees * width)
        sizes[used] = count
        at = tree * width + node_x
        ends = live & leaf[at]
        depth[ends] = level + expected(sizes[at[ends]])
        live &= ~ends
        if not live.any():
            break
        pick = np.argmax(np.where(spread, rng.random(spread.shape), -1.0), axis=1)
        rows = np.arange(len(used))
        low, high = lo[rows, pick], hi[rows, pick]
        feature = np.zeros(trees * width, dtype=np.int64)
        cut = np.zeros(trees * width)
        feature[used], cut[used] = pick, low + rng.random(len(used)) * (high - low)
        node_s = 2 * node_s + (values[np.arange(len(slot)), feature[slot]] >= cut[slot]).reshape(trees, size)
        node_x = 2 * node_x + (x[np.arange(n)[None, :], feature[at]] >= cut[at])
    return 2.0 ** (-depth.mean(axis=0) / max(float(expected(size)), 1e-9))


def unusual_days(profile: DataFrame, min_days: int = 30, contamination: float = 0.05, trees: int = 100,
                 seed: int = 42) -> DataFrame:
    """The most isolated days of each SKU. The grouped input has one row per day, so a group is
    bounded by the look-back however many sales a SKU has."""
    schema = "sku_id string, day date, daily_qty double, mean_qty double, anomaly_score double"

    def flag(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min_days:
            return pdf.head(0)[["sku_id", "day", "daily_qty"]].assign(mean_qty=0.0, anomaly_score=0.0)
        pdf = pdf.sort_values("day", ignore_index=True)
        scores = isolation_scores(pdf[["daily_qty", "avg_price", "sales"]].to_numpy(float), trees, seed)
        out = pdf[["sku_id", "day", "daily_qty"]].assign(mean_qty=pdf["daily_qty"].mean(), anomaly_score=-scores)
        return out[out["anomaly_score"] < np.percentile(out["anomaly_score"], 100 * contamination)]

    return spread(profile, ["sku_id"]).groupBy("sku_id").applyInPandas(flag, schema)


def volume_alerts(flagged: DataFrame, as_of: date, lookback: int = 30) -> DataFrame:
    high = F.col("daily_qty") > F.col("mean_qty")
    return (flagged.filter(F.col("day") >= day(as_of, -lookback))
            .select(day(as_of).alias("alert_date"), F.lit("volume_anomaly").alias("alert_type"),
                    F.when(high, "warning").otherwise("info").alias("severity"), "sku_id", "day",
                    F.when(high, "HIGH").otherwise("LOW").alias("direction"),
                    F.concat_ws("|", F.lit("volume_anomaly"), "sku_id", F.col("day").cast("string")).alias("alert_key"),
                    F.bround("daily_qty", 4).alias("daily_qty"), F.bround("mean_qty", 4).alias("mean_qty")))


def margin_drops(detail: DataFrame, as_of: date, recent_days: int = 7, base_days: int = 90, min_recent: int = 5,
                 min_drop: float = 0.15) -> DataFrame:
    """Pairs whose margin of the last days lies at least ``min_drop`` below the longer baseline."""
    recent = F.col("tran_date") >= day(as_of, -recent_days)
    s, g = F.col("sales"), F.col("gross_profit")
    x = (detail.filter(F.col("tran_date").between(day(as_of, -base_days), day(as_of)) & (F.col("tran_code") == "SL") & (s > 0))
         .groupBy(F.col("prod_line_pn").alias("sku_id"), "location_id")
         .agg(total("sales").alias("s90"), total("gross_profit").alias("g90"), total_if(recent, s).alias("s7"),
              total_if(recent, g).alias("g7"), count_if(recent).alias("recent_sales"))
         .filter((F.col("recent_sales") >= min_recent) & (F.col("s7") > 0) & (F.col("s90") > 0))
         .withColumn("base", F.col("g90") / F.col("s90")).withColumn("now", F.col("g7") / F.col("s7")))
    return (x.filter(F.col("base") - F.col("now") >= min_drop)
            .select("sku_id", "location_id", "recent_sales", F.bround("base", 4).alias("baseline_gp_pct"),
                    F.bround("now", 4).alias("current_gp_pct"), F.bround(F.col("base") - F.col("now"), 4).alias("gp_drop"),
                    F.concat_ws("|", F.lit("gp_anomaly"), "sku_id", "location_id").alias("alert_key")))
